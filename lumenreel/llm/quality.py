"""Quality: ordinal cumulative-link regression on graded ratings over hashed text features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenreel.llm.common import Scratch, bound_batches
from lumenreel.llm.toxicity import word_table

#: Buckets that words and pairs of neighbours are hashed to, beside the dense features.
BUCKETS = 1 << 15
#: At most so many rated rows are learned from, those with the smallest hash of their id.
SAMPLE = 12_000
PENALTY, STEPS, RATE = 1e-4, 200, 0.3
DENSE = 12


def _hash(words: pa.Array) -> np.ndarray:
    """A bucket for each distinct word by its bytes."""
    import xxhash

    return np.fromiter((xxhash.xxh32_intdigest(w, 11) % BUCKETS for w in words.cast(pa.binary()).to_pylist()), np.int64, len(words))


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value): shares of hashed words and word pairs, square-rooted, of each whole text; the last
    columns hold dense features: length, repetition of words, pairs and lines, marks, digits, capitals."""
    texts = texts.cast(pa.string())
    n_texts = len(texts)
    codes, counts, words = word_table(texts)
    row = np.repeat(np.arange(n_texts), counts)
    bucket = _hash(words)[codes] if len(codes) else codes
    same = row[1:] == row[:-1]
    pair_row = row[1:][same]
    pairs = ((bucket[:-1][same].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + bucket[1:][same].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)).astype(np.int64) % BUCKETS
    r, c = np.r_[row, pair_row], np.r_[bucket, pairs]
    cell, seen = np.unique(r * BUCKETS + c, return_counts=True)
    r, c = cell // BUCKETS, cell % BUCKETS
    total = np.maximum(counts, 1)
    value = np.sqrt(seen / (2.0 * total[r]))
    own = np.bincount(np.unique(row * (len(words) + 1) + codes) // (len(words) + 1), minlength=n_texts) if len(codes) else np.zeros(n_texts)
    bi = np.bincount(np.unique(pair_row * np.int64(BUCKETS) + pairs) // BUCKETS, minlength=n_texts) if len(pairs) else np.zeros(n_texts)
    lists = pc.split_pattern(texts, "\n")
    line_counts = np.diff(lists.offsets.to_numpy())
    coded = lists.flatten().dictionary_encode()
    line_row = np.repeat(np.arange(n_texts), line_counts)
    lines = np.bincount(np.unique(line_row * (len(coded.dictionary) + 1) + coded.indices.to_numpy(zero_copy_only=False)) // (len(coded.dictionary) + 1), minlength=n_texts)
    chars = np.maximum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), 1)

    def share(pattern: str) -> np.ndarray:
        return pc.count_substring_regex(texts, pattern).to_numpy(zero_copy_only=False) / chars

    most = np.zeros(n_texts)
    np.maximum.at(most, r, seen)
    dense = np.stack([np.ones(n_texts), np.log1p(counts) / 8, own / total, bi / total, lines / np.maximum(line_counts, 1), most / total, share(r"[\p{Lu}]"), share(r"[0-9]"), share(r"[!?]") * 4, share(r"[^\p{L}\p{N}\s.,;:!?'\"-]") * 4, chars / total / 16, line_counts / total], 1)
    some = np.repeat(np.arange(n_texts), DENSE), np.tile(BUCKETS + np.arange(DENSE), n_texts), dense.ravel()
    return np.r_[r, some[0]], np.r_[c, some[1]], np.r_[value, some[2]]


@dataclass
class Grades:
    """One weight vector for all grades, and ordered thresholds: P(grade >= k) = logistic(x w - threshold_k)."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, texts: pa.Array) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..., falling in k; a column each."""
        row, col, value = features(texts)
        z = np.bincount(row, value * self.weights[col], minlength=len(texts))
        return 1 / (1 + np.exp(np.clip(self.thresholds[None] - z[:, None], -60, 60)))


def fit_ordinal(row: np.ndarray, col: np.ndarray, value: np.ndarray, grade: np.ndarray, grades: int) -> Grades:
    """Maximum likelihood of the cumulative logits with a quadratic penalty, by Adam steps over all rows.

    Thresholds are a first one and the logarithms of the gaps to the next, so they stay in order.
    """
    n, d, k = len(grade), BUCKETS + DENSE, grades - 1
    tail = np.clip([(grade >= g).mean() for g in range(1, grades)], 0.5 / (n + 1), 1 - 0.5 / (n + 1))
    start = np.maximum.accumulate(-np.log(tail / (1 - tail)) + 1e-3 * np.arange(k))
    gap = np.log(np.maximum(np.diff(start), 1e-2))
    w, first = np.zeros(d), start[0]
    w[BUCKETS] = 0.0
    m = [np.zeros(d), 0.0, np.zeros(k - 1)]
    v = [np.zeros(d), 0.0, np.zeros(k - 1)]
    params = [w, first, gap]
    for t in range(1, STEPS + 1):
        w, first, gap = params
        th = np.r_[first, first + np.cumsum(np.exp(gap))]
        z = np.bincount(row, value * w[col], minlength=n)
        up = np.c_[np.ones(n), 1 / (1 + np.exp(np.clip(th[None] - z[:, None], -60, 60))), np.zeros(n)]
        i = np.arange(n)
        p = np.maximum(up[i, grade] - up[i, grade + 1], 1e-12)
        slope = up * (1 - up)  # d P(grade >= k) / d(z - threshold_k)
        gz = -(slope[i, grade] - slope[i, grade + 1]) / p / n
        gth = np.zeros(k)
        np.add.at(gth, grade[grade > 0] - 1, slope[i, grade][grade > 0] / p[grade > 0] / n)
        np.add.at(gth, grade[grade < k], -slope[i, grade + 1][grade < k] / p[grade < k] / n)
        after = np.cumsum(gth[::-1])[::-1]
        grads = [np.bincount(col, value * gz[row], minlength=d) + PENALTY * w, gth.sum(), after[1:] * np.exp(gap)]
        for j, g in enumerate(grads):
            m[j] = 0.9 * m[j] + 0.1 * g
            v[j] = 0.99 * v[j] + 0.01 * g * g
            params[j] = params[j] - RATE * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.99**t)) + 1e-8) * (0.2 + 0.8 * (1 - t / STEPS))
    w, first, gap = params
    return Grades(w, np.r_[first, first + np.cumsum(np.exp(gap))])


def fit(scratch: Scratch, docs: DataFrame, ratings: DataFrame, grades: int, doc_id: str = "doc_id", text: str = "text", grade: str = "grade", sample: int = SAMPLE) -> Grades:
    """Learn from ratings (doc_id, grade 0..grades-1): at most `sample` ids, those of smallest hash.

    Features are made on executors; the driver gets the sample's sparse features, whose number the
    sample bounds. Ratings that are null or out of range, or whose document is absent, are left out;
    several ratings of one id count as their least. Without ratings all grades are equally likely.
    """
    bound_batches(scratch.spark)
    ids = ratings.where(F.col(grade).between(0, grades - 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("__id")).agg(F.min(F.col(grade).cast("int")).alias("y"))
    ids = ids.orderBy(F.xxhash64("__id"), "__id").limit(sample)
    rows = docs.select(F.col(doc_id).cast("long").alias("__id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = scratch.write(rows.join(F.broadcast(ids), "__id").select("y", "text").repartition(8), "rated")

    def sparse(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                r, c, v = features(part.column("text"))
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]) for x in (part.column("y").to_numpy().astype(np.int8), r.astype(np.int32), c.astype(np.int32), v.astype(np.float32))], names=["y", "r", "c", "v"])

    ys, rs, cs, vs, n = [np.zeros(0, np.int8)], [], [], [], 0
    for x in rows.mapInArrow(sparse, "y binary, r binary, c binary, v binary").toLocalIterator(prefetchPartitions=True):
        ys.append(np.frombuffer(x["y"], np.int8))
        rs.append(np.frombuffer(x["r"], np.int32) + np.int32(n))
        cs.append(np.frombuffer(x["c"], np.int32))
        vs.append(np.frombuffer(x["v"], np.float32))
        n += len(ys[-1])
    if not n:
        tail = np.arange(grades - 1, 0, -1) / grades
        return Grades(np.zeros(BUCKETS + DENSE), -np.log(tail / (1 - tail)))
    return fit_ordinal(np.concatenate(rs), np.concatenate(cs), np.concatenate(vs), np.concatenate(ys).astype(np.int64), grades)


def grade_texts(scratch: Scratch, docs: DataFrame, model: Grades, text: str = "text") -> DataFrame:
    """docs with expected_grade and tails, P(grade >= k) for each k, of every whole text (null: empty).

    Columns of docs with these names are replaced, all others kept. Null ids are graded like any other row,
    repeated rows alike; an empty table gives no rows.
    """
    bound_batches(scratch.spark)
    docs = docs.select([c for c in docs.columns if c not in ("expected_grade", "tails")])
    sent = scratch.spark.sparkContext.broadcast(model)
    schema = docs.select("*", F.lit(0.0).alias("expected_grade"), F.array(F.lit(0.0)).alias("tails")).schema
    names = schema.names

    def graded(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                t = sent.value.tails(pc.fill_null(part.column(names.index(text)).cast(pa.string()), ""))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(t.sum(1)), pa.array(list(t), pa.list_(pa.float64()))], names=names)

    return docs.mapInArrow(graded, schema)
