"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenreel.llm.common import Scratch, bound_batches, ragged, release

#: Lengths in characters of the n-grams of a word, with a mark before and after it.
GRAMS = (3, 4, 5, 6)
#: Buckets that n-grams are hashed to.
BUCKETS = 1 << 19
#: At most so many labelled rows are learned from, those with the smallest hash of their id.
SAMPLE = 12_000
#: Features kept: those that tell the labels apart most, of those seen in several documents.
KEPT = 1 << 13
LEAST_SEEN = 3
#: Strength of the quadratic penalty, and rounds of Newton steps.
PENALTY = 1e-2
ROUNDS = 12


def word_table(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Codes of the words of all texts in order, words of each text, and the distinct words (A-Z lower-cased)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    words = lists.flatten()
    counts = np.diff(lists.offsets.to_numpy())
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    empty = np.flatnonzero(pc.equal(coded.dictionary, "").to_numpy(zero_copy_only=False))
    if len(empty):  # an empty string stands before and after outer white space
        real = codes != empty[0]
        row = np.repeat(np.arange(len(counts)), counts)
        counts = np.bincount(row[real], minlength=len(counts))
        codes = codes[real]
    return codes, counts, coded.dictionary


def word_features(words: pa.Array, buckets: int = BUCKETS, grams: tuple[int, ...] = GRAMS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of each word, as start offsets (one more than words) and buckets."""
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32)
    padded = lengths + 2
    ends = np.cumsum(padded)
    starts = ends - padded
    buf = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint64)
    buf[ragged(starts + 1, lengths)] = data
    owner = np.repeat(np.arange(len(lengths)), padded)
    left = np.repeat(ends, padded) - np.arange(len(buf))  # characters to the end of the word
    found, owners = [], []
    h = np.zeros(len(buf), np.uint64)
    for i in range(max(grams)):
        shifted = buf[i:] + np.uint64(1)
        h[: len(shifted)] = h[: len(shifted)] * np.uint64(0x100000001B3) + shifted
        n = i + 1
        if n in grams:
            ok = left >= n
            if n == min(grams):
                ok |= (left == padded[owner]) & (padded[owner] < n)  # a word too short for any n-gram
            mixed = (h[ok] ^ np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            found.append((mixed >> np.uint64(32)) % np.uint64(buckets))
            owners.append(owner[ok])
    if not len(buf):
        return np.zeros(len(lengths) + 1, np.int64), np.zeros(0, np.int64)
    value, owner = np.concatenate(found).astype(np.int64), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.r_[0, np.cumsum(np.bincount(owner, minlength=len(lengths)))], value[order]


def text_features(texts: pa.Array, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the distinct n-grams of each whole text; keep: a column number by bucket, -1 if left out."""
    codes, counts, words = word_table(texts)
    start, value = word_features(words)
    if keep is not None:
        value = keep[value]
        ok = value >= 0
        start = np.r_[0, np.cumsum(ok)][start]
        value = value[ok]
    width = len(words) + 1
    row = np.repeat(np.arange(len(counts)), counts)
    has = (np.diff(start) > 0)[codes] if len(codes) else np.zeros(0, bool)
    pair = np.unique(row[has] * width + codes[has])
    row, code = pair // width, pair % width
    n = start[code + 1] - start[code]
    feature = value[ragged(start[code], n)]
    row = np.repeat(row, n)
    top = np.int64(BUCKETS + 1)
    both = np.unique(row * top + feature)
    return both // top, both % top


@dataclass
class Toxicity:
    """A fitted model of bounded size: column by bucket, weight by column (ratio times linear weight), bias."""

    columns: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        row, col = text_features(texts, self.columns)
        z = self.bias + np.bincount(row, self.weights[col], minlength=len(texts)) if len(col) else np.full(len(texts), self.bias)
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def log_ratios(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """log of a feature's smoothed share of documents among label 1 over that among label 0."""
    return np.log((pos + 1) / (n_pos + 2)) - np.log((neg + 1) / (n_neg + 2))


def fit_linear(row: np.ndarray, col: np.ndarray, y: np.ndarray, ratio: np.ndarray, penalty: float = PENALTY, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Logistic regression on presence times ratio by Newton steps with conjugate gradients."""
    n, d = len(y), len(ratio)
    x = ratio[col]
    w, b = np.zeros(d), 0.0

    def forward(v, c):
        return np.bincount(row, x * v[col], minlength=n) + c

    def back(e):
        return np.bincount(col, x * e[row], minlength=d), e.sum()

    def loss(v, c):
        z = forward(v, c)
        return np.logaddexp(0, np.where(y > 0, -z, z)).sum() + 0.5 * penalty * n * (v @ v)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(forward(w, b), -30, 30)))
        gw, gb = back(p - y)
        gw += penalty * n * w
        if max(np.abs(gw).max(initial=0), abs(gb)) < 1e-4 * n:
            break
        s = p * (1 - p) + 1e-6
        dw, db = np.zeros(d), 0.0
        rw, rb = -gw, -gb
        qw, qb = rw.copy(), rb
        rr = rw @ rw + rb * rb
        first = rr
        for _ in range(20):
            hw, hb = back(s * forward(qw, qb))
            hw += penalty * n * qw
            a = rr / (qw @ hw + qb * hb)
            dw, db = dw + a * qw, db + a * qb
            rw, rb = rw - a * hw, rb - a * hb
            new = rw @ rw + rb * rb
            if new < 1e-4 * first:
                break
            qw, qb = rw + new / rr * qw, rb + new / rr * qb
            rr = new
        step, now = 1.0, loss(w, b)
        while step > 1e-3 and loss(w + step * dw, b + step * db) > now:
            step /= 2
        w, b = w + step * dw, b + step * db
    return w, b


def select(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int, kept: int = KEPT) -> np.ndarray:
    """Buckets by how far their shares among the two labels differ, in standard errors."""
    seen = np.flatnonzero(pos + neg >= LEAST_SEEN)
    p, q = pos[seen] / max(1, n_pos), neg[seen] / max(1, n_neg)
    m = (pos[seen] + neg[seen]) / max(1, n_pos + n_neg)
    z = np.abs(p - q) / np.sqrt(m * (1 - m) + 1e-12)
    return np.sort(seen[np.argsort(-z, kind="stable")[:kept]])


#: Tasks that the sample is spread over; the driver gets two arrays of counts from each.
FIT_TASKS = 8


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, folds: int = 5, held: int = 0) -> DataFrame:
    """(y, text) of the labelled rows learned from: never the held-out remainder, at most `sample` ids."""
    ids = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("__id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    ids = ids.where(F.crc32(F.col("__id").cast("string").cast("binary")) % folds != held)
    ids = ids.orderBy(F.xxhash64("__id"), "__id").limit(sample)
    rows = docs.select(F.col(doc_id).cast("long").alias("__id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.join(F.broadcast(ids), "__id").select("y", "text").repartition(FIT_TASKS)


def _slices(b: pa.RecordBatch, rows: int = 150):
    for at in range(0, b.num_rows, rows):
        yield b.slice(at, rows)


def fit(scratch: Scratch, docs: DataFrame, labels: DataFrame, **options) -> Toxicity:
    """Learn from labelled rows; see training_rows for which.

    Document counts of every n-gram by label give the log-count ratios; the ratios scale the features
    of a logistic regression. The sample bounds all that reaches the driver. Without labelled rows the
    model scores 0; with one label only, its smoothed share.
    """
    rows = scratch.write(training_rows(docs, labels, **options), "train")

    def count(batches):
        seen, size = np.zeros((2, BUCKETS), np.int32), np.zeros(2, np.int64)
        for b in batches:
            for part in _slices(b):
                y = part.column("y").to_numpy()
                r, c = text_features(part.column("text"))
                for k in (0, 1):
                    seen[k] += np.bincount(c[y[r] == k], minlength=BUCKETS).astype(np.int32)
                    size[k] += int((y == k).sum())
            release()
        yield pa.RecordBatch.from_arrays([pa.array([seen.tobytes()]), pa.array([size.tobytes()])], names=["seen", "size"])

    def add(batches):
        seen, size = np.zeros(2 * BUCKETS, np.int32), np.zeros(2, np.int64)
        for b in batches:
            for s, n in zip(b.column("seen").to_pylist(), b.column("size").to_pylist()):
                seen += np.frombuffer(s, np.int32)
                size += np.frombuffer(n, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([seen.tobytes()]), pa.array([size.tobytes()])], names=["seen", "size"])

    schema = "seen binary, size binary"  # one row of fixed size for each of the few tasks meets in one
    total = rows.mapInArrow(count, schema).repartition(1).mapInArrow(add, schema).first()
    seen, size = np.frombuffer(total["seen"], np.int32).reshape(2, -1), np.frombuffer(total["size"], np.int64)
    neg, pos, n_neg, n_pos = seen[0], seen[1], int(size[0]), int(size[1])
    columns = np.full(BUCKETS, -1, np.int32)
    if not n_pos or not n_neg:
        bias = float(np.log((n_pos + 0.5) / (n_neg + 0.5))) if n_pos + n_neg else -60.0
        return Toxicity(columns, np.zeros(1), bias)
    chosen = select(pos, neg, n_pos, n_neg)
    columns[chosen] = np.arange(len(chosen))

    def sparse(batches):
        for b in batches:
            for part in _slices(b):
                r, c = text_features(part.column("text"), columns)
                yield pa.RecordBatch.from_arrays([pa.array([part.column("y").to_numpy().astype(np.int8).tobytes()]), pa.array([r.astype(np.int32).tobytes()]), pa.array([c.astype(np.int32).tobytes()])], names=["y", "r", "c"])
            release()

    ys, rs, cs, n = [], [], [], 0
    for x in rows.mapInArrow(sparse, "y binary, r binary, c binary").toLocalIterator(prefetchPartitions=True):
        ys.append(np.frombuffer(x["y"], np.int8))
        rs.append(np.frombuffer(x["r"], np.int32) + np.int32(n))
        cs.append(np.frombuffer(x["c"], np.int32))
        n += len(ys[-1])
    ratio = log_ratios(pos[chosen], neg[chosen], n_pos, n_neg)
    w, bias = fit_linear(np.concatenate(rs), np.concatenate(cs), np.concatenate(ys).astype(float), ratio)
    return Toxicity(columns, w * ratio, float(bias))


def score(scratch: Scratch, docs: DataFrame, model: Toxicity, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the score of every whole text (null: empty) as a last column; one narrow pass.

    Only the text is looked at. Long texts are cut nowhere; repeated rows score alike. A column of docs that has the
    score's name is replaced. Empty table: no rows.
    """
    bound_batches(scratch.spark)
    docs = docs.select([c for c in docs.columns if c != out])
    sent = scratch.spark.sparkContext.broadcast(model)
    schema = docs.select("*", F.lit(0.0).alias(out)).schema
    names = schema.names

    def scored(batches):
        for b in batches:
            for part in _slices(b, 400):
                texts = pa.array(["" if t is None else t for t in part.column(names.index(text)).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sent.value.scores(texts))], names=names)
            release()

    return docs.mapInArrow(scored, schema)
