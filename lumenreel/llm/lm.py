"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

A token's probability is a product of factors down a tree over the whole vocabulary. Its class (16) and its
member of the class (16) come from two softmaxes over hashed features of the tokens before it: n-grams, skips
and the word before by identity. A member is a frequent word, the end of a text, or a bucket of rarer words by
their last bytes. In a bucket the share of words seen once is left for unknown ones; a known word is then found by two
more softmaxes of 16, by digits of its hash, over hashed features of the bucket, the digits so far and the word
before. Words of one bucket and digits share a leaf: the last factor is a word's share of the leaf's training
tokens. Leaves hold about one word each up to 24,000 words; the shares are counted over the whole corpus.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenreel.llm.common import Scratch, release, text_bytes
from lumenreel.llm.toxicity import word_table

FOLDS, HELD = 7, 2
#: Frequent words with a member of their own (one more is the end); buckets of all others.
FREQUENT, BUCKETS = 159, 95
END, START, SIDE = FREQUENT, 255, 16
#: Hash of the end as a token; no word is empty.
END_HASH = xxhash.xxh64_intdigest(b"", 42) - (1 << 63)
#: Text held by one block of documents, whose distinct words ask for their counts once.
BLOCK_BYTES = 18 << 20
#: Training tokens of one stream of updates, and the most streams that are averaged.
STREAM_TOKENS, STREAMS = 4_000_000, 4096
#: Tokens whose features are held at once.
RUN_TOKENS = 1 << 17
MINIBATCH = 1 << 16
RATES = (0.25, 0.1)
CHUNK_ROWS = 1024

#: Two digits of a rarer word's hash are a number below this, which marks words that were not learned from. Words that
#: share a bucket and digits are a leaf.
UNKNOWN = 255
LEAVES = BUCKETS * 256
#: The word before by 16 bits of its hash; before the first word of a text.
NO_WORD = 0xFFFF
#: Rows of each feature's table for the class, the member of a class, and the two digits of a rarer word. Streams are
#: averaged row by row, so the tables' size is fixed; it bounds what a broadcast holds (13 MB).
ROWS = ((256, 256, 1 << 14, 1 << 14, 1 << 15), (1 << 12, 1 << 12, 1 << 15), (1 << 15,), (1 << 16,))
#: Squared gradients that a row of a table of hashed words starts with: rows seen a few times stay near the biases.
CAUTION, HASHED = 3.0, 1 << 13


def _mix(*parts: np.ndarray, rows: int, salt: int) -> np.ndarray:
    h = np.full(len(parts[0]), salt, np.uint64)
    for p in parts:
        h = (h ^ p.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h % np.uint64(rows)).astype(np.int64)


def features(symbols: np.ndarray, words: np.ndarray, starts: np.ndarray) -> tuple[list[np.ndarray], ...]:
    """Rows of each level's features for every token; `starts` are the texts' first tokens."""
    n = len(symbols)
    place = np.arange(n) - np.repeat(starts, np.diff(np.r_[starts, n]))

    def back(x: np.ndarray, k: int, outside: int) -> np.ndarray:
        s = np.full(n, outside, np.int64)
        s[k:] = x[: max(0, n - k)]
        s[place < k] = outside
        return s

    a, b, c = (back(symbols, k, START) for k in (1, 2, 3))
    word = back(words, 1, NO_WORD)
    own = symbols.astype(np.int64)
    group = own // SIDE
    r = ROWS
    return (
        [a, b, _mix(a, b, rows=r[0][2], salt=1), _mix(a, c, rows=r[0][3], salt=2), _mix(word, rows=r[0][4], salt=3)],
        [group * 256 + a, group * 256 + b, _mix(group, word, rows=r[1][2], salt=4)],
        [_mix(own, word, rows=r[2][0], salt=5)],
        [_mix(own, word, rows=1 << 30, salt=6)],
    )


def _offsets(rows: tuple[int, ...]) -> np.ndarray:
    return np.r_[0, np.cumsum(rows)]


@dataclass
class Maxent:
    """Weights: a row of 16 numbers for each hashed feature of each level, and biases from counts."""

    class_bias: np.ndarray
    member_bias: np.ndarray
    high_bias: np.ndarray
    low_bias: np.ndarray
    tables: list[np.ndarray] = field(default_factory=lambda: [np.zeros((sum(r), SIDE), np.float32) for r in ROWS])

    @classmethod
    def of_counts(cls, counts: np.ndarray, leaves: np.ndarray) -> Maxent:
        """Without features: shares in the training tokens of 256 members, and of the digits below each bucket."""
        c = counts.reshape(SIDE, SIDE).astype(np.float64) + 0.5
        c[-1, -1] = 1e-9  # no member: START is never said
        d = leaves.reshape(BUCKETS, SIDE, SIDE).astype(np.float64) + 0.01
        log = lambda x: np.log(x / x.sum(-1, keepdims=True)).astype(np.float32)
        return cls(log(c.sum(1)), log(c), log(d.sum(2)), log(d).reshape(-1, SIDE))

    def softmaxes(self, symbols, digits, rows):
        """(level, tokens, numerators, totals, wanted, rows of the level's features): the tokens are all for two levels, the
        rarer words for the others."""
        s, every = symbols.astype(np.int64), np.arange(len(symbols))
        rare = np.flatnonzero((s > END) & (digits != UNKNOWN))
        bucket, high, low = s[rare] - END - 1, (digits[rare] >> 4).astype(np.int64), (digits[rare] & 15).astype(np.int64)
        deepest = [_mix(rows[3][0][rare], high, rows=ROWS[3][0], salt=7)]
        for level, (at, bias, want, own) in enumerate((
            (every, np.broadcast_to(self.class_bias, (len(s), SIDE)), s // SIDE, rows[0]), (every, self.member_bias[s // SIDE], s % SIDE, rows[1]),
            (rare, self.high_bias[bucket], high, [f[rare] for f in rows[2]]), (rare, self.low_bias[bucket * SIDE + high], low, deepest),
        )):
            z = bias.copy()
            for f, first in zip(own, _offsets(ROWS[level])):
                z += self.tables[level][f + first]
            z -= z.max(1, keepdims=True, initial=-1e30)
            np.exp(z, out=z)
            yield level, at, z, z.sum(1), want, own

    def log10(self, symbols: np.ndarray, digits: np.ndarray, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """log10 of the product of each token's softmax factors; minibatches bound the memory."""
        rows = features(symbols, words, starts)
        out = np.zeros(len(symbols))
        for first in range(0, len(symbols), MINIBATCH):
            cut = slice(first, first + MINIBATCH)
            part = out[cut]
            for _, at, z, total, want, _ in self.softmaxes(symbols[cut], digits[cut], [[f[cut] for f in r] for r in rows]):
                part[at] += np.log10(np.maximum(z[np.arange(len(at)), want], 1e-30)) - np.log10(total)
        return out


class Updates:
    """One stream of Adagrad steps from given weights; visits weigh a row when streams are averaged."""

    def __init__(self, model: Maxent, rate: float):
        self.model = Maxent(model.class_bias, model.member_bias, model.high_bias, model.low_bias, [t.copy() for t in model.tables])
        self.rate = rate
        self.squares = [np.repeat([CAUTION if n >= HASHED else 1e-6 for n in r], r).astype(np.float32)[:, None] + np.zeros(SIDE, np.float32) for r in ROWS]
        self.visits = [np.zeros(len(t), np.float32) for t in model.tables]

    def learn(self, symbols: np.ndarray, digits: np.ndarray, words: np.ndarray, starts: np.ndarray) -> None:
        rows = features(symbols, words, starts)
        for first in range(0, len(symbols), MINIBATCH):
            cut = slice(first, first + MINIBATCH)
            for level, at, z, total, want, own in self.model.softmaxes(symbols[cut], digits[cut], [[f[cut] for f in r] for r in rows]):
                z /= total[:, None]
                z[np.arange(len(at)), want] -= 1
                for f, low, size in zip(own, _offsets(ROWS[level]), ROWS[level]):
                    self._step(level, f, low, size, z.ravel())

    def _step(self, level: int, f: np.ndarray, low: int, size: int, error: np.ndarray) -> None:
        here = slice(low, low + size)
        step = np.bincount((f[:, None] * SIDE + np.arange(SIDE)).ravel(), error, minlength=size * SIDE).reshape(size, SIDE).astype(np.float32)
        self.squares[level][here] += step * step
        self.model.tables[level][here] -= self.rate * step / np.sqrt(self.squares[level][here])
        self.visits[level][here] += np.bincount(f, minlength=size)


def _runs(b: pa.RecordBatch):
    """(symbols, digits, words, starts) of as many whole texts at a time as RUN_TOKENS allows."""
    kinds = (("symbols", np.uint8), ("digits", np.uint8), ("words", np.uint16))
    held: list[int] = []
    size = 0
    lengths = b.column("n_tokens").to_pylist()
    for i, n in enumerate(lengths):
        held.append(i)
        size += n
        if size >= RUN_TOKENS or i + 1 == len(lengths):
            parts = [np.frombuffer(b"".join(b.column(c)[k].as_py() for k in held), t) for c, t in kinds]
            n = np.array([lengths[k] for k in held], np.int64)
            yield *parts, np.cumsum(n) - n
            held, size = [], 0


def _blocks(batches):
    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.nbytes
        if size >= BLOCK_BYTES:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


_CODED = "kind int, block long, doc_id long, held boolean, low binary, high binary, code int, word long, leaf int, n long"


def _code(batches):
    """Documents as codes of the block's own dictionary (kind 0), and its words with their training counts (kind 1)."""
    task = TaskContext.get().partitionId()
    names = [f.split()[0] for f in _CODED.split(", ")]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]

    def rows(height, **known):
        return pa.RecordBatch.from_arrays([pa.array(known[k], t) if k in known else pa.nulls(height, t) for k, t in zip(names, types)], names=names)

    for seq, t in enumerate(_blocks(batches)):
        block = (task << 24) | seq
        codes, counts, words = word_table(t.column("text").cast(pa.string()).combine_chunks())
        n_docs, v = t.num_rows, len(words)
        held = t.column("held").to_numpy()
        train = np.repeat(~held, counts)
        n = np.r_[np.bincount(codes[train], minlength=v), (~held).sum()]
        rank = np.empty(v, np.int64)
        rank[np.argsort(-np.bincount(codes, minlength=v), kind="stable")] = np.arange(1, v + 1)
        codes = rank[codes]  # frequent words get small codes; 0 is the end
        ends = np.cumsum(counts)
        low, high = (codes & 0xFFFF).astype(np.uint16), (codes >> 16).astype(np.uint16)
        for at in range(0, n_docs, 1000):
            part = slice(at, min(at + 1000, n_docs))
            spans = [(e - k, e) for e, k in zip(ends[part].tolist(), counts[part].tolist())]
            m = len(spans)
            yield rows(m, kind=np.zeros(m, np.int32), block=np.full(m, block), doc_id=t.column("doc_id").slice(at, m).combine_chunks(), held=held[part], low=[low[a:b].tobytes() for a, b in spans], high=[high[a:b].tobytes() for a, b in spans])
        raw = words.cast(pa.binary()).to_pylist()
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in raw), np.uint64, v).view(np.int64)
        tails = np.fromiter((xxhash.xxh32_intdigest(w[-3:], 7) % BUCKETS for w in raw), np.int32, v) << 8 | (hashes & 0xFF).astype(np.int32) % UNKNOWN
        codes, hashes, tails = np.r_[rank, 0], np.r_[hashes, END_HASH], np.r_[tails, 0].astype(np.int32)
        for at in range(0, v + 1, 50_000):
            part = slice(at, at + 50_000)
            m = len(codes[part])
            yield rows(m, kind=np.ones(m, np.int32), block=np.full(m, block), code=codes[part].astype(np.int32), word=hashes[part], leaf=tails[part], n=n[part])
        del words, raw, t
        release()


def score_texts(scratch: Scratch, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = FOLDS, held: int = HELD) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    Documents whose crc32(doc_id as text) has the remainder `held` are not learned from. Counts are over
    all training tokens. A block of documents asks once for each of its distinct words (known by a 64-bit
    hash), so a frequent word is one row a block rather than one a token, and no vocabulary is broadcast
    or gathered on the driver: it gets 159 words, the sums of 24,320 leaves and the weights, whose sizes are fixed.
    Training passes once over all training tokens: streams of minibatch steps on executors, averaged
    after each of two rounds over half of the documents.

    Null or empty text: the end alone. Null doc_id: learned from (its remainder is none), kept with a
    null id. Repeated rows count as often as they stand. Without training tokens all is unknown.
    """
    remainder = F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(remainder == held, F.lit(False)).alias("held"), text_bytes(text).cast("string").alias("text"))
    coded = scratch.write(rows.mapInArrow(_code, _CODED), "coded")
    same = Window.partitionBy("word")
    words = coded.where("kind = 1").select("block", "code", "word", "leaf", "n")
    words = words.select("block", "code", "word", "leaf", F.sum("n").over(same).alias("c"), (F.col("block") == F.min("block").over(same)).alias("first"))
    words = scratch.write(words, "words")
    once = words.where("first and c > 0")
    top = once.where(F.col("word") != END_HASH).orderBy(F.desc("c"), "word").limit(FREQUENT).collect()
    frequent = {r["word"]: i for i, r in enumerate(top)}
    symbol_of = np.array(sorted(frequent), np.int64), np.array([frequent[w] for w in sorted(frequent)], np.int64)
    known = once.where(~F.col("word").isin([*frequent, END_HASH])).groupBy("leaf").agg(F.sum("c").alias("n"), F.count_if(F.col("c") == 1).alias("once")).collect()
    total = once.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(F.when(F.col("word") == END_HASH, F.col("c"))), F.lit(0)).alias("ends")).first()
    n_all, v_all = int(total["n"]), int(total["v"])
    counts = np.zeros(256)
    for i, r in enumerate(top):
        counts[i] = r["c"]
    counts[END] = total["ends"]
    in_leaf, single = np.zeros(LEAVES), np.zeros(LEAVES)
    for r in known:
        in_leaf[r["leaf"]], single[r["leaf"]] = r["n"], r["once"]
    unknown = (single.reshape(BUCKETS, 256).sum(1) + 0.5) / (in_leaf.reshape(BUCKETS, 256).sum(1) + 1.0)
    counts[END + 1 : END + 1 + BUCKETS] = in_leaf.reshape(BUCKETS, 256).sum(1)

    def resolve(left: pa.Table, right: pa.Table) -> pa.Table:
        """Codes of one block to members, and the factors that no weight changes."""
        size = right.num_rows
        code = right.column("code").to_numpy()
        c, word, leaf = (np.empty(size, np.int64) for _ in range(3))
        c[code], word[code], leaf[code] = (right.column(k).to_numpy() for k in ("c", "word", "leaf"))
        at = np.clip(np.searchsorted(symbol_of[0], word), 0, max(0, len(symbol_of[0]) - 1))
        own = (symbol_of[0][at] == word) if len(symbol_of[0]) else np.zeros(size, bool)
        symbol = np.where(word == END_HASH, END, END + 1 + (leaf >> 8))
        symbol[own] = symbol_of[1][at[own]]
        rare = symbol > END
        lexical = np.zeros(size)
        k = leaf[rare]
        lexical[rare] = np.where(c[rare] > 0, np.log10((1 - unknown[k >> 8]) * np.maximum(c[rare], 1) / np.maximum(in_leaf[k], 1)), np.log10(unknown[k >> 8]))
        base = np.log10((c + 1.0) / (n_all + 1.0 * (v_all + 1)))
        symbol, digit, before = symbol.astype(np.uint8), np.where(c > 0, leaf & 0xFF, UNKNOWN).astype(np.uint8), (word >> 8 & 0xFFFF).astype(np.uint16)
        out = {k: [] for k in ("n_tokens", "n_known", "base_score", "lexical", "symbols", "digits", "words")}
        for lo, hi in zip(left.column("low").to_pylist(), left.column("high").to_pylist()):
            codes = np.r_[np.frombuffer(lo, np.uint16).astype(np.int64) | np.frombuffer(hi, np.uint16).astype(np.int64) << 16, 0]
            out["n_tokens"].append(len(codes))
            out["n_known"].append(int((c[codes] > 0).sum()))
            out["base_score"].append(float(base[codes].sum()))
            out["lexical"].append(float(lexical[codes].sum()))
            for name, x in (("symbols", symbol), ("digits", digit), ("words", before)):
                out[name].append(x[codes].tobytes())
        cols = [left.column("doc_id"), left.column("held"), pa.array(out["n_tokens"], pa.int64()), pa.array(out["n_known"], pa.int64()), pa.array(out["base_score"], pa.float64()), pa.array(out["lexical"], pa.float64()), *(pa.array(out[k], pa.binary()) for k in ("symbols", "digits", "words"))]
        del out, left, right
        release()
        return pa.Table.from_arrays(cols, names=["doc_id", "held", "n_tokens", "n_known", "base_score", "lexical", "symbols", "digits", "words"])

    texts = coded.where("kind = 0").select("block", "doc_id", "held", "low", "high")
    asked = words.select("block", "code", "word", "leaf", "c")
    resolved = texts.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(resolve, "doc_id long, held boolean, n_tokens long, n_known long, base_score double, lexical double, symbols binary, digits binary, words binary")
    resolved = scratch.write(resolved, "resolved")
    scratch.drop(coded, words)

    model = Maxent.of_counts(counts, in_leaf)
    streams = int(min(STREAMS, max(1, n_all // len(RATES) // STREAM_TOKENS)))
    for turn, rate in enumerate(RATES):
        half = resolved.where(~F.col("held") & (F.pmod(F.xxhash64("doc_id"), F.lit(len(RATES))) == turn)).select("n_tokens", "symbols", "digits", "words")
        model = _average(scratch, half.coalesce(streams), model, rate)
    sent = scratch.spark.sparkContext.broadcast(model)

    def scored(batches):
        for b in batches:
            if not b.num_rows:
                continue
            said = np.concatenate([np.add.reduceat(sent.value.log10(*run), run[-1]) for run in _runs(b)])
            keep = [b.column(k) for k in ("doc_id", "held", "n_tokens", "n_known", "base_score")]
            yield pa.RecordBatch.from_arrays([*keep[:4], pa.array(np.full(b.num_rows, n_all)), keep[4], pa.array(said + b.column("lexical").to_numpy())], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return resolved.mapInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _average(scratch: Scratch, texts: DataFrame, model: Maxent, rate: float) -> Maxent:
    """A round: every stream steps through its texts from the same weights; rows are averaged by visits."""
    start = scratch.spark.sparkContext.broadcast(model)

    def stream(batches):
        own = None
        for b in batches:
            if not b.num_rows:
                continue
            own = own or Updates(start.value, rate)
            for run in _runs(b):
                own.learn(*run)
            release()
        if own:
            for k, table in enumerate(own.model.tables):
                for at in range(0, len(table), CHUNK_ROWS):
                    seen = own.visits[k][at : at + CHUNK_ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([at], pa.int64()), pa.array([table[at : at + CHUNK_ROWS].tobytes()]), pa.array([seen.tobytes()])], names=["k", "at", "rows", "seen"])

    def merge(t: pa.Table) -> pa.Table:
        total = weight = 0
        for rows, seen in zip(t.column("rows").to_pylist(), t.column("seen").to_pylist()):
            w = np.frombuffer(seen, np.float32).astype(np.float64)[:, None]
            total = total + np.frombuffer(rows, np.float32).reshape(-1, SIDE) * w
            weight = weight + w
        out = (total / np.maximum(weight, 1e-9)).astype(np.float32)
        return pa.Table.from_arrays([t.column("k").slice(0, 1), t.column("at").slice(0, 1), pa.array([out.tobytes()]), pa.array([(weight > 0).astype(np.float32).tobytes()])], names=["k", "at", "rows", "seen"])

    schema = "k int, at long, rows binary, seen binary"
    parts = scratch.write(texts.mapInArrow(stream, schema), "streams")
    tables = [t.copy() for t in model.tables]
    for r in parts.groupBy("k", "at").applyInArrow(merge, schema).collect():
        rows, seen = np.frombuffer(r["rows"], np.float32).reshape(-1, SIDE), np.frombuffer(r["seen"], np.float32) > 0
        here = tables[r["k"]][r["at"] : r["at"] + len(rows)]
        here[seen] = rows[seen]
    scratch.drop(parts)
    return Maxent(model.class_bias, model.member_bias, model.high_bias, model.low_bias, tables)
