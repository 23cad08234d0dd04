"""Mixture-controlled packing: deficit round-robin over source queues.

In each window every queue is visited once. Its deficit grows by its quantum, the target proportion of
the window, and whole tokens are served from it; what is left of the deficit is carried to the next
window. After w windows a queue has therefore served floor(its share of w windows), whatever document
or partition these tokens are in. So the place of every token follows from its place in its queue, and
partitions need nothing from each other but the lengths of the queues before them.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenreel.llm.common import Scratch, ragged, release

SEQUENCE = 1024
#: Sequences of a window: the span over which proportions hold.
WINDOW = 64
#: Queues: the largest sources have one each, all others share the last.
QUEUES = 1024
#: Texts with other characters than these take the tokenizers' own path: for these the two agree.
_PLAIN = r"^[\n\r\t\x20-\x7e\x{a1}-\x{24f}\x{2010}-\x{2026}]*$"
#: The split of byte-level BPE, a fixed value of that format.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _bytes_of_letters() -> dict[str, int]:
    """Byte-level BPE writes each byte as a letter: printable Latin-1 as it is, the others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class TextIds:
    """Ids of whole texts as the tokenizers file gives them.

    Where the file is byte-level BPE whose merges stand in order of their ids, plain texts are encoded
    from the same file's vocabulary as ranks, which gives the same ids several times faster; a text with
    unusual characters or the string of an added token goes through tokenizers itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = self._ranked(json.loads(self.tokenizer.to_str()))

    def _ranked(self, spec: dict):
        import tiktoken

        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        if model.get("type") != "BPE" or not plain or model.get("byte_fallback") or model.get("ignore_merges"):
            return None
        letters, added = _bytes_of_letters(), set(self.added)
        ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != sorted(merged) or len(ranks) != len(merged) + 256:
            return None
        return tiktoken.Encoding("ranks", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        plain = pc.match_substring_regex(texts, _PLAIN)
        for s in self.added:
            plain = pc.and_not(plain, pc.match_substring(texts, s))
        out = []
        for text, ok in zip(texts.to_pylist(), plain.to_pylist()):
            if ok and self.fast:
                out.append(np.array(self.fast.encode_ordinary(text), self.dtype))
            else:
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype))
        return out


class Rounds:
    """Tokens served from each queue by the end of each window, for given lengths and proportions.

    At virtual time t queue q has served min(length, proportion * t); windows end where the sum reaches
    a whole number of windows. Queues that run dry leave their share to the others in proportion.
    """

    def __init__(self, lengths: np.ndarray, proportions: np.ndarray, window: int):
        self.lengths, self.window = lengths.astype(np.float64), window
        self.shares = proportions / proportions.sum()
        self.total = int(lengths.sum())
        self.count = max(1, -(-self.total // window))
        self.knots = np.unique(np.r_[0.0, self.lengths / self.shares])
        self.served_at = np.array([np.minimum(self.lengths, self.shares * t).sum() for t in self.knots])

    def served(self, w: np.ndarray) -> np.ndarray:
        """One row a window number: tokens each queue has served before that window."""
        t = np.interp(np.minimum(w * float(self.window), float(self.total)), self.served_at, self.knots)
        out = np.floor(np.minimum(self.lengths, t[:, None] * self.shares) + 1e-6)
        out[w >= self.count] = self.lengths
        return out.astype(np.int64)

    def find(self, queue: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The window that serves each place of a queue."""
        t = place / self.shares[queue]
        w = np.clip((np.interp(t, self.knots, self.served_at) // self.window).astype(np.int64), 0, self.count - 1)
        while True:
            known, at = np.unique(np.r_[w, w + 1], return_inverse=True)
            served = self.served(known)
            low, high = served[at[: len(w)], queue], served[at[len(w) :], queue]
            move = (place >= high).astype(np.int64) - (place < low)
            if not move.any():
                return w
            w += move


def place_pieces(rounds: Rounds, queue: np.ndarray, start: np.ndarray, length: np.ndarray, sequence: int = SEQUENCE):
    """Pieces of runs [start, start + length) of queues: (run, offset in run, length, sequence, offset there, window).

    Sequences are full; the last tokens form sequences whose lengths are powers of two, so none is padded.
    """
    w0, w1 = rounds.find(queue, start), rounds.find(queue, start + length - 1)
    run = np.repeat(np.arange(len(start)), w1 - w0 + 1)
    w = ragged(w0, w1 - w0 + 1)
    known, at = np.unique(np.r_[w, w + 1], return_inverse=True)
    served = rounds.served(known)
    lo, hi = served[at[: len(w)]], served[at[len(w) :]]
    q = queue[run]
    r = np.arange(len(w))
    before = np.cumsum(hi - lo, axis=1)[r, q] - (hi - lo)[r, q]
    a, b = np.maximum(start[run], lo[r, q]), np.minimum(start[run] + length[run], hi[r, q])
    g = lo.sum(1) + before + a - lo[r, q]
    n = b - a
    some = n > 0
    run, w, a, g, n = run[some], w[some], a[some], g[some], n[some]
    full = rounds.total // sequence
    rest = rounds.total % sequence
    tail = [1 << k for k in range(sequence.bit_length() - 1, -1, -1) if rest >> k & 1]
    edges = full * sequence + np.cumsum(np.r_[0, tail]).astype(np.int64)

    def number(x):
        return np.where(x < full * sequence, x // sequence, full + np.searchsorted(edges, x, "right") - 1)

    def begin(s):
        return np.where(s < full, s * sequence, edges[np.clip(s - full, 0, len(edges) - 1)])

    s0, s1 = number(g), number(g + n - 1)
    k = s1 - s0 + 1
    i, s = np.repeat(np.arange(len(g)), k), ragged(s0, k)
    from_ = np.maximum(g[i], begin(s))
    to = np.minimum(g[i] + n[i], begin(s + 1))
    return run[i], a[i] - start[run[i]] + from_ - g[i], to - from_, s, from_ - begin(s), w[i]


def pack(scratch: Scratch, docs: DataFrame, tokenizer: str, proportions: dict[str | None, float] | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source", sequence: int = SEQUENCE, window: int = WINDOW, end_id: int = 0) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window.

    Every document is tokenized once, its end marked by `end_id`, and queued by source. Windows of
    `window` sequences take tokens of all queues in the given proportions (by default the queues'
    lengths, so that all run dry together). Ids stay in the task's own rows: what crosses the cluster
    is one length for each task and source. Null text: the end id alone. Null source: a queue of its
    own. Repeated rows: packed as often as they stand. Empty table: no rows. `tokenizer` is the path of
    a tokenizers file that each worker has.
    """

    def encode(batches):
        encoder = TextIds(tokenizer)
        block = TaskContext.get().partitionId()
        end = np.array([end_id], encoder.dtype)
        served: dict = {}
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                ids = encoder(part.column("text").cast(pa.string()))
                n, cum = [len(x) + 1 for x in ids], []
                for src, k in zip(part.column("src").to_pylist(), n):
                    cum.append(served.get(src, 0))
                    served[src] = cum[-1] + k
                out = pa.array([np.append(x, end).tobytes() for x in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, block)), part.column("src"), part.column("doc_id"), pa.array(n, pa.int64()), pa.array(cum, pa.int64()), out], names=["block", "src", "doc_id", "n", "cum", "ids"])
            release()

    src = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n")).alias("src")
    rows = docs.select(src, F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    coded = scratch.write(rows.mapInArrow(encode, "block long, src string, doc_id long, n long, cum long, ids binary"), "ids")
    parts = scratch.write(coded.groupBy("block", "src").agg(F.sum("n").alias("n")), "parts")
    sums = parts.groupBy("src").agg(F.sum("n").alias("n"))
    top = scratch.write(sums.orderBy(F.desc("n"), "src").limit(QUEUES - 1).select("src"), "top")
    own = sorted(r["src"] for r in top.collect())
    queue = scratch.spark.createDataFrame([(s, i) for i, s in enumerate(own)], "src string, queue int")
    queued = parts.join(F.broadcast(queue), "src", "left").withColumn("queue", F.coalesce("queue", F.lit(len(own))))
    before = F.sum("n").over(Window.partitionBy("queue").orderBy("src", "block").rowsBetween(Window.unboundedPreceding, -1))
    base = scratch.write(queued.select("block", "src", "queue", F.coalesce(before, F.lit(0)).alias("base")), "bases")
    held = {r["queue"]: r["n"] for r in queued.groupBy("queue").agg(F.sum("n").alias("n")).collect()}
    lengths = np.array([held.get(q, 0) for q in range(max(held, default=-1) + 1)], np.int64)
    if not len(lengths):
        lengths = np.ones(1, np.int64)
    share = lengths.astype(np.float64)
    if proportions:
        asked = {"n" if s is None else f"s{s}": p for s, p in proportions.items()}
        share = np.array([max(asked.get(s, 0.0), 1e-9) for s in own] + [max(sum(p for s, p in asked.items() if s not in set(own)), 1e-9)] * (len(lengths) - len(own)))
    rounds = Rounds(lengths, share, window * sequence)
    id_type = TextIds(tokenizer).dtype

    def cut(batches):
        for b in batches:
            if not b.num_rows:
                continue
            queue, n = b.column("queue").to_numpy(), b.column("n").to_numpy()
            start = b.column("base").to_numpy() + b.column("cum").to_numpy()
            run, at, length, seq, off, w = place_pieces(rounds, queue, start, n, sequence)
            texts = b.column("ids")
            crc = np.empty(len(run), np.int64)
            last, ids = -1, None
            for k, (i, x, y) in enumerate(zip(run.tolist(), at.tolist(), (at + length).tolist())):
                if i != last:
                    last, ids = i, np.frombuffer(texts[i].as_py(), id_type).astype("<u4")
                crc[k] = zlib.crc32(ids[x:y].tobytes())
            doc = b.column("doc_id").take(pa.array(run))
            yield pa.RecordBatch.from_arrays([doc, *map(pa.array, (at, length, crc, n[run], seq, off, w))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window"])

    return coded.join(base, ["block", "src"]).select("doc_id", "queue", "n", "cum", "base", "ids").mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window long")
