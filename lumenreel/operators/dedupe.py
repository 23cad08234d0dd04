"""Order-dependent near-duplicate folds. The sequence ratio has no native counterpart: it runs in Python,
after equality and containment, which are cheaper."""

from __future__ import annotations


from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenreel.functions import text as T
from lumenreel.functions.rules import PLAIN, RulePack

LOOKBACK = 12


def ratio(a: str, b: str) -> float:
    """Of argument order and long-text heuristics as the standard matcher has them."""
    return SequenceMatcher(None, a, b).ratio()


def title_difference(a, b) -> float:
    """1 - overlap of tokens or 1 - sequence ratio, the larger; rows carry title_tokens and title_meaning."""
    if a.title_meaning == b.title_meaning:
        return 0.0
    x, y = set(a.title_tokens), set(b.title_tokens)
    apart = 1.0 - len(x & y) / (len(x | y) or 1)
    return max(apart, 1.0 - ratio(a.title_meaning, b.title_meaning))


def near(a: str, b: str, least: float = 0.9, hold: int = 8) -> bool:
    """Two texts without white space: equal, one in the other if both are long enough, or alike."""
    if not a or not b:
        return False
    if a == b or (min(len(a), len(b)) >= hold and (a in b or b in a)):
        return True
    most = 2 * min(len(a), len(b)) / (len(a) + len(b))
    return most >= least and ratio(a, b) >= least


def ocr_duplicate(a: str, seen: list[str]) -> bool:
    return not a or any(b and (a == b or (min(len(a), len(b)) >= 8 and ratio(a, b) >= 0.88)) for b in seen)


#: Buckets that characters are counted in.
KINDS = 64


def histograms(texts: list[str]) -> np.ndarray:
    """How many characters of each text fall in each bucket of code points."""
    lengths = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32) % KINDS
    owner = np.repeat(np.arange(len(texts)), lengths)
    return np.bincount(owner * KINDS + points, minlength=len(texts) * KINDS).reshape(-1, KINDS).astype(np.int32)


#: Characters of the grams that bound a ratio.
GRAM = 3


def grams(text: str) -> Counter:
    """How often each run of GRAM characters stands in a text."""
    return Counter(map("".join, zip(*(text[i:] for i in range(GRAM)))))


def grams_needed(n: int, m: int, least: float) -> int:
    """How many grams two texts of n and m characters share at least, if their ratio reaches `least`.

    What a sequence match pairs is a common subsequence, so of a text of n characters at most n - L are missing from it and m - L
    were put in, L being half of least * (n + m). Each missing one takes GRAM grams of the first text with it, each one put in
    GRAM - 1.
    """
    held = int(least * (n + m) / 2)
    one = lambda x, y: x - GRAM + 1 - GRAM * (x - held) - (GRAM - 1) * (y - held)
    return max(one(n, m), one(m, n))


class Kept:
    """Texts kept so far, the last `most` of them, with their lengths, histograms and grams.

    The characters that two texts share, bucket by bucket, are never fewer than those a sequence match can pair, so they
    bound its ratio from above, and so do the grams they share: the ratio is worked out only where both bounds reach the
    threshold. Histograms are compared only with those of texts whose lengths allow the ratio.
    """

    def __init__(self, least: float, hold: int, most: int | None = None, contained: bool = True):
        self.least, self.hold, self.contained, self.most = least, hold, contained, most
        self.texts: list[str] = []
        self.known: Counter = Counter()
        self.grams: list[Counter | None] = []
        self.sizes, self.counts, self.n = np.zeros(16, np.int64), np.zeros((16, KINDS), np.int32), 0

    def add(self, text: str, count: np.ndarray) -> None:
        if not text:
            return
        if self.n == self.most:  # the newest takes the place of the oldest
            at = self.next
            self.next = (at + 1) % self.most
            self.known[self.texts[at]] -= 1
            self.texts[at], self.grams[at] = text, None
        else:
            at, self.next = self.n, 0
            if at == len(self.sizes):
                self.sizes, self.counts = np.resize(self.sizes, 2 * at), np.resize(self.counts, (2 * at, KINDS))
            self.texts.append(text)
            self.grams.append(None)
            self.n += 1
        self.known[text] += 1
        self.sizes[at], self.counts[at] = len(text), count

    def alike(self, text: str, count: np.ndarray) -> bool:
        """Whether a text equals one of these, is inside one or the other way round, or has the ratio with one."""
        if not text or not self.n:
            return False
        if self.known[text] > 0:
            return True
        n = len(text)
        if self.contained and n >= self.hold and any(len(x) >= self.hold and (text in x or x in text) for x in self.texts):
            return True
        sizes = self.sizes[: self.n]
        near = 2.0 * np.minimum(sizes, n) / (sizes + n) >= self.least
        if not self.contained:
            near &= np.minimum(sizes, n) >= self.hold
        at = np.flatnonzero(near)
        if not len(at):
            return False
        shared = np.minimum(self.counts[at], count).sum(1)
        own = None
        for i in at[2.0 * shared / (sizes[at] + n) >= self.least].tolist():
            other = self.texts[i]
            need = grams_needed(n, len(other), self.least)
            if need > 0:
                own = grams(text) if own is None else own
                its = self.grams[i] = self.grams[i] or grams(other)
                if sum(min(c, its[g]) for g, c in own.items() if g in its) < need:
                    continue
            if ratio(text, other) >= self.least:
                return True
        return False


def bare(column: Column) -> Column:
    """The normal form that is compared: title text without white space."""
    return F.replace(T.title_text(column), F.lit(" "), F.lit(""))


def merge_lines(lines: DataFrame, video: str = "video_id", order: str = "pos", line: str = "line") -> DataFrame:
    """Lines in order, without those near one of the twelve lines kept last. Normal forms are made before the
    fold, which streams over partitions sorted by video: its state is twelve lines, however long a video is."""
    keyed = lines.where(F.col(line) != "").withColumn("__bare", bare(F.col(line)))
    dealt, columns = keyed.repartition(video).sortWithinPartitions(video, order), lines.columns

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, Kept(0.9, 8, LOOKBACK)
        for batch in batches:
            texts, kept = batch.column("__bare").to_pylist(), []
            for i, (v, b, count) in enumerate(zip(batch.column(video).to_pylist(), texts, histograms(texts))):
                if v != now:
                    now, held = v, Kept(0.9, 8, LOOKBACK)
                if not held.alike(b, count):
                    kept.append(i)
                    held.add(b, count)
            yield batch.select(columns).take(pa.array(kept, pa.int64()))

    bound_batches(lines.sparkSession)
    return dealt.mapInArrow(fold, lines.schema)


def diverse_frames(frames: DataFrame, limit: int = 8, video: str = "video_id") -> DataFrame:
    """frames (ts, score, lines) of each video by score, density and number of lines (of several the earliest), skipping
    those like one that was chosen, up to the limit.

    A fold over partitions sorted by video and rank: it holds at most `limit` texts, and skips what is left of a video once
    it has these, so a video of any number of frames takes no more memory."""
    ready = frames.withColumn("__density", T.document_density(F.col("lines"))).withColumn("__n", F.size("lines"))
    ready = ready.withColumn("__bare", bare(F.array_join(F.slice("lines", 1, 12), "\n")))
    columns = frames.columns
    dealt = ready.repartition(video).sortWithinPartitions(video, F.desc("score"), F.desc("__density"), F.desc("__n"), "ts")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, n = None, Kept(0.9, 30), 0
        for batch in batches:
            texts, chosen = batch.column("__bare"), []
            for i, v in enumerate(batch.column(video).to_pylist()):
                if v != now:
                    now, held, n = v, Kept(0.9, 30), 0
                if n < limit:
                    b = texts[i].as_py()
                    count = histograms([b])[0]
                    if not held.alike(b, count):
                        chosen.append(i)
                        held.add(b, count)
                        n += 1
            if chosen:
                yield batch.select(columns).take(pa.array(chosen))

    bound_batches(frames.sparkSession)
    return dealt.mapInArrow(fold, frames.schema)


def bound_batches(spark: SparkSession) -> None:
    """Batches handed to Python are cut by bytes too, so frames of many lines do not fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def region_lines(lines: DataFrame, video: str = "video_id", terms: list[str] = ()) -> DataFrame:
    """Recognised lines (frame_idx, region_no, pos, line) of each frame that are useful and not like any that was kept
    before, in this region or an earlier one. A fold over partitions sorted by frame; it holds the lines of one frame, which are
    few."""
    ready = lines.where(T.useful_line(F.col("line"), terms)).withColumn("__bare", bare(F.col("line")))
    dealt, columns = ready.repartition(video, "frame_idx").sortWithinPartitions(video, "frame_idx", "region_no", "pos"), lines.columns

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = None, None
        for batch in batches:
            texts, kept = batch.column("__bare").to_pylist(), []
            for i, (v, f, b, count) in enumerate(zip(batch.column(video).to_pylist(), batch.column("frame_idx").to_pylist(), texts, histograms(texts))):
                if (v, f) != now:
                    now, seen = (v, f), Kept(0.88, 8, contained=False)
                if b and not seen.alike(b, count):
                    kept.append(i)
                    seen.add(b, count)
            yield batch.select(columns).take(pa.array(kept, pa.int64()))

    bound_batches(lines.sparkSession)
    return dealt.mapInArrow(fold, lines.schema)


def frame_text(texts: DataFrame, video: str = "video_id", pack: RulePack = PLAIN) -> DataFrame:
    """(video, frame_idx, text) of recognised texts (frame_idx, region_no, region, text): the fresh lines of each region
    below its name, regions in order; frames without any are left out."""
    cut = texts.select(video, "frame_idx", "region_no", "region", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    cut = cut.withColumn("line", T.kept(T.common_terms(T.ocr_text(F.col("line")), pack), lambda x: x != ""))
    fresh = region_lines(cut, video, pack.useful_terms)
    blocks = fresh.groupBy(video, "frame_idx", "region_no", "region").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]).alias("lines"))
    block = F.concat(F.lit("["), F.col("region"), F.lit("]\n"), F.array_join("lines", "\n"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("region_no", block.alias("b")))), lambda x: x["b"]), "\n")
    return blocks.groupBy(video, "frame_idx").agg(whole.alias("text"))


def document_frames(frames: DataFrame, limit: int = 8, least: float = 0.48, video: str = "video_id", pack: RulePack = PLAIN) -> DataFrame:
    """Of frames (ts, lines) those that are documents, with their score, and of these the best that are not alike."""
    score = T.kept(T.document_score(F.col("lines"), pack.document_terms, pack.control_terms), lambda s: T.document_candidate(F.col("lines"), s, least, pack))
    good = frames.withColumn("__score", score)
    return diverse_frames(good.withColumn("score", F.round("__score", 4)).drop("__score"), limit, video)


def merged_document(frames: DataFrame, video: str = "video_id") -> DataFrame:
    """(video, pos, line): the lines of the frames (ts, lines) in order of time, without those near one of the last twelve."""
    lines = frames.select(video, "ts", F.posexplode("lines").alias("at", "line")).withColumn("pos", F.struct("ts", "at"))
    return merge_lines(lines.select(video, "pos", "line"), video)
