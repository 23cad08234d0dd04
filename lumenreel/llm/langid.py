"""Language identification: words first, and for words not known progressively shorter character n-grams."""

from __future__ import annotations

import unicodedata
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenreel.llm.common import Scratch, bound_batches, ragged, release

#: At most so many rows of a language are learned from, those with the smallest hash of their id.
SAMPLE = 4_000
#: Words, and n-grams of each length, that a language contributes: its most frequent.
WORDS, GRAMS = 30_000, 10_000
#: Length of the longest n-gram that an unknown word is backed off to.
LONGEST = 5
#: Least count of a word or n-gram in one language to be known at all.
LEAST = 2
#: Natural log frequency of what a language lacks: one in ten million.
PENALTY = -7 * np.log(10)
#: Answer for a text that is null or has no letter, or if no language was learned.
UNKNOWN = "und"
#: A word: letters with the marks on them.
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: Characters of a batch's texts tokenised together.
TOGETHER = 8 << 20


def grams(word: str, n: int) -> list[str]:
    """The n-grams of a word with a space at both ends, those of one space alone left out."""
    padded = f" {word} "
    return [g for g in (padded[i : i + n] for i in range(len(padded) - n + 1)) if g != " "]


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(codes of the tokens of all texts in order, tokens of each text, distinct tokens), lower-cased; tokens are what white
    space sets apart."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(texts))
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    coded = lists.flatten().dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(lists.offsets.to_numpy()), coded.dictionary.to_pylist()


def _slices(texts: pa.Array):
    """Slices of about TOGETHER bytes; a longer text stands alone."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    at, end = 0, np.cumsum(size)
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + TOGETHER, "right")))
        yield slice(at, to)
        at = to


@lru_cache(1)
def _kinds() -> np.ndarray:
    """Of every code point: 1 a letter, 2 a mark, 0 neither."""
    return np.array([{"L": 1, "M": 2}.get(unicodedata.category(chr(i))[0], 0) for i in range(0x110000)], np.uint8)


def _points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, one after another, and the length of each."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32), np.array([len(w) for w in words], np.int64)


def letter_runs(points: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, start, length) of the words inside tokens: letters with the marks on them, as _LETTERS takes them."""
    kind = _kinds()[points]
    owner = np.repeat(np.arange(len(lengths)), lengths)
    some = kind > 0
    edge = np.r_[True, (some[1:] != some[:-1]) | (owner[1:] != owner[:-1])][: len(points)]
    start = np.flatnonzero(edge & some)
    ends = np.r_[np.flatnonzero(edge), len(points)]
    stop = ends[np.searchsorted(ends, start, "right")]
    letters = np.flatnonzero(kind == 1)
    at = np.searchsorted(letters, start)
    first = np.append(letters, len(points))[at]  # marks before the first letter belong to no word
    ok = first < stop
    return owner[start[ok]], first[ok], stop[ok] - first[ok]


_STEP = np.uint64(0x100000001B3)


def word_keys(points: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, a polynomial of its code points."""
    if not len(start):
        return np.zeros(0, np.uint64)
    power = np.r_[np.uint64(1), np.cumprod(np.full(int(lengths.max()), _STEP, np.uint64))]
    at = ragged(np.zeros(len(start), np.int64), lengths)
    terms = (points[ragged(start, lengths)].astype(np.uint64) + np.uint64(1)) * power[at]
    return np.add.reduceat(terms, np.r_[0, np.cumsum(lengths)[:-1]]) * np.uint64(0x9E3779B97F4A7C15) ^ lengths.astype(np.uint64)


def padded(points: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with a space at both ends: code points, the word each belongs to, and the code points left in the word."""
    size = lengths + 2
    ends = np.cumsum(size)
    buf = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint64)
    buf[ragged(ends - size + 1, lengths)] = points[ragged(start, lengths)]
    return buf, np.repeat(np.arange(len(size)), size), np.repeat(ends, size) - np.arange(len(buf))


def gram_keys(buf: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the n code points from each place; places too near the end are meaningless."""
    h = np.zeros(len(buf), np.uint64)
    for i in range(n):
        h[: len(buf) - i] = h[: len(buf) - i] * _STEP + (buf[i:] + np.uint64(1))
    return (h ^ np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Languages:
    """A model of bounded size: for words (level 0) and n-grams (level n) their sorted 64-bit hashes, and for each the natural
    log frequency in each language."""

    names: list[str]
    keys: list[np.ndarray]
    logs: list[np.ndarray]

    def _rows(self, level: int, keys: np.ndarray) -> np.ndarray:
        """The row of each key in a level, -1 if it is not known."""
        held = self.keys[level]
        if not len(held):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(held, keys), len(held) - 1)
        return np.where(held[at] == keys, at, -1)

    def _words(self, points: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether known, log frequency by language) of each word: its own, or the mean over its known n-grams of the longest
        length that has any."""
        out = np.zeros((len(start), len(self.names)))
        at = self._rows(0, word_keys(points, start, lengths))
        known = at >= 0
        out[known] = self.logs[0][at[known]]
        for n in range(len(self.keys) - 1, 0, -1):
            todo = np.flatnonzero(~known)
            if not len(todo):
                break
            buf, owner, left = padded(points, start[todo], lengths[todo])
            place = np.flatnonzero((left >= n) & ((buf != 32) if n == 1 else True))
            at = self._rows(n, gram_keys(buf, n)[place])
            hit = at >= 0
            owner, at = owner[place[hit]], at[hit]
            count = np.bincount(owner, minlength=len(todo))
            some = count > 0
            for k in range(len(self.names)):
                out[todo[some], k] = np.bincount(owner, self.logs[n][at, k], len(todo))[some] / count[some]
            known[todo[some]] = True
        return known, out

    def word(self, word: str) -> np.ndarray | None:
        """Log frequencies of one word; None if not one of its characters is known."""
        points, lengths = _points([word])
        known, out = self._words(points, np.zeros(1, np.int64), lengths)
        return out[0] if known[0] else None

    def log(self, level: int, text: str) -> np.ndarray | None:
        """Log frequencies of a known word (level 0) or n-gram."""
        at = self._rows(level, keys_of(level, [text]))[0]
        return self.logs[level][at] if at >= 0 else None

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """The language of each text, and how sure that is: its share of the likelihoods of all languages."""
        rows, width = len(texts), len(self.names)
        if not width:
            return [UNKNOWN] * rows, np.zeros(rows)
        letters, total = np.zeros(rows, bool), np.zeros((rows, width))
        codes, counts, words = tokens(texts)
        if len(codes):
            points, lengths = _points(words)
            token, start, size = letter_runs(points, lengths)
            _, scores = self._words(points, start, size)
            has = np.bincount(token, minlength=len(words)) > 0
            owner = np.repeat(np.arange(rows), counts)
            letters = np.bincount(owner, has[codes], rows) > 0
            for k in range(width):
                total[:, k] = np.bincount(owner, np.bincount(token, scores[:, k], len(words))[codes], rows)
        best = total.argmax(1)
        share = 1 / np.exp(total - total[np.arange(rows), best][:, None]).sum(1)
        return [self.names[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist())], np.where(letters, share, 0.0)


def keys_of(level: int, texts: list[str]) -> np.ndarray:
    """The hashes by which words (level 0) and n-grams of a level are known."""
    points, lengths = _points(texts)
    start = np.cumsum(lengths) - lengths
    return word_keys(points, start, lengths) if level == 0 else gram_keys(points.astype(np.uint64), level)[start]


def _model(names: list[str], found: list[dict[str, dict[int, float]]]) -> Languages:
    """Of the log frequencies by language number of each known word and n-gram."""
    keys, logs = [], []
    for level, held in enumerate(found):
        k = keys_of(level, list(held))
        table = np.full((len(held), len(names)), PENALTY)
        for row, by in zip(table, held.values()):
            for j, v in by.items():
                row[j] = v
        order = np.argsort(k, kind="stable")
        keys.append(k[order]), logs.append(table[order])
    return Languages(names, keys, logs)


def _top(counts: DataFrame, most: dict[bool, int]) -> DataFrame:
    """Of each language and level the most frequent, ties by code point; ranks are cut in each task before they meet."""
    place = F.row_number().over(Window.partitionBy("lang", "level").orderBy(F.desc("n"), "gram"))
    return counts.where(F.col("n") >= LEAST).withColumn("r", place).where(F.col("r") <= F.when(F.col("level") == 0, most[True]).otherwise(most[False]))


def _ends(rows: DataFrame, sample: int) -> dict[str, tuple[int, int]]:
    """For each language the (h, c) up to which it has `sample` rows; the largest pair if it has no more than these. Counts of
    4096 ranges of h tell the range in which a language ends; only rows of that range are ordered."""
    ranged = rows.withColumn("b", F.shiftright("h", 52))
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
    tally = ranged.groupBy("lang", "b").agg(F.count("*").alias("n")).withColumn("upto", upto)
    cut = F.min(F.when(F.col("upto") >= sample, F.struct("b", (sample - F.col("upto") + F.col("n")).alias("want"))))
    cuts = {r["lang"]: r["cut"] for r in tally.groupBy("lang").agg(cut.alias("cut")).collect()}  # one row a language
    most = (1 << 63) - 1
    ends = {k: (most, most) for k in cuts}
    some = [(k, c["b"], c["want"]) for k, c in cuts.items() if c is not None]
    if some:
        inside = ranged.join(F.broadcast(rows.sparkSession.createDataFrame(some, "lang string, b long, want long")), ["lang", "b"])
        place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "c"))
        inside = inside.withColumn("r", place).where(F.col("r") <= F.least("want", F.lit(sample))).groupBy("lang").agg(F.max(F.struct("h", "c")).alias("end"))
        ends |= {r["lang"]: (r["end"]["h"], r["end"]["c"]) for r in inside.collect()}
    return ends


def fit(scratch: Scratch, docs: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Languages:
    """Learn from rows with a text and a language: at most `sample` a language, those with the smallest hash of their id.

    Words are counted by language, n-grams over the counted words; both counts are combined in a task and then by key. The
    driver gets the most frequent of each, so the model has a size bounded by the number of languages. Rows with a
    null language or text teach nothing; whole texts are read; repeated rows count as often as they stand, but no more
    than `sample` rows of a language. Without rows there is no language.
    """
    bound_batches(scratch.spark)
    rows = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("lang is not null and text is not null")
    ends = _ends(rows.select("lang", F.xxhash64("id").alias("h"), F.xxhash64("text").alias("c")), sample)
    if not ends:
        return Languages([], [], [])
    names = sorted(ends)
    limit = scratch.spark.createDataFrame([(k, h, c) for k, (h, c) in ends.items()], "lang string, end_h long, end_c long")
    chosen = rows.join(F.broadcast(limit), "lang").where(F.struct(F.xxhash64("id"), F.xxhash64("text")) <= F.struct("end_h", "end_c")).select("lang", "text")

    def words(batches):
        for b in batches:
            langs = b.column("lang").to_pylist()
            for part in _slices(b.column("text")):
                codes, counts, dictionary = tokens(b.column("text")[part])
                split = [_LETTERS.findall(t) for t in dictionary]
                owner = np.repeat(np.unique(langs[part], return_inverse=True)[1], counts)
                kinds = np.unique(langs[part])
                pair, n = np.unique(owner * len(dictionary) + codes, return_counts=True)
                held: Counter = Counter()
                for p, m in zip(pair.tolist(), n.tolist()):
                    for w in split[p % len(dictionary)]:
                        held[p // len(dictionary), w] += m
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array([str(kinds[k]) for k, _ in held]), pa.array([w for _, w in held]), pa.array(list(held.values()), pa.int64())], names=["lang", "gram", "n"])
            release()

    def shorter(batches):
        for b in batches:
            for at in range(0, b.num_rows, 20_000):
                held: Counter = Counter()
                part = b.slice(at, 20_000)
                for k, w, m in zip(*(part.column(c).to_pylist() for c in ("lang", "gram", "n"))):
                    for n in range(1, LONGEST + 1):
                        for g in grams(w, n):
                            held[k, n, g] += m
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in held]), pa.array([n for _, n, _ in held], pa.int32()), pa.array([g for _, _, g in held]), pa.array(list(held.values()), pa.int64())], names=["lang", "level", "gram", "n"])
            release()

    known = scratch.write(chosen.mapInArrow(words, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("level", F.lit(0)).select("lang", "level", "gram", "n"), "words")
    short = known.select("lang", "gram", "n").mapInArrow(shorter, "lang string, level int, gram string, n long").groupBy("lang", "level", "gram").agg(F.sum("n").alias("n"))
    counts = scratch.write(known.unionByName(short), "counts")
    totals = {(r["lang"], r["level"]): r["n"] for r in counts.groupBy("lang", "level").agg(F.sum("n").alias("n")).collect()}
    wanted = scratch.write(_top(counts, {True: WORDS, False: GRAMS}).select("level", "gram").distinct(), "wanted")
    found: list[dict[str, dict[int, float]]] = [{} for _ in range(LONGEST + 1)]
    place = {k: i for i, k in enumerate(names)}
    for r in counts.join(wanted, ["level", "gram"], "left_semi").toLocalIterator(prefetchPartitions=True):
        log = np.log(r["n"] / totals[r["lang"], r["level"]])
        found[r["level"]].setdefault(r["gram"], {})[place[r["lang"]]] = max(PENALTY, log)
    scratch.drop(known, counts, wanted)
    return _model(names, found)


def predict(scratch: Scratch, docs: DataFrame, model: Languages, text: str = "text", out: str = "lang_pred", sure: str = "score") -> DataFrame:
    """docs with the language of every whole text and how sure that is, as last columns; one narrow pass.

    Null texts and those without a letter: `und`, 0. A text of letters that no language knows: the first language,
    at an even share. Only the text is looked at; repeated rows fare alike. Columns of docs that have the new names are
    replaced. Empty table: no rows.
    """
    bound_batches(scratch.spark)
    docs = docs.select([c for c in docs.columns if c not in (out, sure)])
    sent = scratch.spark.sparkContext.broadcast(model)
    schema = docs.select("*", F.lit("").alias(out), F.lit(0.0).alias(sure)).schema
    names = schema.names

    def predicted(batches):
        for b in batches:
            texts = b.column(names.index(text)).cast(pa.string())
            for part in _slices(texts):
                lang, score = sent.value.predict(texts[part].fill_null(""))
                yield pa.RecordBatch.from_arrays([*(c[part] for c in b.columns), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=names)
            release()

    return docs.mapInArrow(predicted, schema)
