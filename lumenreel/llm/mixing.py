"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenreel.llm.common import Scratch, n_words

#: Weights of the sources in order of code point, null last, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: No document is taken more often than this.
MOST = 3.0
#: Ranks are cut by radix: so many bins, then so many in the crossing bin, then exact order inside one.
BINS = 4096
#: Inside a source a document is wanted in proportion to this plus the binary digits of its number of words.
BASE_WANT = 8


@dataclass
class Mix:
    """Cuts by source: everything needed to tell a document's copies without another look at the corpus."""

    cuts: DataFrame
    seed: str

    def apply(self, docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
        """docs with __size, __source_size, __target, __expected and __copies; a narrow pass beside the table of cuts."""
        keyed = docs.withColumns({"__skey": _skey(source), "__size": n_words(text), "__draw": _draw(doc_id, source, text, self.seed)})
        out = keyed.withColumn("__digits", _digits(F.col("__size"))).join(self.cuts, ["__skey", "__digits"], "left")
        v = _pareto(F.col("__draw"), F.col("__frac"))
        b1, b2 = _bins(v)
        last = (v < F.col("__cut.v")) | ((v == F.col("__cut.v")) & (F.col("__draw") <= F.col("__cut.draw")))
        chosen = F.coalesce((b1 < F.col("__b1")) | ((b1 == F.col("__b1")) & ((b2 < F.col("__b2")) | ((b2 == F.col("__b2")) & last))), F.lit(False))
        return out.withColumn("__copies", (F.col("__whole") + chosen.cast("long")).cast("long")).drop("__skey", "__digits", "__draw", "__frac", "__whole", "__b1", "__b2", "__cut")


def _skey(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))


def _draw(doc_id: str, source: str, text: str, seed: str) -> Column:
    """32 hex digits drawn by what the row holds, so reruns agree wherever the row stands."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("~"))
    return F.md5(F.concat_ws("|", F.lit(seed), part(doc_id), part(source), F.md5(part(text))))


def _digits(size: Column) -> Column:
    """Binary digits of a number of words: the level that decides how much a document is wanted."""
    return F.length(F.bin(size)).cast("long")


def _pareto(draw: Column, frac: Column) -> Column:
    """Random odds over inclusion odds, Q, folded to Q / (1 + Q) in (0, 1)."""
    u = (F.conv(F.substring(draw, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    q = (u / (1 - u)) / (frac / (1 - frac))
    return F.when((frac > 0) & (frac < 1), q / (1 + q))


def _bins(v: Column) -> tuple[Column, Column]:
    b1 = F.floor(v * BINS)
    return b1, F.floor((v * BINS - b1) * BINS)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """Water-filling over (__skey, __source_size): shares by weight, none above most times its source.

    In order of most * size / weight, the sources that fill up come first; the rest share by weight
    what those leave. One row a source is all that meets here.
    """
    order = Window.partitionBy(F.lit(0)).orderBy("__skey_null", "__skey")
    s = sizes.withColumn("__skey_null", F.col("__skey") == "n").withColumn("__k", F.row_number().over(order) - 1)
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.col("__k"), F.lit(len(weights))) + 1).cast("int"))
    s = s.withColumn("__w", w).withColumn("__room", F.col("__source_size") * F.lit(most)).withColumn("__fill", F.col("__room") / F.col("__w"))
    whole = Window.partitionBy(F.lit(0))
    before = whole.orderBy("__fill", "__skey").rowsBetween(Window.unboundedPreceding, -1)
    after = whole.orderBy("__fill", "__skey").rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumns({"__all": F.sum("__source_size").over(whole).cast("double"), "__gone": F.coalesce(F.sum("__room").over(before), F.lit(0.0)), "__left_w": F.sum("__w").over(after)})
    s = s.withColumn("__level", (F.col("__all") - F.col("__gone")) / F.col("__left_w"))
    s = s.withColumn("__open", F.col("__level") < F.col("__fill"))
    level = F.min(F.when(F.col("__open"), F.struct("__fill", "__skey", "__level"))).over(whole)
    s = s.withColumn("__final", level["__level"])
    target = F.when(F.col("__final").isNull() | (F.col("__fill") <= F.col("__final")), F.col("__room")).otherwise(F.col("__w") * F.col("__final"))
    return s.select("__skey", "__source_size", target.cast("double").alias("__target"))


def expected(levels: DataFrame, most: float = MOST) -> DataFrame:
    """(__skey, __digits, __source_size, __target, __expected) of levels (..., __words): how often a document of a level
    is taken on average, in proportion to what its level is wanted and at most `most` times, so that the
    source's words are its target. A few dozen rows a source."""
    w = F.col("__digits") + BASE_WANT
    by = Window.partitionBy("__skey").orderBy(F.desc("__digits"))
    full = F.coalesce(F.sum("__words").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = F.sum(w * F.col("__words")).over(by.rowsBetween(0, Window.unboundedFollowing))
    scale = F.when(wanted > 0, (F.col("__target") - full * F.lit(most)) / wanted)
    s = levels.withColumn("__scale", scale)
    fits = F.when(F.col("__scale") * w < most, F.struct((-F.col("__digits")).alias("at"), F.col("__scale").alias("scale")))
    s = s.withColumn("__fit", F.min(fits).over(Window.partitionBy("__skey")))
    often = F.when(F.col("__source_size") <= 0, F.lit(0.0)).when(F.col("__fit").isNull(), F.lit(most)).otherwise(F.least(F.lit(most), F.col("__fit.scale") * w))
    return s.withColumn("__expected", often).drop("__scale", "__fit")


def mix(scratch: Scratch, docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id", weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: str = "mix-1") -> Mix:
    """Decide how often each document is taken, so that each source's words come near its target.

    Inside a source longer documents are wanted more: a document's expected copies grow with the binary
    digits of its number of words, up to `most`, and make up the target. The whole part is certain. The
    fractions are inclusion probabilities of a Pareto order sample: documents are ranked by random odds
    over inclusion odds and taken from the front until the words left of the target are reached (the last
    one if that comes nearer).

    The cut is found by radix over (source, bin) sums with map-side combine: no source is ever sorted
    or brought together, however large; what meets in one task is a row for each source. Null text: size 0.
    Null source: a source of its own, last. Empty table: no cuts, empty result. Rows alike in id, source and
    text share one draw, so all are taken or none.
    """
    rows = docs.select(_skey(source).alias("__skey"), n_words(text).alias("__size"), _draw(doc_id, source, text, seed).alias("__draw"))
    rows = scratch.write(rows.withColumn("__digits", _digits(F.col("__size"))), "draws")
    levels = scratch.write(rows.groupBy("__skey", "__digits").agg(F.sum("__size").alias("__words")), "levels")
    t = scratch.write(targets(levels.groupBy("__skey").agg(F.sum("__words").alias("__source_size")), weights, most), "targets")
    e = expected(levels.join(t, "__skey"), most).withColumn("__whole", F.floor("__expected"))
    e = scratch.write(e.withColumn("__frac", F.col("__expected") - F.col("__whole")), "expected")
    rest = e.groupBy("__skey").agg((F.first("__target") - F.sum(F.col("__whole") * F.col("__words"))).alias("__rest"))
    part = e.where("__frac > 0").select("__skey", "__digits", "__frac").join(rest, "__skey")
    ranked = rows.join(part, ["__skey", "__digits"]).withColumn("__v", _pareto(F.col("__draw"), F.col("__frac")))
    b1, b2 = _bins(F.col("__v"))
    ranked = ranked.withColumns({"__bin1": b1, "__bin2": b2})

    def crossing(sums: DataFrame, b: str) -> DataFrame:
        """The bin of each source in which the running words pass what is asked for."""
        run = F.sum("__words").over(Window.partitionBy("__skey").orderBy(b).rowsBetween(Window.unboundedPreceding, 0))
        c = sums.withColumn("__to", run).withColumn("__base", F.col("__to") - F.col("__words"))
        return c.where("__base < __rest and __to >= __rest")

    x1 = crossing(ranked.groupBy("__skey", "__bin1", "__rest").agg(F.sum("__size").cast("double").alias("__words")), "__bin1")
    x1 = scratch.write(x1.select("__skey", F.col("__bin1").alias("__b1"), (F.col("__rest") - F.col("__base")).alias("__rest1")), "cross1")
    in1 = ranked.drop("__rest").join(x1, "__skey").where("__bin1 = __b1").withColumnRenamed("__rest1", "__rest")
    x2 = crossing(in1.groupBy("__skey", "__bin2", "__rest").agg(F.sum("__size").cast("double").alias("__words")), "__bin2")
    x2 = scratch.write(x2.select("__skey", F.col("__bin2").alias("__b2"), (F.col("__rest") - F.col("__base")).alias("__rest2")), "cross2")
    in2 = in1.drop("__rest").join(x2, "__skey").where("__bin2 = __b2")
    order = Window.partitionBy("__skey").orderBy("__v", "__draw", "__size").rowsBetween(Window.unboundedPreceding, -1)
    taken = in2.withColumn("__before", F.coalesce(F.sum("__size").over(order), F.lit(0))).where("__before + __size / 2 <= __rest2")
    cut = taken.groupBy("__skey").agg(F.max(F.struct(F.col("__v").alias("v"), F.col("__draw").alias("draw"))).alias("__cut"))
    at = x1.select("__skey", "__b1").join(x2.select("__skey", "__b2"), "__skey", "left").join(cut, "__skey", "left")
    cuts = e.drop("__words").join(at, "__skey", "left")
    return Mix(scratch.write(cuts, "cuts"), seed)
