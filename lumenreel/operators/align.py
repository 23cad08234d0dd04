"""Interval and tolerance joins. Time is cut into cells, so each join is an equi-join on (video, cell).

Intervals of very unlike length go into a dyadic grid: cells of level l are 2^l times as wide as those of level 0, an
interval stands in the few cells it touches on the first level whose cells are as long as itself, and a point looks
into one cell of each level that is in use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of the dyadic grid; what is longer than a cell of the last but one stands in the one cell of the last.
TOP = 48


def _cell(x: Column, width: float) -> Column:
    return F.floor(x / width).cast("long")


def _grid_cell(x: Column, level: Column, width: float) -> Column:
    return F.when(level >= TOP, F.lit(0).cast("long")).otherwise(F.floor(x / (F.lit(width) * F.pow(F.lit(2.0), level))).cast("long"))


def deal_intervals(rows: DataFrame, low: Column, high: Column, width: float) -> DataFrame:
    """rows with __level and __cell, one row for each cell of its level that [low, high] touches: at most three, however
    long the interval is. Intervals without a length, or with an end that is null or not a number, are left out."""
    span = high - low
    level = F.when(span <= width, 0).otherwise(F.least(F.lit(TOP), F.ceil(F.log2(span / width)))).cast("int")
    some = rows.withColumns({"__low": low, "__high": high}).where("__low <= __high and not isnan(__low) and not isnan(__high)")
    some = some.withColumn("__level", level)
    ends = [_grid_cell(F.col(c), F.col("__level"), width) for c in ("__low", "__high")]
    return some.withColumn("__cell", F.explode(F.sequence(*ends))).drop("__low", "__high")


def deal_points(rows: DataFrame, at: str, dealt: DataFrame, width: float) -> DataFrame:
    """rows with __level and __cell, one row for each level that the dealt intervals use."""
    levels = dealt.select(F.collect_set("__level")).scalar()
    return rows.withColumn("__level", F.explode(levels)).withColumn("__cell", _grid_cell(F.col(at), F.col("__level"), width))


def attach_segments(frames: DataFrame, segments: DataFrame, tolerance: float = 4.0, video: str = "video_id") -> DataFrame:
    """frames (video, idx, ts) with the array of segments (seg_idx, start, end, speaker, text) whose middle is
    within the tolerance or that hold the frame, in order; no segment gives an empty array.

    A segment with its band around the middle stands in at most three cells of a dyadic grid, whose narrowest cells are
    twice the tolerance wide; a frame looks into one cell a level. So a video of any length spreads out, and a
    segment of any length, an endless one too, makes a few rows. Segments whose ends are swapped match by
    their middle only; those with an end that is null or not a number match nothing.
    """
    width = max(2 * tolerance, 1e-3)
    middle = (F.col("start") + F.col("end")) / 2
    some = segments.where("not isnan(start) and not isnan(end)")
    ok = ~F.isnan(middle)  # two infinite ends have no middle
    low = F.when(ok, F.least(F.col("start"), middle - tolerance)).otherwise(F.col("start"))
    high = F.when(ok, F.greatest(F.col("end"), middle + tolerance)).otherwise(F.col("end"))
    dealt = deal_intervals(some, low, high, width)
    seg = F.struct("seg_idx", "start", "end", "speaker", "text").alias("__seg")
    dealt = dealt.select(F.col(video), "__level", "__cell", seg)
    s = F.col("__seg")
    near = (F.abs((s["start"] + s["end"]) / 2 - F.col("ts")) <= tolerance) | F.col("ts").between(s["start"], s["end"])
    keyed = deal_points(frames.select(video, "idx", "ts").where("not isnan(ts)"), "ts", dealt, width)
    met = keyed.join(dealt, [video, "__level", "__cell"]).where(near).groupBy(video, "idx").agg(F.array_sort(F.collect_list("__seg")).alias("segments"))
    empty = F.array().cast(met.schema["segments"].dataType)
    return frames.join(met, [video, "idx"], "left").withColumn("segments", F.coalesce("segments", empty))


def first_within(frames: DataFrame, items: DataFrame, value: str, tolerance: float = 0.3, video: str = "video_id") -> DataFrame:
    """frames with the value of the first item (by pos, not the nearest) within the tolerance, else null."""
    width = max(2 * tolerance, 1e-3)
    cells = F.sequence(_cell(F.col("ts") - tolerance, width), _cell(F.col("ts") + tolerance, width))
    dealt = items.select(video, F.explode(cells).alias("__cell"), F.col("ts").alias("__ts"), F.col("pos").alias("__pos"), F.col(value).alias("__value"))
    keyed = frames.withColumn("__cell", _cell(F.col("ts"), width))
    hit = F.when(F.abs(F.col("__ts") - F.col("ts")) <= tolerance, F.struct("__pos", "__value"))
    best = keyed.join(dealt, [video, "__cell"]).groupBy(video, "idx").agg(F.min(hit).alias("__best"))
    return frames.join(best, [video, "idx"], "left").withColumn(value, F.col("__best.__value")).drop("__best")


def batch_texts(batches: DataFrame, texts: DataFrame, margin: float = 0.5, cell: float = 60.0, video: str = "video_id") -> DataFrame:
    """batches (video, batch, start, end) with the texts (pos, ts, text) inside, `margin` wider, in order.

    A batch stands in at most three cells of a dyadic grid, a text looks into one cell a level; a long video spreads
    over its cells, and a batch that is as long as the video makes a few rows."""
    dealt = deal_intervals(batches.select(video, "batch", "start", "end"), F.col("start") - margin, F.col("end") + margin, cell)
    keyed = deal_points(texts.select(video, "pos", "ts", "text").where("not isnan(ts)"), "ts", dealt, cell)
    inside = F.col("ts").between(F.col("start") - margin, F.col("end") + margin)
    met = dealt.join(keyed, [video, "__level", "__cell"]).where(inside).groupBy(video, "batch").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("__found"))
    text = F.array_join(F.transform("__found", lambda s: s["text"]), "\n")
    return batches.join(met, [video, "batch"], "left").select(video, "batch", "start", "end", F.coalesce(text, F.lit("")).alias("evidence"))
