"""Greedy chains over long videos: keep a first row, then each first row that lies a gap beyond the last one kept.

What is kept depends on what was kept before, so a plain fold walks a whole video in one task. Here a video is cut
into cells some hundred gaps wide, which fold side by side: in a cell every row that could be the first one kept
there (those within a gap of its beginning) is followed to the last one kept. One row for each of these is all that a
walk over a video's cells needs to find where each cell is really entered; then the cells fold again from there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenreel.operators.timeline import round3

#: Width of a cell in gaps: at most so many rows of a cell are kept, and its summary is about this factor smaller.
STEPS = 256
#: Rows of a block whose sizes are summed together.
BLOCK = 65_536


def next_kept(at: np.ndarray, last: np.ndarray, gap: float) -> np.ndarray:
    """Of sorted `at` the first index whose distance from each `last` reaches the gap, len(at) if none does; by the same
    subtraction as a plain fold."""
    i = np.searchsorted(at, last + gap)
    wide = np.append(at, np.inf)
    while True:  # last + gap may be rounded the other way than at - last
        back = (i > 0) & (at[np.maximum(i - 1, 0)] - last >= gap)
        on = (i < len(at)) & (wide[i] - last < gap)
        if not (back | on).any():
            return i
        i = i - back + on


def follow(at: np.ndarray, start: np.ndarray, gap: float) -> np.ndarray:
    """Of sorted `at` the last one kept when the first one is at each index in `start`."""
    i = start
    while True:
        j = next_kept(at, at[i], gap)
        on = j < len(at)
        if not on.any():
            return at[i]
        i = np.where(on, np.minimum(j, len(at) - 1), i)


def chain(at: np.ndarray, start: int, gap: float) -> np.ndarray:
    """Indices of all rows kept from `start` on."""
    out = [start]
    while True:
        j = int(next_kept(at, at[out[-1:]], gap)[0])
        if j == len(at):
            return np.array(out)
        out.append(j)


def _sorted(t: pa.Table, at: str) -> tuple[pa.Table, np.ndarray]:
    t = t.sort_by(at)
    return t, t.column(at).to_numpy().astype(np.float64)


def kept_by_gap(rows: DataFrame, gap: float, video: str = "video_id", at: str = "at", steps: int = STEPS) -> DataFrame:
    """rows with kept, and since: the last value kept at or before the row.

    `at` orders a video's rows and is a double; equal values are kept or not together. Rows without a video or with an
    `at` that is null or not finite are left out; a gap of zero or less keeps all. Other columns come along unread. A task
    holds the rows of one cell, `steps` gaps wide; a walk over a video's cells holds one row at a time.
    """
    some = rows.where(F.col(video).isNotNull() & F.col(at).isNotNull() & (F.abs(F.col(at)) < float("inf")))
    if gap <= 0:
        return some.withColumn("kept", F.lit(True)).withColumn("since", F.col(at))
    dealt = some.withColumn("__cell", F.floor(F.col(at) / (gap * steps)))

    def summary(t: pa.Table) -> pa.Table:
        x = np.unique(t.column(at).to_numpy().astype(np.float64))
        entries = np.arange(min(len(x), int(next_kept(x, x[:1], gap)[0]) + 1))
        last = follow(x, entries, gap)
        one = lambda c: pa.chunked_array([pa.array([t.column(c)[0].as_py()] * len(entries), t.schema.field(c).type)])
        return pa.table({video: one(video), "__cell": one("__cell"), "entry": pa.array(x[entries]), "last": pa.array(last)})

    kind = dealt.schema[video].dataType.simpleString()
    entries = dealt.select(video, "__cell", at).groupBy(video, "__cell").applyInArrow(summary, f"`{video}` {kind}, __cell long, entry double, last double")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Where each cell is entered (null: nowhere), and the last value kept before it."""
        now = cell = before = last = entry = None
        for b in batches:
            out: dict[str, list] = {video: [], "__cell": [], "__entry": [], "__before": []}
            for v, c, e, x in zip(*(b.column(k).to_pylist() for k in (video, "__cell", "entry", "last"))):
                if v != now or c != cell:
                    if now is not None:
                        for k, y in zip(out, (now, cell, entry, before)):
                            out[k].append(y)
                    before = last if v == now else None
                    now, cell, entry, last = v, c, None, before
                if entry is None and (before is None or e - before >= gap):
                    entry, last = e, x
            yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in zip(out, kinds)], names=list(out))
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([y], t) for y, t in zip((now, cell, entry, before), kinds)], names=[video, "__cell", "__entry", "__before"])

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(dealt.schema[video].dataType), pa.int64(), pa.float64(), pa.float64()]
    ordered = entries.repartition(video).sortWithinPartitions(video, "__cell", "entry")
    entered = ordered.mapInArrow(walk, f"`{video}` {kind}, __cell long, __entry double, __before double")

    def fold(left: pa.Table, right: pa.Table) -> pa.Table:
        t, x = _sorted(left, at)
        entry, before = (right.column(c)[0].as_py() for c in ("__entry", "__before"))
        since = np.full(len(x), np.nan if before is None else before)
        if entry is not None:
            distinct = np.unique(x)
            taken = distinct[chain(distinct, int(np.searchsorted(distinct, entry)), gap)]
            place = np.searchsorted(taken, x, "right")
            since = np.where(place > 0, taken[np.maximum(place - 1, 0)], since)
        return t.drop_columns(["__cell"]).append_column("kept", pa.array(since == x)).append_column("since", pa.array(since))

    schema = some.withColumn("kept", F.lit(True)).withColumn("since", F.lit(0.0)).schema
    return dealt.groupBy(video, "__cell").cogroup(entered.groupBy(video, "__cell")).applyInArrow(fold, schema)


def gap_filter_rows(times: DataFrame, gap: float, video: str = "video_id", ts: str = "ts") -> DataFrame:
    """(video, ts): the times of each video in milliseconds that the gap filter keeps; for videos of any number of times."""
    distinct = times.select(video, round3(F.col(ts)).alias(ts)).distinct()
    return kept_by_gap(distinct, gap, video, ts).where("kept").select(video, ts)


def running_sums(rows: DataFrame, size: str, video: str, order: str, out: str) -> DataFrame:
    """rows with the sum of the sizes of all rows before them, in two levels: blocks of a video's rows by their whole number
    `order`, and rows inside a block."""
    dealt = rows.withColumn("__block", F.floor(F.col(order) / BLOCK))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    per = dealt.groupBy(video, "__block").agg(F.sum(size).alias("__n"))
    base = per.select(video, "__block", F.coalesce(F.sum("__n").over(upto(Window.partitionBy(video).orderBy("__block"))), F.lit(0)).alias("__base"))
    inside = F.coalesce(F.sum(size).over(upto(Window.partitionBy(video, "__block").orderBy(order))), F.lit(0))
    return dealt.withColumn("__in", inside).join(base, [video, "__block"]).withColumn(out, F.col("__base") + F.col("__in")).drop("__in", "__base", "__block")


def chunk_rows(segments: DataFrame, target: int = 420, video: str = "video_id", order: str = "seg_idx") -> DataFrame:
    """(video, chunk_idx, start, end, text) of segments (start, end, text), each with a text that is not empty: texts are
    joined until they hold `target` signs, then begin anew.

    A chunk is full where the running sum of lengths, one more each for the space, has grown by the target and one, so
    chunks begin where the gap filter keeps a row. A chunk's own segments are all that meets."""
    sized = segments.withColumn("__size", (F.length("text") + 1).cast("long"))
    at = running_sums(sized, "__size", video, order, "__at").withColumn("__at", F.col("__at").cast("double"))
    told = kept_by_gap(at, float(max(target, 0) + 1), video, "__at")
    said = F.array_sort(F.collect_list(F.struct(order, "text")))
    chunks = told.groupBy(video, "since").agg(F.min_by("start", order).alias("start"), F.max_by("end", order).alias("end"), F.array_join(F.transform(said, lambda s: s["text"]), " ").alias("text"))
    place = F.row_number().over(Window.partitionBy(video).orderBy("since")) - 1
    return chunks.select(video, place.alias("chunk_idx"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), "text")
