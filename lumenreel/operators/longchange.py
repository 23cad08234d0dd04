"""The change filter inside long videos: parts of a video fold side by side and are joined where they agree.

What a frame is compared with depends on all that was kept before, so a plain fold walks a video in one task. Here each
part of a video first folds as if its own first frame were kept. Entered with the frame that really was kept last, a part
is read again only up to the first frame that both folds keep: from there on they are the same.

Where a part is entered follows from the parts before it. It is first taken to be the last frame that a part before kept
beyond its own first one; whoever turns out to be entered elsewhere is read again, until nobody is. Then each part's entry
is what the part before leaves, beginning with the video's first frame, so all are right. A part that keeps nothing hands
its entry on to the next at once, so a picture that stands still for hours takes no more rounds than any other.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenreel.functions import rules
from lumenreel.operators.layout import _DIFFS, _READ, frame_of, judged, rules_on

#: Seconds of a part.
SPAN = 600.0


def cut(df: DataFrame) -> DataFrame:
    """A table with its lineage cut by a checkpoint in the folder that the session names. Without one a local session gets
    a folder of its own; on a cluster that is an error."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def _ids(frame: Column) -> Column:
    return F.struct(frame["ts"], frame["__tie"])


def in_order(dealt: DataFrame, video: str, told: DataFrame | None = None) -> DataFrame:
    """Frames part by part in order of time, each part after the row that tells about it. Folds stream over this."""
    rows = dealt.withColumn("__told", F.lit(False))
    if told is not None:
        rows = rows.unionByName(told.withColumn("__told", F.lit(True)), allowMissingColumns=True)
    return rows.repartition(video, "__part").sortWithinPartitions(video, "__part", F.desc("__told"), "ts", "__tie")


def entered_parts(frames: DataFrame, on: dict, video: str = "video_id", span: float = SPAN) -> tuple[DataFrame, DataFrame, int]:
    """(frames by parts, a row for each part with the frame it is entered with and whether it is the first or last of its
    video, number of rounds)."""
    some = frames.where(F.col(video).isNotNull() & F.col("ts").isNotNull()).select(video, *_READ)
    dealt = some.withColumns({"ts": F.col("ts").cast("double"), "__tie": F.xxhash64(*_READ), "__part": F.floor(F.col("ts") / span)})
    kind = {f.name: f.dataType.simpleString() for f in dealt.schema.fields}
    key, held = [video, "__part"], [*_READ, "__tie"]
    typed = lambda names, mark="": ", ".join(f"`{mark}{c}` {kind[c]}" for c in names)

    def alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of each part the places that it keeps when its first frame is kept, and the last frame kept."""
        now = last = raw = None
        kept, n, names = [], 0, [*key, "kept", "n", *(f"x_{c}" for c in held)]
        for pdf in batches:
            out = []
            for v, part, tie, *values in zip(*(pdf[c] for c in (*key, "__tie", *_READ))):
                if now != (v, part):
                    if now:
                        out.append((*now, kept, n, *raw))
                    now, last, kept, n = (v, part), None, [], 0
                row = frame_of(values)
                if last is None or judged(last, row, on)[1]:
                    kept.append(n)
                    last, raw = row, (*values, tie)
                n += 1
            if out:
                yield pd.DataFrame(out, columns=names)
        if now:
            yield pd.DataFrame([(*now, kept, n, *raw)], columns=names)

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The frame that each part leaves when it is entered with the frame told; no row for a part that keeps none."""
        now = last = raw = first = None
        n, met, names = 0, False, [*key, *(f"x_{c}" for c in held)]
        for pdf in batches:
            out = []
            for v, part, told, kept, tie, *values in zip(*(pdf[c] for c in (*key, "__told", "kept", "__tie", *_READ))):
                if told:
                    if raw:
                        out.append((*now, *raw))
                    now, last, raw, first, n, met = (v, part), frame_of(values), None, set(kept), 0, False
                    continue
                if not met:
                    row = frame_of(values)
                    if judged(last, row, on)[1]:
                        last, raw, met = row, (*values, tie), n in first
                elif n in first:
                    raw = (*values, tie)
                n += 1
            if out:
                yield pd.DataFrame(out, columns=names)
        if raw:
            yield pd.DataFrame([(*now, *raw)], columns=names)

    leaves = F.when(F.col("x_ts").isNotNull(), F.struct(*[F.col(f"x_{c}").alias(c) for c in held])).alias("leaves")
    w = Window.partitionBy(video).orderBy("__part")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    found = in_order(dealt, video).mapInPandas(alone, f"{typed(key)}, kept array<int>, n int, {typed(held, 'x_')}").select(*key, "kept", "n", leaves)
    ends = {"first": F.lag("kept").over(w).isNull(), "final": F.lead("kept").over(w).isNull()}
    parts = found.withColumns(ends).withColumn("leaves", F.when(F.col("first") | (F.size("kept") > 1), F.col("leaves")))
    parts, rounds = cut(parts.withColumn("used", F.lit(None).cast(parts.schema["leaves"].dataType))), 0
    while True:
        told = parts.withColumn("entry", F.last("leaves", ignorenulls=True).over(before))
        told = cut(told.withColumn("moved", ~F.col("first") & ~_ids(F.col("entry")).eqNullSafe(_ids(F.col("used")))))
        moved = told.where("moved")
        if moved.isEmpty():
            return dealt, told, rounds
        rounds += 1
        reread = dealt.join(moved.select(*key), key, "left_semi")
        fresh = in_order(reread, video, moved.select(*key, "kept", "entry.*")).mapInPandas(again, f"{typed(key)}, {typed(held, 'x_')}").select(*key, leaves)
        parts = moved.drop("leaves").join(fresh, key, "left").unionByName(told.where("not moved")).withColumn("used", F.col("entry")).drop("entry", "moved")


def change_filter(frames: DataFrame, video: str = "video_id", layout: float = rules.LAYOUT_THRESHOLD, title_gap: float = rules.TITLE_THRESHOLD, title: bool = False, nav: bool = False, presenter: bool = False, dedupe: bool = False, span: float = SPAN) -> DataFrame:
    """What `layout.change_filter` returns, for videos of any length: a task reads parts of `span` seconds and holds one frame. Frames
    without a video or a time are left out; of frames with one time the order is that of a hash."""
    on = rules_on(layout, title_gap, title, nav, presenter, dedupe)
    dealt, parts, _ = entered_parts(frames, on, video, span)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, n, end = None, 0, None
        for pdf in batches:
            out = []
            for v, told, first, final, size, *values in zip(*(pdf[c] for c in (video, "__told", "first", "final", "n", *_READ))):
                if told:
                    last, n, end = None if first else frame_of(values), 0, size - 1 if final else None
                    continue
                row = frame_of(values)
                if last is None or n == end:
                    out.append((v, row["ts"], last and last["ts"], "kept-anchor", True, 0.0, *[0.0] * 7))
                else:
                    out.append((v, row["ts"], last["ts"], *judged(last, row, on)))
                if out[-1][4]:
                    last = row
                n += 1
            if out:
                yield pd.DataFrame(out, columns=[video, "ts", "last_ts", "keep_reason", "kept", "title_difference", *_DIFFS])

    entries = parts.select(video, "__part", "first", "final", "n", "entry.*")
    kind = dealt.schema[video].dataType.simpleString()
    shape = f"`{video}` {kind}, ts double, last_ts double, keep_reason string, kept boolean, title_difference double, " + ", ".join(f"{c} double" for c in _DIFFS)
    return in_order(dealt, video, entries).mapInPandas(fold, shape)
