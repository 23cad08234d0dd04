"""The interval join of frames and segments as two streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _clock(seconds):
    return F.timestamp_millis(F.rint(seconds * 1000).cast("long"))


def stream_attach_segments(frames: DataFrame, segments: DataFrame, tolerance: float = 4.0, longest: float = 600.0, delay: str = "10 seconds", video: str = "video_id") -> DataFrame:
    """(video, idx, ts, segment): a row for each segment (seg_idx, start, end, speaker, text) of a frame (idx, ts), as the batch
    join attaches them, and one with a null segment for a frame that has none.

    Both streams carry seconds of a common clock and a watermark of `delay`. Segments last at most `longest` seconds
    (longer ones are left out), so a frame meets only segments that start within that time of it: this bound and the
    watermarks tell when a row can meet no more, and its state goes. A frame without a segment comes out then.
    """
    reach = longest + tolerance
    f = frames.select(F.col(video).alias("__v"), "idx", "ts", _clock(F.col("ts")).alias("__at")).withWatermark("__at", delay)
    seg = F.struct("seg_idx", "start", "end", "speaker", "text").alias("segment")
    s = segments.where((F.col("end") - F.col("start")).between(0, longest)).select(F.col(video).alias("__w"), _clock(F.col("start")).alias("__from"), seg).withWatermark("__from", delay)
    start, end, ts = F.col("segment.start"), F.col("segment.end"), F.col("ts")
    near = (F.abs((start + end) / 2 - ts) <= tolerance) | ts.between(start, end)
    back, on = (F.expr(f"interval {int(x) + 1} seconds") for x in (reach, tolerance))
    window = (F.col("__from") >= F.col("__at") - back) & (F.col("__from") <= F.col("__at") + on)
    return f.join(s, (F.col("__v") == F.col("__w")) & window & near, "left_outer").select(F.col("__v").alias(video), "idx", "ts", "segment")
