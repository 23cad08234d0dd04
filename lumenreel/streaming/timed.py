"""The gap filter on a stream whose rows come late and out of order: equal to the batch operator over all rows in time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

#: The state store that this kind of operator needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _GapFilter(StatefulProcessor):
    """Of a video: the last time kept, and times that the watermark has not passed yet."""

    def __init__(self, gap: float, idle_ms: int, video: str, ts: str):
        self.gap, self.idle_ms, self.video, self.ts = gap, idle_ms, video, ts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", StructType([StructField("ts", DoubleType()), StructField("end", LongType())]))
        self.waiting = handle.getListState("waiting", StructType([StructField("ts", DoubleType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = [round(float(t), 3) for part in rows for t in part[self.ts]]
        self.waiting.appendList([(t,) for t in times])
        self.handle.registerTimer(round(max(times) * 1000))  # all that waits is older than some timer
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = [t for (t,) in self.waiting.get()]
        ready = sorted({t for t in waiting if round(t * 1000) <= passed})
        kept = []
        last, end = self.last.get() if self.last.exists() else (None, 0)
        for t in ready:
            if last is None or t - last >= self.gap:
                kept.append(t)
                last = t
        rest = [(t,) for t in waiting if round(t * 1000) > passed]
        if ready:
            self.waiting.put(rest) if rest else self.waiting.clear()
            end = round(ready[-1] * 1000) + self.idle_ms
            self.last.update((last, end))
            self.handle.registerTimer(end)
        elif not rest and passed >= end:
            self.last.clear()
        yield pd.DataFrame({self.video: [key[0]] * len(kept), self.ts: kept})


def timed_gap_filter(times: DataFrame, gap: float, delay: str = "10 seconds", idle: float = 86_400.0, video: str = "video_id", ts: str = "ts") -> DataFrame:
    """(video, ts) of the times that the gap filter keeps, on a stream of (video, ts), seconds of a common clock.

    A time waits until the watermark, the latest time of any video less the delay, has passed it; then a video's times
    are taken in order. So rows may come in any order within the delay, and what comes out is what the batch filter
    keeps. Rows later than that are dropped by the watermark. A video's state is the last time kept and what waits; it goes
    when the watermark is `idle` seconds past the video's last time, after which a new time begins the video anew. Null
    keys and times are left out. The session must use the state store PROVIDER.
    """
    some = times.where(F.col(video).isNotNull() & F.col(ts).isNotNull()).select(video, F.col(ts).cast("double").alias(ts))
    clock = some.withColumn("__event", F.timestamp_millis(F.rint(F.col(ts) * 1000).cast("long"))).withWatermark("__event", delay)
    schema = StructType([some.schema[video], StructField(ts, DoubleType())])
    return clock.groupBy(video).transformWithStateInPandas(_GapFilter(gap, int(idle * 1000), video, ts), schema, "append", "EventTime")
