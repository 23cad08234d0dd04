"""The gap filter on a stream: the only state of a video is the last time kept."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def stream_gap_filter(times: DataFrame, gap: float, video: str = "video_id", ts: str = "ts") -> DataFrame:
    """times (video, ts) that are at least `gap` after the last one kept. Times must not run backwards from batch
    to batch; inside a batch they are sorted. State is one number a video."""

    def step(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        kept = []
        for t in sorted(x for p in parts for x in p[ts]):
            t = round(float(t), 3)
            if last is None or t - last >= gap:
                kept.append(t)
                last = t
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({video: [key[0]] * len(kept), ts: kept})

    return times.groupBy(video).applyInPandasWithState(step, f"{video} long, {ts} double", "last double", "append", "NoTimeout")
