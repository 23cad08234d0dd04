"""Timeline operators over relative seconds; every one is partitioned by video."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenreel.functions import text as T


def round3(x: Column) -> Column:
    """Milliseconds, ties to even."""
    return F.rint(x * 1000) / 1000


def epsilon(d: Column) -> Column:
    return F.when(d <= 0, 0.001).otherwise(F.least(F.greatest(F.lit(0.5), d * 0.05), F.greatest(d / 2, F.lit(0.001))))


def safe_end(d: Column) -> Column:
    return F.greatest(d - epsilon(d), F.lit(0.0))


def budget(d: Column, sample_seconds: float, most: int) -> Column:
    asked = F.ceil(d / max(sample_seconds, 0.001))
    return F.when(d <= 0, 1).otherwise(F.greatest(F.lit(1), F.least(F.lit(most), asked))).cast("int")


def distinct_times(ts: Column) -> Column:
    return F.array_distinct(F.transform(ts, round3))


def gap_filter(ts: Column, gap: float) -> Column:
    """Keep the first time, then each that is at least `gap` after the last one kept."""
    keep = lambda kept, x: F.when((F.size(kept) == 0) | (x - F.element_at(kept, -1) >= gap), F.array_append(kept, x)).otherwise(kept)
    return F.aggregate(F.transform(ts, round3), F.array().cast("array<double>"), keep)


def anchored(ts: Column, d: Column) -> Column:
    both = F.array_sort(F.concat(F.array(F.lit(0.0)), ts, F.array(safe_end(d))))
    return F.when(d <= 0, F.array(F.lit(0.0))).otherwise(distinct_times(both))


def windows(videos: DataFrame, duration: str = "duration", n: str = "budget") -> DataFrame:
    """One row a coverage window: idx, w_start, w_end, center."""
    d, k = F.col(duration), F.col(n)
    single = (d <= 0) | (k <= 1)
    out = videos.withColumn("idx", F.explode(F.sequence(F.lit(0), F.when(single, 0).otherwise(k - 1))))
    size = d / k
    start = F.when(single, 0.0).otherwise(F.col("idx") * size)
    end = F.when(single, F.greatest(d, F.lit(0.0))).otherwise(F.least(F.when(F.col("idx") == k - 1, d).otherwise((F.col("idx") + 1) * size), safe_end(d)))
    center = F.when(single, 0.0).otherwise(F.greatest(F.least(start + (end - start) / 2, safe_end(d)), F.lit(0.0)))
    return out.select("*", round3(start).alias("w_start"), round3(F.greatest(end, start)).alias("w_end"), round3(center).alias("center"))


def _candidate_videos(candidates: DataFrame, videos: DataFrame | None, sample_seconds: float, most: int, video: str, ts: str) -> tuple[DataFrame, DataFrame]:
    """(candidates with duration and budget; one row a video with duration, budget and the pool of all its candidates)."""
    pool = distinct_times(F.array_sort(F.collect_set("ts"))).alias("pool")
    if videos is None:
        d = F.max(ts).over(Window.partitionBy(video))
        c = candidates.select(video, F.col(ts).alias("ts"), d.alias("duration")).withColumn("budget", budget(F.col("duration"), sample_seconds, most))
        return c, c.groupBy(video).agg(F.max("duration").alias("duration"), F.max("budget").alias("budget"), pool)
    known = videos.select(video, F.coalesce(F.col("duration").cast("double"), F.lit(0.0)).alias("duration"))
    known = known.withColumn("budget", budget(F.col("duration"), sample_seconds, most))
    times = candidates.select(video, F.col(ts).alias("ts")).where("ts is not null")
    pools = times.groupBy(video).agg(pool)
    per = known.join(pools, video, "left").withColumn("pool", F.coalesce("pool", F.array().cast("array<double>")))
    return times.join(known, video), per


def coverage_choice(candidates: DataFrame, sample_seconds: float, most: int, video: str = "video_id", ts: str = "ts", videos: DataFrame | None = None) -> DataFrame:
    """(video, duration, budget, picks, pool): in each window the candidate nearest its center (the earlier of two),
    else the center; pool holds all candidates.

    `videos` (video, duration) says how long each video is and which there are: those without candidates get the
    centers of their windows, candidates of other videos and those after the end choose nothing, a null duration
    counts as zero. Without it a video lasts until its last candidate.

    A candidate's window follows from its time, so no range join is needed: candidates meet the windows of their video by
    number.
    """
    c, per_video = _candidate_videos(candidates, videos, sample_seconds, most, video, ts)
    wide = F.col("duration") / F.col("budget")
    at = F.when((F.col("duration") <= 0) | (F.col("budget") <= 1), 0).otherwise(F.least(F.floor(F.col("ts") / wide), F.col("budget") - 1)).cast("int")
    near = c.withColumn("idx", F.explode(F.array_distinct(F.array(F.greatest(at - 1, F.lit(0)), at, F.least(at + 1, F.col("budget") - 1)))))
    edge = windows(per_video).select(video, "duration", "budget", "idx", "w_start", "w_end", "center")
    meet = near.select(video, "idx", "ts").join(edge, [video, "idx"])
    inside = F.col("ts").between(F.col("w_start"), F.col("w_end")) | ((F.col("idx") == F.col("budget") - 1) & F.col("ts").between(F.col("w_start"), F.col("duration")))
    best = meet.where(inside).groupBy(video, "idx").agg(F.min(F.struct(F.abs(F.col("ts") - F.col("center")).alias("far"), F.col("ts").alias("ts"))).alias("best"))
    chosen = edge.join(best, [video, "idx"], "left").withColumn("pick", round3(F.coalesce("best.ts", "center")))
    per = chosen.groupBy(video).agg(F.array_sort(F.collect_list("pick")).alias("picks"))
    return per_video.join(per, video).select(video, "duration", "budget", "picks", "pool")


def cover(candidates: DataFrame, sample_seconds: float, most: int, video: str = "video_id", ts: str = "ts", videos: DataFrame | None = None) -> DataFrame:
    """(video, duration, budget, times): the choice of each window, without filling, with both anchors."""
    per = coverage_choice(candidates, sample_seconds, most, video, ts, videos)
    return per.select(video, "duration", "budget", anchored(F.col("picks"), F.col("duration")).alias("times"))


def scene_sampling(candidates: DataFrame, sample_seconds: float, most: int, video: str = "video_id", ts: str = "ts", videos: DataFrame | None = None) -> DataFrame:
    """(video, duration, budget, times): the choice of each window, widest gaps filled up to the budget, with both
    anchors, which come on top of the budget."""
    per = coverage_choice(candidates, sample_seconds, most, video, ts, videos)
    full = fill_gaps(F.col("picks"), F.col("duration"), F.col("budget"), F.col("pool"))
    return per.select(video, "duration", "budget", anchored(full, F.col("duration")).alias("times"))


def uniform_times(duration: Column, sample_seconds: float, most: int) -> Column:
    """Times without candidates: the centers of as many equal windows as the budget allows, gaps filled."""
    n = budget(duration, sample_seconds, most)
    size, end = duration / n, safe_end(duration)
    low = lambda i: i * size
    high = lambda i: F.least(F.when(i == n - 1, duration).otherwise((i + 1) * size), end)
    center = lambda i: round3(round3(F.greatest(F.least(low(i) + (high(i) - low(i)) / 2, end), F.lit(0.0))))
    picks = F.when(n <= 1, F.array(F.lit(0.0))).otherwise(F.transform(F.sequence(F.lit(0), n - 1), center))
    none = F.array().cast("array<double>")
    return F.when(duration <= 0, F.array(F.lit(0.0))).otherwise(fill_gaps(picks, duration, n, none))


def all_change_times(ts: Column, duration: Column, gap: float) -> Column:
    """All detected changes that are far enough apart, with both anchors."""
    return anchored(gap_filter(distinct_times(ts), gap), duration)


def without_anchors(ts: Column, duration: Column) -> Column:
    return F.array_except(ts, F.array(F.lit(0.0), round3(safe_end(duration))))


def sampling_label(duration: Column, frames: Column, mode: str, sample_seconds: float, most: int, scenes: bool, filtered: bool = False) -> Column:
    """How a video's frames were sampled, in words."""
    held = F.concat(F.lit("actual_frames="), frames.cast("string"), F.lit(", duration="), F.replace(F.format_number(duration, 2), F.lit(","), F.lit("")), F.lit("s"))
    if mode == "all-changes":
        return F.concat(F.lit("all-detected-changes" + ("-layout-filtered" if filtered else "") + " ("), held, F.lit(")"))
    n = F.concat(F.lit("(frame_budget="), budget(duration, sample_seconds, most).cast("string"), F.lit(", "), held)
    if scenes:
        return F.concat(F.lit("segment-coverage-scene-sampling "), n, F.lit(")"))
    return F.concat(F.lit("segment-coverage-uniform-sampling "), n, F.lit(f", sample_seconds={sample_seconds:.2f})"))


def fill_gaps(selected: Column, duration: Column, n: Column, pool: Column) -> Column:
    """Times with the middle of the widest gap added, or the candidate of the sorted pool nearest to it, until there are n;
    it ends at the first choice that is there already. A fold of at most n steps over one array a video."""
    end = safe_end(duration)
    first = F.array_sort(distinct_times(selected))
    have = F.when(F.size(first) > 0, first).otherwise(F.array(F.lit(0.0)))
    state = lambda have, stop: F.struct(have.alias("have"), stop.alias("stop"))

    def widest(have: Column) -> Column:
        """(gap, -left, left, right) of the widest gap, the earliest of several; null if there is none."""
        stops = F.array_sort(distinct_times(F.concat(F.array(F.lit(0.0)), have, F.array(end))))
        gap = lambda a, b: F.struct((b - a).alias("gap"), (-a).alias("early"), a.alias("left"), b.alias("right"))
        size = F.size(stops)
        gaps = F.when(size > 1, F.zip_with(F.slice(stops, 1, F.greatest(size - 1, F.lit(1))), F.slice(stops, 2, F.greatest(size - 1, F.lit(1))), gap))
        return F.array_max(F.filter(gaps, lambda g: g["gap"] > 0.001))

    def chosen(g: Column) -> Column:
        middle = (g["left"] + g["right"]) / 2
        inside = F.filter(pool, lambda t: t.between(g["left"], g["right"]))
        near = F.array_min(F.transform(inside, lambda t: F.struct(F.abs(t - middle).alias("far"), t.alias("t"))))
        return F.when(g.isNotNull(), round3(F.least(F.greatest(F.coalesce(near["t"], middle), F.lit(0.0)), end)))

    def step(s: Column, _: Column) -> Column:
        def added(pick: Column) -> Column:
            there = pick.isNull() | F.exists(s["have"], lambda t: F.abs(pick - t) <= 0.001)
            return F.when(there, state(s["have"], F.lit(True))).otherwise(state(F.array_sort(F.array_append(s["have"], pick)), F.lit(False)))

        return F.when(s["stop"] | (F.size(s["have"]) >= n), s).otherwise(T.let(T.let(widest(s["have"]), chosen), added))

    full = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), state(have, F.lit(False)), step)["have"]
    return F.when(duration <= 0, F.array(F.lit(0.0))).otherwise(F.slice(full, 1, n))


def representative(segments: DataFrame, most: int, video: str = "video_id", order: str = "seg_idx") -> DataFrame:
    """At most `most` segments of each video: all, every n-th, or head, even middle and tail; of the last kind those that
    repeat an earlier choice's (start, end, text) are left out, where the segments have these columns."""
    if most <= 0:  # only videos that have no more than that many segments, so none
        return segments.limit(0)
    w = Window.partitionBy(video)
    s = segments.withColumn("__n", F.count("*").over(w)).withColumn("__i", F.row_number().over(w.orderBy(order)) - 1)
    n, i = F.col("__n"), F.col("__i")
    if most <= 6:
        step = F.greatest(F.lit(1), F.floor(n / most))
        keep = (i % step == 0) & (i / step < most)
    else:
        side = min(8, most // 4)
        middle, pool = most - 2 * side, n - 2 * side
        spots = F.transform(F.sequence(F.lit(0), F.lit(middle - 1)), lambda j: F.rint(j * (pool - 1) / max(1, middle - 1)))
        keep = (i < side) | (i >= n - side) | (F.lit(middle) >= pool) | F.array_contains(spots, (i - side).cast("double"))
    s = s.where((n <= most) | keep)
    same = [c for c in ("start", "end", "text") if c in segments.columns]
    if most > 6 and len(same) == 3:
        s = s.withColumn("__again", F.row_number().over(Window.partitionBy(video, *same).orderBy(order))).where((n <= most) | (F.col("__again") == 1)).drop("__again")
    return s.drop("__n", "__i")


def representative_of(segments: Column, most: int) -> Column:
    """The same choice from an ordered array of segments (start, end, text) of one video."""
    n = F.size(segments)
    if most <= 0:
        return F.slice(segments, 1, 0)
    if most <= 6:
        step = F.greatest(F.lit(1), F.floor(n / most))
        return F.when(n <= most, segments).otherwise(F.filter(segments, lambda s, i: (i % step == 0) & (i / step < most)))
    side = min(8, most // 4)
    middle, pool = most - 2 * side, n - 2 * side
    spots = F.transform(F.sequence(F.lit(0), F.lit(middle - 1)), lambda j: F.rint(j * (pool - 1) / max(1, middle - 1)))
    some = F.filter(segments, lambda s, i: (i < side) | (i >= n - side) | (F.lit(middle) >= pool) | F.array_contains(spots, (i - side).cast("double")))
    same = lambda a, b: a["start"].eqNullSafe(b["start"]) & a["end"].eqNullSafe(b["end"]) & a["text"].eqNullSafe(b["text"])
    once = lambda all_: F.filter(all_, lambda s, i: ~F.exists(F.slice(all_, 1, i), lambda t: same(s, t)))
    return F.when(n <= most, segments).otherwise(T.let(some, once))


def batches(rows: DataFrame, size: int, video: str = "video_id", order: str = "idx") -> DataFrame:
    """Rows with the number of their batch of consecutive rows; size 0 or less: one batch."""
    at = F.row_number().over(Window.partitionBy(video).orderBy(order)) - 1
    return rows.withColumn("batch", F.floor(at / size).cast("int") if size > 0 else F.lit(0))
