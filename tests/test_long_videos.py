"""Intervals of any length, long videos folded in cells, and durations that candidates do not tell."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenreel.functions.rules import PLAIN
from lumenreel.operators import align, chains, report, speech, timeline

SEG = "video_id long, seg_idx int, start double, end double, speaker string, text string"


def segs(spark, rows):
    return spark.createDataFrame([(1, i, a, b, None, "x") for i, (a, b) in enumerate(rows)], SEG)


def brute_alignment(frames, rows, tolerance):
    return {i: [k for k, (a, b) in enumerate(rows) if a is not None and b is not None and (abs((a + b) / 2 - t) <= tolerance or a <= t <= b)] for i, t in enumerate(frames)}


INF, NAN = float("inf"), float("nan")
ODD = [(5.0, 1e8), (0.0, INF), (-INF, 3.0), (-INF, INF), (9.0, 2.0), (1e9, 1.0), (NAN, 4.0), (4.0, NAN), (None, 4.0), (4.0, None), (7.0, 7.0), (1e300, 1e300), (-1e300, 1e300), (0.0, 64.0), (63.999, 64.001)]


def test_segments_of_any_length(spark):
    times = [0.0, 2.5, 3.0, 7.0, 64.0, 1000.0, 1e8, 1e8 + 1, 1e12, -5.0]
    frames = spark.createDataFrame([(1, i, t) for i, t in enumerate(times)] + [(1, 98, None), (1, 99, NAN), (2, 97, 5.0)], "video_id long, idx int, ts double")
    got = {r["idx"]: [s["seg_idx"] for s in r["segments"]] for r in align.attach_segments(frames, segs(spark, ODD)).collect()}
    assert got == brute_alignment(times, ODD, 4.0) | {97: [], 98: [], 99: []}
    dealt = align.deal_intervals(segs(spark, ODD).where("start is not null and end is not null and not isnan(start) and not isnan(end)"), F.least("start", "end"), F.greatest("start", "end"), 8.0)
    assert max(r["n"] for r in dealt.groupBy("seg_idx").agg(F.count("*").alias("n")).collect()) <= 3
    assert dealt.select("seg_idx").distinct().count() == 11


def test_random_segments_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    rows = [(float(a), float(a + s * d)) for a, s, d in zip(rng.uniform(0, 5000, 300), rng.choice([-1, 1], 300, p=[0.1, 0.9]), 10 ** rng.uniform(-2, 5, 300))]
    times = [float(t) for t in rng.uniform(-50, 6000, 400)]
    frames = spark.createDataFrame([(1, i, t) for i, t in enumerate(times)], "video_id long, idx int, ts double").repartition(4)
    got = {r["idx"]: [s["seg_idx"] for s in r["segments"]] for r in align.attach_segments(frames, segs(spark, rows), 2.5).collect()}
    assert got == brute_alignment(times, rows, 2.5)


def test_no_segments(spark):
    frames = spark.createDataFrame([(1, 0, 5.0)], "video_id long, idx int, ts double")
    assert [r["segments"] for r in align.attach_segments(frames, segs(spark, []).limit(0)).collect()] == [[]]
    assert align.attach_segments(frames.limit(0), segs(spark, ODD)).count() == 0


def test_batches_of_any_length(spark):
    batches = spark.createDataFrame([(1, 0, 10.0, 20.0), (1, 1, 0.0, 1e9), (1, 2, 500.0, 500.0), (2, 3, 0.0, INF)], "video_id long, batch int, start double, end double")
    texts = spark.createDataFrame([(1, i, t, f"t{i}") for i, t in enumerate([9.5, 9.4, 20.5, 20.6, 500.5, 1e9])], "video_id long, pos int, ts double, text string")
    got = {r["batch"]: r["evidence"].split("\n") for r in align.batch_texts(batches, texts).collect()}
    assert got == {0: ["t0", "t2"], 1: ["t0", "t1", "t2", "t3", "t4", "t5"], 2: ["t4"], 3: [""]}


# --- chains -----------------------------------------------------------------------------------------------------


def greedy(times, gap):
    kept = []
    for t in sorted(set(times)):
        if not kept or t - kept[-1] >= gap:
            kept.append(t)
    return kept


@pytest.mark.parametrize("gap, steps", [(0.3, 1), (0.3, 2), (0.7, 3), (5.0, 2), (1000.0, 4), (0.001, 50)])
def test_chains_equal_the_fold(spark, monkeypatch, gap, steps):
    rng = np.random.default_rng(int(gap * 1000) + steps)
    videos = {1: np.round(rng.uniform(0, 40, 500), 1), 2: np.round(np.cumsum(rng.exponential(0.4, 300)), 3), 3: [7.0], 4: np.round(rng.uniform(-30, 30, 200), 2), 5: np.arange(400) * 0.1}
    rows = [(v, float(t), "clash") for v, ts in videos.items() for t in ts] + [(1, None, ""), (1, NAN, ""), (1, INF, ""), (None, 3.0, "")]
    df = spark.createDataFrame(rows, "video_id long, at double, note string").repartition(5)
    out = chains.kept_by_gap(df, gap, steps=steps).collect()
    for v, ts in videos.items():
        want = greedy([float(t) for t in ts], gap)
        mine = [r for r in out if r["video_id"] == v]
        assert sorted(r["at"] for r in mine) == sorted(float(t) for t in ts)  # repeated rows stay
        assert sorted({r["at"] for r in mine if r["kept"]}) == want
        assert all(r["since"] == max(k for k in want if k <= r["at"]) for r in mine)
    assert {r["note"] for r in out} == {"clash"} and len(out) == len(rows) - 4


def test_chains_of_nothing_and_of_no_gap(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 2.0)], "video_id string, at double")
    assert chains.kept_by_gap(df.limit(0), 1.0).count() == 0
    assert [r["kept"] for r in chains.kept_by_gap(df, 0.0).collect()] == [True] * 3


def test_native_fold_and_cells_agree(spark):
    rng = np.random.default_rng(9)
    rows = [(int(v), float(t)) for v, t in zip(rng.integers(0, 5, 3000), rng.uniform(0, 20_000, 3000))]
    df = spark.createDataFrame(rows, "video_id long, ts double")
    native = df.groupBy("video_id").agg(F.array_sort(F.collect_list("ts")).alias("ts")).select("video_id", F.explode(timeline.gap_filter(timeline.distinct_times(F.col("ts")), 9.0)).alias("ts"))
    cells = chains.gap_filter_rows(df, 9.0)
    assert sorted(map(tuple, native.collect())) == sorted(map(tuple, cells.collect()))


def test_a_video_of_a_million_times(spark):
    """One long video beside short ones: spread over cells, equal to the fold, in seconds."""
    n = 1_000_000
    at = F.col("id") * 0.5 + F.pmod(F.xxhash64("id"), F.lit(400)) / 1000
    df = spark.range(n).select(F.lit(1).alias("video_id"), F.round(at, 3).alias("ts"))
    began = time.time()
    got = chains.gap_filter_rows(df, 1.3).agg(F.count("*").alias("n"), F.sum("ts").alias("s")).first()
    took = time.time() - began
    x = np.unique(np.array(df.select("ts").toPandas()["ts"]))
    kept, last = [], -np.inf
    for t in x.tolist():
        if t - last >= 1.3:
            kept.append(t)
            last = t
    assert got["n"] == len(kept) and got["s"] == pytest.approx(sum(kept)) and took < 60
    cells = df.groupBy(F.floor(F.col("ts") / (1.3 * chains.STEPS))).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    assert cells < n / 500  # no task holds the video


def test_long_chunks_equal_the_fold(spark, monkeypatch):
    monkeypatch.setattr(chains, "BLOCK", 7)
    rng = np.random.default_rng(2)
    rows = [(int(v), i, float(i), float(i) + 0.5, None, "w" * int(rng.integers(1, 60))) for v in (1, 2, 3) for i in range(int(rng.integers(1, 400)))] + [(4, 0, 0.0, 1.0, None, "z" * 900)]
    s = spark.createDataFrame(rows, SEG)
    for target in (1, 100, 420):
        want = speech.chunks(s, target, pack=PLAIN).select("video_id", "chunk_idx", "start", "end", "text").collect()
        assert sorted(map(tuple, chains.chunk_rows(s, target).collect())) == sorted(map(tuple, want))


def test_rounding_of_sums_follows_the_subtraction():
    at = np.array([0.1, 0.3, 0.4, 0.7])  # 0.3 - 0.1 < 0.2, though 0.1 + 0.2 > 0.3 in doubles as well
    for gap in (0.2, 0.1, 0.3, 0.6):
        for last in at:
            want = next((i for i, t in enumerate(at) if t - last >= gap), len(at))
            assert chains.next_kept(at, np.array([last]), gap)[0] == want


# --- durations ----------------------------------------------------------------------------------------------------


def test_videos_that_outlast_their_candidates(spark):
    e = spark.createDataFrame([(1, 4.0), (1, 6.0), (1, 95.0), (9, 1.0)], "video_id long, ts double")
    v = spark.createDataFrame([(1, 20.0), (2, 20.0), (3, 0.0), (4, None)], "video_id long, duration double")
    got = {r["video_id"]: (r["duration"], r["budget"], r["times"]) for r in timeline.cover(e, 10.0, 12, videos=v).collect()}
    assert got == {1: (20.0, 2, [0.0, 4.0, 14.5, 19.0]), 2: (20.0, 2, [0.0, 5.0, 14.5, 19.0]), 3: (0.0, 1, [0.0]), 4: (0.0, 1, [0.0])}
    full = {r["video_id"]: r["times"] for r in timeline.scene_sampling(e, 10.0, 12, videos=v).collect()}
    assert full[2] == [0.0, 5.0, 14.5, 19.0] and full[3] == [0.0]


def test_documents_without_a_line_left(spark):
    lines = spark.createDataFrame([(1, 0, "ab"), (1, 1, None), (2, 0, "a line that is long enough")], "video_id long, pos int, line string")
    got = {r["video_id"]: r["markdown"] for r in report.structured_document(lines).collect()}
    assert got[1].strip() == report.DOCUMENT_TITLE and "long enough" in got[2]
