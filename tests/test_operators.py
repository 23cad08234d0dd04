"""Values derived by hand for the edge cases of FIXTURES.md."""

import pytest
from pyspark.sql import functions as F

from lumenreel.functions import text as T
from lumenreel.functions.rules import VIDEO
from lumenreel.operators import align, dedupe, layout, rank, report, speech, timeline


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("d, want", [(0.0, 0.001), (0.5, 0.25), (10.0, 0.5), (3600.0, 180.0)])
def test_epsilon(spark, d, want):
    assert one(spark, timeline.epsilon(F.col("d")), d=d) == pytest.approx(want)


@pytest.mark.parametrize("d, want", [(0.0, 1), (0.5, 1), (10.0, 2), (11.0, 3), (3600.0, 12)])
def test_budget(spark, d, want):
    assert one(spark, timeline.budget(F.col("d"), 5.0, 12), d=d) == want


def test_gap_filter_compares_with_the_last_kept(spark):
    # 0 kept, 2 dropped, 3 kept (3 after 0), 5 dropped, 6 kept: equal to the gap counts
    assert one(spark, timeline.gap_filter(F.col("t"), 3.0), t=[0.0, 2.0, 3.0, 5.0, 6.0]) == [0.0, 3.0, 6.0]
    assert one(spark, timeline.gap_filter(F.array().cast("array<double>"), 3.0), t=1) == []


def test_anchors(spark):
    assert one(spark, timeline.anchored(F.col("t"), F.lit(10.0)), t=[4.0, 4.0]) == [0.0, 4.0, 9.5]


def test_fill_gaps_stops_at_a_repeated_choice(spark):
    def filled(have, d, n, pool):
        column = timeline.fill_gaps(F.col("h").cast("array<double>"), F.lit(d), F.lit(n), F.col("p").cast("array<double>"))
        return one(spark, column, h=have, p=pool)

    assert filled([5.0], 10.0, 3, []) == [2.5, 5.0, 7.25]
    assert filled([0.0], 0.0, 3, []) == [0.0]
    assert filled([0.0], 10.0, 4, [0.0]) == [0.0]  # the only candidate in the gap is there already


def test_cover_prefers_the_earlier_of_two(spark):
    e = spark.createDataFrame([(1, 0.0), (1, 4.0), (1, 6.0), (1, 20.0)], "video_id long, ts double")
    times = timeline.cover(e, 10.0, 12).first()["times"]
    assert times == [0.0, 4.0, 19.0, 20.0]  # 4 and 6 are as near to 5; the last window reaches the end


@pytest.mark.parametrize("s, want", [(0.0, "00:00"), (0.5, "00:00"), (1.5, "00:02"), (59.6, "01:00"), (3600.0, "01:00:00"), (-4.0, "00:00")])
def test_labels(spark, s, want):
    assert one(spark, T.timestamp_label(F.col("s")), s=s) == want


def test_representative_keeps_head_and_tail(spark):
    s = spark.range(100).select(F.lit(1).alias("video_id"), F.col("id").alias("seg_idx"))
    kept = sorted(r["seg_idx"] for r in timeline.representative(s, 12).collect())
    # three at each end; six at rint(i * 93 / 5) of the 94 between, halves to even
    assert kept == [0, 1, 2, 3, 22, 40, 59, 77, 96, 97, 98, 99]


def test_alignment_edges(spark):
    frames = spark.createDataFrame([(1, 0, 10.0), (1, 1, 100.0), (1, 2, 500.0)], "video_id long, idx int, ts double")
    seg = spark.createDataFrame([(1, 0, 13.0, 15.0, None, "at four"), (1, 1, 13.1, 15.1, None, "beyond"), (1, 2, 50.0, 160.0, "a", "long")], "video_id long, seg_idx int, start double, end double, speaker string, text string")
    got = {r["idx"]: [s["seg_idx"] for s in r["segments"]] for r in align.attach_segments(frames, seg).collect()}
    assert got == {0: [0], 1: [2], 2: []}


def test_first_within_is_not_the_nearest(spark):
    frames = spark.createDataFrame([(1, 0, 10.0)], "video_id long, idx int, ts double")
    items = spark.createDataFrame([(1, 1, 9.8, "first"), (1, 2, 10.0, "nearest")], "video_id long, pos int, ts double, text string")
    assert align.first_within(frames, items, "text").first()["text"] == "first"


def test_segments_normalised(spark):
    raw = spark.createDataFrame([(1, 0, None, 2.0, None, " a "), (1, 1, 5.0, 0.0, "s", "b"), (1, 2, 1.0, 2.0, "s", "  ")], "video_id long, seg_idx int, start double, end double, speaker string, text string")
    assert [(r["start"], r["end"], r["text"]) for r in speech.normalize_segments(raw).orderBy("seg_idx").collect()] == [(0.0, 2.0, "a"), (5.0, 5.0, "b")]


def test_speakers_and_chunks(spark):
    s = spark.createDataFrame([(1, 0, 9.0, 10.0, "b", "xx"), (1, 1, 1.0, 2.0, "b", "yy"), (1, 2, 3.0, 4.0, "a", "zz"), (1, 3, 3.0, 4.0, " ", "zz"), (1, 4, 5.0, 6.0, "a", "w" * 5)], "video_id long, seg_idx int, start double, end double, speaker string, text string")
    got = [(r["speaker"], r["segment_count"], r["start"], r["end"]) for r in speech.speakers(s).orderBy("rank").collect()]
    assert got == [("a", 2, 3.0, 6.0), ("b", 2, 9.0, 10.0)]  # ties by name; start is the first segment's
    c = [(r["start"], r["end"], r["text"]) for r in speech.chunks(s, 5).orderBy("chunk_idx").collect()]
    assert c == [(9.0, 2.0, "xx yy"), (3.0, 4.0, "zz zz"), (5.0, 6.0, "wwwww")]


def test_title_signal(spark):
    s = one(spark, T.title_signal(F.col("t")), t="12:30 PM Claude 使用 指南 v2")
    assert s["normalized_text"] == "claude 使用 指南 v2" and s["meaningful_tokens"] == ["claude", "使用", "指南"] and s["is_meaningful"]
    assert not one(spark, T.title_signal(F.col("t")), t="12 34 56 789 01")["is_meaningful"]


def test_quality_counts_terms_inside_words(spark):
    assert one(spark, T.ocr_quality(F.col("t"), VIDEO.useful_terms), t="he said") == pytest.approx(0.51)
    assert one(spark, T.ocr_quality(F.col("t")), t="") == 0.0
    assert one(spark, T.known_terms(F.col("t"), VIDEO), t="用Al写 al") == "用Al写 AI"
    assert one(spark, T.known_terms(F.col("t")), t="al contado, OpenCloud") == "al contado, OpenCloud"  # no pack, no rewriting


def test_steady_nav(spark):
    rows = [(1, 0.0, True, 4, 0.75), (1, 1.0, True, 2, 0.54), (1, 2.0, True, 3, 0.5), (1, 3.0, False, -1, 0.0), (1, 4.0, True, 1, 0.85)]
    f = spark.createDataFrame(rows, "video_id long, ts double, nav_present boolean, active_index int, confidence double")
    assert [r["context_index"] for r in layout.steady_nav(f).orderBy("ts").collect()] == [4, 4, 4, 1, 1]


def test_change_filter_reasons(spark):
    def frame(ts, level, **more):
        base = dict(transition_like=False, title_meaningful=False, title_block_like=False, title_tokens=["a"], title_meaning="a", nav_present=False, active_index=-1, nav_confidence=0.0, context_index=-1, presenter_like=False, presenter_confidence=0.0) | more
        return dict(video_id=1, ts=ts, grid=[level] * 4, edge_grid=[level] * 4, row_profile=[float(level)] * 2, col_profile=[float(level)] * 2, brightness_mean=0.5, edge_strength=0.1) | base

    rows = [frame(0.0, 0), frame(1.0, 100), frame(2.0, 101), frame(3.0, 255, transition_like=True), frame(4.0, 250, presenter_like=True, presenter_confidence=0.8), frame(5.0, 0), frame(6.0, 0)]
    cols = "video_id long, ts double, grid array<int>, edge_grid array<int>, row_profile array<double>, col_profile array<double>, brightness_mean double, edge_strength double, transition_like boolean, title_meaningful boolean, title_block_like boolean, title_tokens array<string>, title_meaning string, nav_present boolean, active_index int, nav_confidence double, context_index int, presenter_like boolean, presenter_confidence double"
    f = spark.createDataFrame([tuple(r.values()) for r in rows], cols)
    got = [r["keep_reason"] for r in layout.change_filter(f, presenter=True).orderBy("ts").collect()]
    assert got == ["kept-anchor", "kept-layout-strong", "dropped-layout-weak", "dropped-transition-like", "dropped-presenter-shot", "kept-layout-strong", "kept-anchor"]


def test_folds_compare_with_survivors(spark):
    lines = spark.createDataFrame([(1, 0, "a line of text here"), (1, 1, "a line of text hers"), (1, 2, "something else now")], "video_id long, pos int, line string")
    assert [r["pos"] for r in dedupe.merge_lines(lines).orderBy("pos").collect()] == [0, 2]
    assert dedupe.ratio("tide", "diet") == 0.25 and dedupe.ratio("diet", "tide") == 0.5


def test_keyframes_hold_anchors(spark):
    f = spark.createDataFrame([(1, i, 10.0 - i) for i in range(20)], "video_id long, idx int, score double")
    assert sorted(r["idx"] for r in rank.keyframes(f, 5).collect()) == [0, 1, 2, 10, 19]


def test_sections_and_front_matter(spark):
    s = one(spark, report.sections(F.col("t")), t="1. Summary\nfoo\n2. Timeline:\nbar\n1. Summary\nagain")
    assert s["summary"] == "again" and s["timeline"] == "bar" and s["uncertainties"] == ""
    head = one(spark, report.front_matter({"title": F.lit('a "b"')}, F.array(F.lit("t")), F.array(F.lit("x"))), t=1)
    assert head == '---\ntitle: "a \\"b\\""\naliases:\n  - "x"\ntags:\n  - t\n---\n'
    assert one(spark, report.with_front_matter(F.col("t"), F.lit("H")), t="---\nx") == "---\nx"


def test_urls(spark):
    assert one(spark, T.source_input(F.col("t")), t="看 https://a.b/c.mp4。再") == "https://a.b/c.mp4"
    assert one(spark, T.page_video_url(F.col("t")), t="https://www.douyin.com/jingxuan?modal_id=7") == "https://www.douyin.com/video/7"
    assert one(spark, T.media_suffix(F.col("t"), F.lit("Video/WebM; q")), t="https://a.b/c") == ".webm"


def test_title_signal_takes_the_whole_first_line(spark, tmp_path):
    from lumenreel.plans import catalogue

    line = " ".join(f"chapter{c}" for c in "abcdefghijklmnop")  # 143 characters
    spark.createDataFrame([(1, line + "\nsecond line")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    r = catalogue.title_signal(spark, str(tmp_path)).first()
    assert r["normalized_text"] == line and r["meaningful_text"] == line
    assert r["token_count"] == r["meaningful_token_count"] == 16
