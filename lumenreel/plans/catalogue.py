"""The registered queries over generic tables, and DuckDB SQL for those that SQL can express.

How tables stand for video observations is a convention of these queries: a user's events are a video's
frames and speech, a conversation is a transcript, a document's lines are recognised lines, a vector is a
frame's grid.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenreel.functions import text as T
from lumenreel.operators import align, chains, dedupe, layout, rank, report, speech, timeline
from lumenreel.plans import evidence, evidence_sql
from lumenreel.plans.evidence import PROSE
from lumenreel.plans.tables import EVENTS, LINES, MOST, SAMPLE, SEGMENTS, doc_lines, events, read, segments

DOC_TERMS, UI_TERMS = ["the", "que", "der", "les"], ["is on", "por la"]


def segment_coverage_timeline(spark, sf_dir):
    out = timeline.cover(events(spark, sf_dir), SAMPLE, MOST)
    return out.select("video_id", "budget", F.posexplode("times").alias("pos", "ts"))


def change_gap_filter(spark, sf_dir):
    times = events(spark, sf_dir).groupBy("video_id").agg(F.array_sort(F.collect_list("ts")).alias("ts"))
    kept = times.select("video_id", F.size("ts").alias("n_in"), timeline.gap_filter(timeline.distinct_times(F.col("ts")), 3600.0).alias("kept"))
    return kept.select("video_id", "n_in", F.size("kept").alias("n_kept"), F.aggregate("kept", F.lit(0).cast("long"), lambda a, x: a + F.rint(x * 1000).cast("long")).alias("checksum"))


def long_gap_filter(spark, sf_dir):
    """All events of a type as one long video."""
    times = events(spark, sf_dir).select(F.col("event_type").alias("video_id"), F.col("ts"))
    return chains.gap_filter_rows(times, 14400.0)


def long_speech_chunks(spark, sf_dir):
    """All that is said in one role as one long transcript."""
    s = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    i = (F.col("conv_id") * 1000 + F.col("turn")).cast("long")
    s = s.select(F.col("role").alias("video_id"), i.alias("seg_idx"), i.cast("double").alias("start"), (i + 0.5).alias("end"), F.trim("text").alias("text")).where("text != ''")
    return chains.chunk_rows(s, 420)


def representative_segments(spark, sf_dir):
    s = segments(spark, sf_dir).select("video_id", "seg_idx")
    return timeline.representative(s, 4).withColumn("most", F.lit(4)).unionByName(timeline.representative(s, 8).withColumn("most", F.lit(8)))


def _frames(e: DataFrame) -> DataFrame:
    return e.where("event_type = 'view'").select("video_id", F.col("event_id").alias("idx"), "ts")


def frame_transcript_alignment(spark, sf_dir):
    e = events(spark, sf_dir)
    seg = e.where("event_type = 'click'").select("video_id", F.col("event_id").alias("seg_idx"), F.col("ts").alias("start"), (F.col("ts") + F.col("value") * 60).alias("end"), F.lit(None).cast("string").alias("speaker"), F.lit("").alias("text"))
    out = align.attach_segments(_frames(e), seg, 3600.0)
    return out.select("video_id", "idx", F.size("segments").alias("n_segments"), F.array_join(F.transform("segments", lambda s: s["seg_idx"].cast("string")), ",").alias("seg_ids"))


def long_segment_alignment(spark, sf_dir):
    """Segments of seconds, hours and the whole video, some with their ends swapped; texts of batches as unlike in length."""
    e = events(spark, sf_dir)
    i = F.col("event_id")
    end = F.when(i % 17 == 0, 1e12).when(i % 5 == 0, F.col("ts") - 100).when(i % 3 == 0, F.col("ts") * 3).otherwise(F.col("ts") + F.col("value"))
    seg = e.where("event_type = 'click'").select("video_id", i.alias("seg_idx"), F.col("ts").alias("start"), end.alias("end"), F.lit(None).cast("string").alias("speaker"), F.lit("").alias("text"))
    out = align.attach_segments(_frames(e), seg, 30.0)
    return out.select("video_id", "idx", F.size("segments").alias("n_segments"), F.array_join(F.transform("segments", lambda s: s["seg_idx"].cast("string")), ",").alias("seg_ids"))


def long_batch_evidence(spark, sf_dir):
    e = events(spark, sf_dir)
    b = e.where("event_type = 'purchase'").select("video_id", F.col("event_id").alias("batch"), F.col("ts").alias("start"), F.when(F.col("event_id") % 4 == 0, 1e9).otherwise(F.col("ts") + F.col("value")).alias("end"))
    texts = e.where("event_type = 'error'").select("video_id", F.col("event_id").alias("pos"), "ts", F.concat("event_type", F.col("event_id").cast("string")).alias("text"))
    return align.batch_texts(b, texts)


def first_match_tolerance(spark, sf_dir):
    e = events(spark, sf_dir)
    items = e.where("event_type = 'click'").select("video_id", "ts", F.col("event_id").alias("pos"), F.col("event_id").alias("found"))
    return align.first_within(_frames(e), items, "found", 1800.0).select("video_id", "idx", F.coalesce("found", F.lit(-1)).alias("found"))


def batch_evidence(spark, sf_dir):
    e = events(spark, sf_dir)
    b = timeline.batches(_frames(e), 4).groupBy("video_id", "batch").agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    texts = e.where("event_type = 'error'").select("video_id", F.col("event_id").alias("pos"), "ts", F.concat("event_type", F.col("event_id").cast("string")).alias("text"))
    return align.batch_texts(b, texts, 600.0)


def speaker_summary(spark, sf_dir):
    s = speech.speakers(speech.normalize_segments(segments(spark, sf_dir)), pack=PROSE)
    return s.select("video_id", "rank", "speaker", "segment_count", "start", "end", "joined", "summary", "excerpt")


def speech_chunks(spark, sf_dir):
    return speech.chunks(speech.normalize_segments(segments(spark, sf_dir)), 420)


def transcript_coverage(spark, sf_dir):
    s = speech.normalize_segments(segments(spark, sf_dir))
    videos = s.groupBy("video_id").agg((F.max("seg_idx") * 5.0 + 5.0).alias("duration"))
    return speech.coverage(s, videos).select("video_id", "duration", "coverage", "speaker_count")


def timestamp_labels(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", T.timestamp_label(F.col("ts") / 10).alias("label"))


def title_signal(spark, sf_dir):
    d = read(spark, sf_dir, "documents", "doc_id", "text")
    s = d.select("doc_id", T.title_signal(F.split(F.coalesce("text", F.lit("")), "\n")[0]).alias("s"))
    return s.select("doc_id", "s.normalized_text", "s.meaningful_text", "s.quality_score", "s.is_meaningful", "s.token_count", "s.meaningful_token_count")


def ocr_quality(spark, sf_dir):
    lines = doc_lines(spark, sf_dir).select("doc_id", F.posexplode("lines").alias("line_no", "line"))
    normal = lines.withColumn("line", T.ocr_text(F.col("line")))
    return normal.select("doc_id", "line_no", F.length("line").alias("n_chars"), T.ocr_quality(F.col("line"), ["the", "que"]).alias("quality"))


def document_density(spark, sf_dir):
    return doc_lines(spark, sf_dir).select("doc_id", T.document_density(F.col("lines")).alias("density"))


def document_score(spark, sf_dir):
    return doc_lines(spark, sf_dir).select("doc_id", T.document_score(F.col("lines"), DOC_TERMS, UI_TERMS).alias("score"))


def section_routing(spark, sf_dir):
    s = segments(spark, sf_dir).select("video_id", F.col("seg_idx").alias("pos"), "text")
    bucket = F.when(F.contains("text", F.lit(" the ")), "review").when(F.contains("text", F.lit(" que ")), "rules").when(F.contains("text", F.lit(" der ")), "source")
    return report.route(s, bucket, "source").select("video_id", "pos", "section")


def layout_difference(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    grid = F.transform("embedding", lambda x: x.cast("double") * 255)
    s = e.select("vec_id", F.struct(grid.alias("grid"), F.reverse(grid).alias("edge_grid"), F.slice(grid, 1, 14).alias("row_profile"), F.slice(grid, 15, 24).alias("col_profile"), F.element_at(grid, 1).alias("brightness_mean"), F.element_at(grid, 2).alias("edge_strength")).alias("s"))
    pair = s.alias("a").join(s.alias("b"), F.col("a.vec_id") + 1 == F.col("b.vec_id"))
    d = pair.select(F.col("a.vec_id").alias("vec_id"), layout.difference(F.col("a.s"), F.col("b.s")).alias("d"))
    return d.select("vec_id", "d.grid_diff", "d.edge_diff", "d.row_profile_diff", "d.col_profile_diff", F.round("d.combined_score", 9).alias("combined_score"))


def stable_nav_context(spark, sf_dir):
    e = events(spark, sf_dir)
    f = e.select("video_id", "event_id", "ts", (F.col("event_type") != "error").alias("nav_present"), (F.col("event_id") % 6 - 1).cast("int").alias("active_index"), (F.col("value") / 500).alias("confidence"))
    w = layout.steady_nav(f.withColumn("at", F.struct("ts", "event_id")), order="at")
    return w.select("event_id", "context_index")


def keyframe_topk(spark, sf_dir):
    e = events(spark, sf_dir).select("video_id", F.col("event_id").alias("idx"), "event_type")
    w = Window.partitionBy("video_id")
    place, total = F.row_number().over(w.orderBy("idx")) - 1, F.count("*").over(w)
    reason = F.when(F.col("event_type") == "error", "kept-title").when(F.col("event_type") == "click", "dropped-same-chapter")
    s = e.withColumn("place", place).withColumn("total", total)
    s = s.withColumn("score", rank.keyframe_score(F.col("place"), F.col("total"), F.col("event_type"), F.col("idx") % 4, reason))
    return rank.keyframes(s, 8).select("video_id", "idx", F.round("score", 3).alias("score"))


def change_frames(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    grid = F.transform("embedding", lambda x: F.abs(x.cast("double")) * 900)
    f = e.select((F.col("vec_id") % 50).alias("video_id"), F.col("vec_id").cast("double").alias("ts"), grid.alias("grid"), F.reverse(grid).alias("edge_grid"), F.slice(grid, 1, 14).alias("row_profile"), F.slice(grid, 15, 24).alias("col_profile"), F.lit(0.5).alias("brightness_mean"), F.lit(0.1).alias("edge_strength"), F.lit(False).alias("transition_like"), (F.col("vec_id") % 2 == 0).alias("title_meaningful"), F.lit(True).alias("title_block_like"), F.array(F.concat(F.lit("title"), (F.floor(F.col("vec_id") / 100)).cast("string"))).alias("title_tokens"), F.concat(F.lit("title"), (F.floor(F.col("vec_id") / 100)).cast("string")).alias("title_meaning"), F.lit(True).alias("nav_present"), (F.col("vec_id") % 3).cast("int").alias("active_index"), F.lit(0.6).alias("nav_confidence"), (F.col("vec_id") % 3).cast("int").alias("context_index"), (F.col("vec_id") % 7 == 0).alias("presenter_like"), F.lit(0.8).alias("presenter_confidence"))
    return f


def change_filter(spark, sf_dir):
    out = layout.change_filter(change_frames(spark, sf_dir), title=True, nav=True, presenter=True, dedupe=True)
    return out.select("video_id", "ts", "keep_reason", "kept", F.round("combined_score", 9).alias("combined_score"))


def near_dup_lines(spark, sf_dir):
    lines = doc_lines(spark, sf_dir).select(F.col("doc_id").alias("video_id"), F.posexplode("lines").alias("pos", "line"))
    return dedupe.merge_lines(lines).select("video_id", "pos", F.length("line").alias("n_chars"))


def diverse_documents(spark, sf_dir):
    d = doc_lines(spark, sf_dir)
    f = d.select((F.col("doc_id") % 20).alias("video_id"), F.col("doc_id").cast("double").alias("ts"), T.document_score(F.col("lines"), DOC_TERMS, UI_TERMS).alias("score"), "lines")
    return dedupe.diverse_frames(f).select("video_id", "ts", "score")


def html_guard(spark, sf_dir):
    p = read(spark, sf_dir, "pages", "page_id", "html")
    return p.select("page_id", T.looks_like_html(F.col("html")).alias("is_html"), T.looks_like_html(F.expr("substring(html, 20)")).alias("tail_is_html"), T.has_transcript(F.col("html"), F.col("page_id") % 3).alias("has_transcript"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        segment_coverage_timeline, change_gap_filter, long_gap_filter, long_speech_chunks, representative_segments, frame_transcript_alignment, long_segment_alignment, long_batch_evidence, first_match_tolerance,
        batch_evidence, speaker_summary, speech_chunks, transcript_coverage, timestamp_labels, title_signal, ocr_quality,
        document_density, document_score, section_routing, layout_difference, stable_nav_context, keyframe_topk, change_filter,
        near_dup_lines, diverse_documents, html_guard,
    )
} | evidence.QUERIES

_NORMAL = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim({0})),
  '(^|[^0-9])[0-9]{{1,2}}:[0-9]{{2}}($|[^0-9])', '\1 \2', 'g'), '\s+', ' ', 'g'), '[^0-9a-zA-Z\x{{4e00}}-\x{{9fff}} /:_-]+', ' ', 'g'), '\b(?:am|pm)\b', ' ', 'g'), '\s+', ' ', 'g'))"""


def _n(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


_CJK, _USEFUL = r"[\x{4e00}-\x{9fff}]", r"[0-9A-Za-z\x{4e00}-\x{9fff}]"

ORACLES: dict[str, str] = {
    "segment_coverage_timeline": f"""
WITH {EVENTS}, v AS (
  SELECT video_id, max(ts) AS d, CASE WHEN max(ts) <= 0 THEN 1 ELSE greatest(1, least({MOST}, ceil(max(ts) / {SAMPLE}))) END::INT AS n FROM e GROUP BY 1
), v2 AS (
  SELECT *, greatest(d - CASE WHEN d <= 0 THEN 0.001 ELSE least(greatest(0.5, d * 0.05::DOUBLE), greatest(d / 2, 0.001)) END, 0) AS se, d <= 0 OR n <= 1 AS single FROM v
), w0 AS (
  SELECT *, unnest(range(CASE WHEN single THEN 1 ELSE n END))::INT AS idx FROM v2
), w1 AS (
  SELECT *, CASE WHEN single THEN 0 ELSE idx * (d / n) END AS a,
         CASE WHEN single THEN greatest(d, 0) ELSE least(CASE WHEN idx = n - 1 THEN d ELSE (idx + 1) * (d / n) END, se) END AS b FROM w0
), w AS (
  SELECT *, round_even(a * 1000, 0) / 1000 AS w_start, round_even(greatest(b, a) * 1000, 0) / 1000 AS w_end,
         round_even(CASE WHEN single THEN 0 ELSE greatest(least(a + (b - a) / 2, se), 0) END * 1000, 0) / 1000 AS center FROM w1
), p AS (
  SELECT w.video_id, w.idx, any_value(w.d) AS d, any_value(w.n) AS n, any_value(w.se) AS se,
         coalesce((min({{'far': abs(e.ts - w.center), 'ts': e.ts}}) FILTER (e.ts IS NOT NULL)).ts, any_value(w.center)) AS pick
  FROM w LEFT JOIN e ON e.video_id = w.video_id AND (e.ts BETWEEN w_start AND w_end OR (w.idx = w.n - 1 AND e.ts BETWEEN w_start AND w.d))
  GROUP BY 1, 2
), t AS (
  SELECT video_id, any_value(n) AS budget, CASE WHEN any_value(d) <= 0 THEN [0.0::DOUBLE] ELSE
    list_sort(list_distinct(list_transform(list_concat([0.0::DOUBLE], list(pick), [any_value(se)::DOUBLE]), lambda x: round_even(x * 1000, 0) / 1000))) END AS times
  FROM p GROUP BY 1
)
SELECT video_id, budget, (unnest(range(len(times))))::INT AS pos, unnest(times) AS ts FROM t""",
    "change_gap_filter": f"""
WITH {EVENTS}, l AS (
  SELECT video_id, count(*)::INT AS n_in, list_sort(list_distinct(list(round_even(ts * 1000, 0) / 1000))) AS ts FROM e GROUP BY 1
), k AS (
  SELECT video_id, n_in, list_reduce(list_transform(ts, lambda x: [x]), lambda a, x: CASE WHEN x[1] - a[-1] >= 3600.0 THEN list_concat(a, x) ELSE a END) AS kept FROM l
)
SELECT video_id, n_in, len(kept)::INT AS n_kept, list_sum(list_transform(kept, lambda x: round_even(x * 1000, 0)::BIGINT))::BIGINT AS checksum FROM k""",
    "long_gap_filter": f"""
WITH RECURSIVE {EVENTS}, t AS (
  SELECT DISTINCT event_type AS video_id, round_even(ts * 1000, 0) / 1000 AS ts FROM e
), k AS (
  SELECT video_id, min(ts) AS ts FROM t GROUP BY 1
  UNION ALL
  SELECT k.video_id, (SELECT min(t.ts) FROM t WHERE t.video_id = k.video_id AND t.ts - k.ts >= 14400) FROM k WHERE k.ts IS NOT NULL
)
SELECT video_id, ts FROM k WHERE ts IS NOT NULL""",
    "long_speech_chunks": """
WITH RECURSIVE s AS (
  SELECT role AS video_id, conv_id * 1000 + turn AS i, trim(text) AS text, row_number() OVER (PARTITION BY role ORDER BY conv_id * 1000 + turn) AS r FROM conversations WHERE trim(coalesce(text, '')) <> ''
), k AS (
  SELECT video_id, r, 0 AS chunk, length(text) AS n FROM s WHERE r = 1
  UNION ALL
  SELECT s.video_id, s.r, CASE WHEN k.n >= 420 THEN k.chunk + 1 ELSE k.chunk END, CASE WHEN k.n >= 420 THEN length(s.text) ELSE k.n + 1 + length(s.text) END FROM k JOIN s ON s.video_id = k.video_id AND s.r = k.r + 1
)
SELECT video_id, chunk::INT AS chunk_idx, min(i)::DOUBLE AS start, max(i) + 0.5::DOUBLE AS "end", string_agg(text, ' ' ORDER BY r) AS text FROM k JOIN s USING (video_id, r) GROUP BY 1, 2""",
    "representative_segments": """
WITH s AS (
  SELECT conv_id AS video_id, turn::INT AS seg_idx, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations
)
SELECT video_id, seg_idx, 4 AS most FROM s WHERE n <= 4 OR (i % greatest(1, n // 4) = 0 AND i / greatest(1, n // 4) < 4)
UNION ALL
SELECT video_id, seg_idx, 8 AS most FROM s WHERE n <= 8 OR i < 2 OR i >= n - 2 OR n - 4 <= 4
  OR list_contains(list_transform(range(4), lambda j: round_even(j * (n - 5) / 3, 0)), (i - 2)::DOUBLE)""",
    "frame_transcript_alignment": f"""
WITH {EVENTS}, f AS (SELECT video_id, event_id AS idx, ts FROM e WHERE event_type = 'view'),
g AS (SELECT video_id, event_id AS seg_idx, ts AS a, ts + value * 60 AS b FROM e WHERE event_type = 'click')
SELECT f.video_id, f.idx, count(g.seg_idx)::INT AS n_segments, coalesce(string_agg(g.seg_idx::VARCHAR, ',' ORDER BY g.seg_idx), '') AS seg_ids
FROM f LEFT JOIN g ON f.video_id = g.video_id AND (abs((a + b) / 2 - f.ts) <= 3600 OR f.ts BETWEEN a AND b) GROUP BY 1, 2""",
    "long_segment_alignment": f"""
WITH {EVENTS}, f AS (SELECT video_id, event_id AS idx, ts FROM e WHERE event_type = 'view'),
g AS (SELECT video_id, event_id AS seg_idx, ts AS a, CASE WHEN event_id % 17 = 0 THEN 1e12::DOUBLE WHEN event_id % 5 = 0 THEN ts - 100 WHEN event_id % 3 = 0 THEN ts * 3 ELSE ts + value END AS b FROM e WHERE event_type = 'click')
SELECT f.video_id, f.idx, count(g.seg_idx)::INT AS n_segments, coalesce(string_agg(g.seg_idx::VARCHAR, ',' ORDER BY g.seg_idx), '') AS seg_ids
FROM f LEFT JOIN g ON f.video_id = g.video_id AND (abs((a + b) / 2 - f.ts) <= 30 OR f.ts BETWEEN a AND b) GROUP BY 1, 2""",
    "long_batch_evidence": f"""
WITH {EVENTS}, b AS (SELECT video_id, event_id AS batch, ts AS start, CASE WHEN event_id % 4 = 0 THEN 1e9::DOUBLE ELSE ts + value END AS "end" FROM e WHERE event_type = 'purchase')
SELECT b.video_id, b.batch, b.start, b."end", coalesce(string_agg(t.event_type || t.event_id, chr(10) ORDER BY t.event_id), '') AS evidence
FROM b LEFT JOIN e t ON t.video_id = b.video_id AND t.event_type = 'error' AND t.ts BETWEEN b.start - 0.5 AND b."end" + 0.5 GROUP BY ALL""",
    "first_match_tolerance": f"""
WITH {EVENTS}, f AS (SELECT video_id, event_id AS idx, ts FROM e WHERE event_type = 'view')
SELECT f.video_id, f.idx, coalesce(min(c.event_id), -1) AS found FROM f LEFT JOIN e c ON c.video_id = f.video_id AND c.event_type = 'click' AND abs(c.ts - f.ts) <= 1800 GROUP BY 1, 2""",
    "batch_evidence": f"""
WITH {EVENTS}, f AS (SELECT video_id, ts, ((row_number() OVER (PARTITION BY video_id ORDER BY event_id) - 1) // 4)::INT AS batch FROM e WHERE event_type = 'view'),
b AS (SELECT video_id, batch, min(ts) AS start, max(ts) AS "end" FROM f GROUP BY 1, 2)
SELECT b.video_id, b.batch, b.start, b."end", coalesce(string_agg(t.event_type || t.event_id, chr(10) ORDER BY t.event_id), '') AS evidence
FROM b LEFT JOIN e t ON t.video_id = b.video_id AND t.event_type = 'error' AND t.ts BETWEEN b.start - 600 AND b."end" + 600 GROUP BY ALL""",
    "transcript_coverage": f"""
WITH {SEGMENTS}, v AS (
  SELECT video_id, max(seg_idx) * 5.0::DOUBLE + 5.0::DOUBLE AS duration, min(start) AS a, max(end_) AS b, count(DISTINCT nullif(trim(speaker), '')) AS speaker_count FROM s GROUP BY 1
)
SELECT video_id, duration, greatest(0, least(1, (b - a) / greatest(duration, 0.001)))::DOUBLE AS coverage, speaker_count FROM v""",
    "timestamp_labels": f"""
WITH {EVENTS}, t AS (SELECT event_id, round_even(ts / 10, 0)::BIGINT AS x FROM e)
SELECT event_id, CASE WHEN x >= 3600 THEN printf('%02d:%02d:%02d', x // 3600, x // 60 % 60, x % 60) ELSE printf('%02d:%02d', x // 60, x % 60) END AS label FROM t""",
    "title_signal": f"""
WITH d AS (
  SELECT doc_id, {_NORMAL.format("string_split(coalesce(text, ''), chr(10))[1]")} AS n FROM documents
), t AS (
  SELECT *, list_filter(string_split(n, ' '), lambda x: x <> '') AS tokens FROM d
), m AS (
  SELECT *, list_filter(list_transform(tokens, lambda x: regexp_replace(x, '^[-_/:]+|[-_/:]+$', '', 'g')), lambda x:
    {_n("x", _CJK)} >= 2 OR {_n("x", "[a-zA-Z]")} >= 3 OR ({_n("x", "[a-zA-Z]")} >= 2 AND {_n("x", "[0-9]")} >= 1 AND length(x) >= 4)) AS good FROM t
), c AS (
  SELECT *, {_n("n", _CJK)} AS cjk, {_n("n", "[a-zA-Z]")} AS alpha, {_n("n", "[0-9]")} AS digit, len(tokens) AS nt, len(list_distinct(good)) AS kinds,
    CASE WHEN len(good) > 0 THEN list_sum(list_transform(good, lambda x: length(x))) / len(good) ELSE 0 END AS mean,
    len(list_filter(tokens, lambda x: length(regexp_replace(x, '^[-_/:]+|[-_/:]+$', '', 'g')) <= 2)) AS short FROM m
), q AS (
  SELECT *, digit > greatest(4, alpha + cjk) AS heavy,
    CASE WHEN cjk >= 2 OR alpha >= 6 THEN 35 ELSE 0 END + CASE WHEN kinds >= 2 THEN 25 WHEN kinds = 1 AND mean >= 4 THEN 12 ELSE 0 END
    + CASE WHEN mean >= 4 THEN 20 WHEN mean >= 3 THEN 10 ELSE 0 END + CASE WHEN length(n) BETWEEN 6 AND 80 THEN 15 WHEN length(n) BETWEEN 4 AND 5 AND kinds >= 1 THEN 5 ELSE 0 END
    + CASE WHEN nt <= 8 AND kinds >= 1 THEN 5 ELSE 0 END - CASE WHEN nt >= 6 AND short / greatest(nt, 1) >= 0.55 THEN 25 ELSE 0 END
    - CASE WHEN nt >= 8 AND kinds <= 2 THEN 20 ELSE 0 END - CASE WHEN digit > greatest(4, alpha + cjk) THEN 25 ELSE 0 END AS total FROM c
), z AS (
  SELECT *, greatest(0, least(100, CASE WHEN len(good) = 0 THEN least(total, 25) ELSE total END)) / 100 AS score FROM q
)
SELECT doc_id, n AS normalized_text, array_to_string(good, ' ') AS meaningful_text, score::DOUBLE AS quality_score, score >= 0.55 AND kinds >= 1 AND NOT heavy AS is_meaningful,
       nt::INT AS token_count, kinds::INT AS meaningful_token_count FROM z""",
    "ocr_quality": f"""
WITH {LINES}, l AS (
  SELECT doc_id, (unnest(range(len(lines))))::INT AS line_no, unnest(lines) AS raw FROM d
), n0 AS (
  SELECT doc_id, line_no, regexp_replace(trim(regexp_replace(raw, '\\s+', ' ', 'g')), '^[| *\\t·•\\-=_,.;:，。；：]+|[| *\\t·•\\-=_,.;:，。；：]+$', '', 'g') AS line FROM l
), n AS (
  SELECT doc_id, line_no, CASE WHEN {_n("line", _USEFUL)} >= 2 THEN line ELSE '' END AS line FROM n0
), c AS (
  SELECT *, regexp_replace(line, '\\s+', '', 'g') AS t FROM n
), k AS (
  SELECT *, {_n("t", _CJK)} AS cjk, {_n("t", "[A-Za-z]")} AS alpha, {_n("t", "[0-9]")} AS digit, length(t) AS size, contains(lower(t), 'the') OR contains(lower(t), 'que') AS known, {_n("t", "[aeiouAEIOU]")} AS vowels FROM c
), q AS (
  SELECT *, CASE WHEN cjk >= 2 THEN 55 ELSE 0 END + CASE WHEN cjk >= 5 THEN 20 ELSE 0 END + CASE WHEN known THEN 35 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[0-9]{{2,}}-[A-Za-z\\x{{4e00}}-\\x{{9fff}}]') THEN 18 ELSE 0 END + CASE WHEN alpha >= 4 AND size >= 6 THEN 16 ELSE 0 END
    - CASE WHEN (cjk + alpha + digit) / greatest(size, 1) < 0.68::DOUBLE THEN 25 ELSE 0 END - CASE WHEN size - (cjk + alpha + digit) >= cjk + alpha + digit THEN 25 ELSE 0 END
    - CASE WHEN alpha >= 8 AND cjk = 0 AND NOT known AND (vowels / greatest(alpha, 1) < 0.18::DOUBLE OR vowels / greatest(alpha, 1) > 0.58::DOUBLE) THEN 25 ELSE 0 END
    - CASE WHEN size <= 3 AND cjk = 0 AND NOT known THEN 25 ELSE 0 END AS total FROM k
)
SELECT doc_id, line_no, length(line)::INT AS n_chars, CASE WHEN size = 0 THEN 0 ELSE greatest(0, least(100, total)) / 100 END::DOUBLE AS quality FROM q""",
    "document_density": f"""
WITH {LINES}, c AS (SELECT doc_id, list_transform(lines, lambda t: {_n("t", _USEFUL)}) AS n FROM d)
SELECT doc_id, CASE WHEN len(n) > 0 THEN least(list_sum(n) / greatest(len(n), 1) / 18.0::DOUBLE, 1.0::DOUBLE) * 0.5::DOUBLE + least(len(list_filter(n, lambda x: x >= 12)) / 5.0::DOUBLE, 1.0::DOUBLE) * 0.5::DOUBLE ELSE 0 END::DOUBLE AS density FROM c""",
    "document_score": f"""
WITH {LINES}, c AS (
  SELECT doc_id, lines, array_to_string(lines, chr(10)) AS text,
    len(list_filter(lines, lambda t: {_n("t", _USEFUL)} >= 18)) AS para,
    len(list_filter(lines, lambda t: starts_with(t, '#') OR regexp_matches(t, '^[一二三四五六七八九十]+[、.．]'))) AS head,
    len(list_filter(lines, lambda t: starts_with(t, '- ') OR regexp_matches(t, '^[0-9]+\\.'))) AS bullet FROM d
), k AS (
  SELECT *, {" + ".join(f"contains(text, '{t}')::INT" for t in DOC_TERMS)} AS docs, {" + ".join(f"contains(text, '{t}')::INT" for t in UI_TERMS)} AS ui, {_n("text", _CJK)} AS cjk FROM c
)
SELECT doc_id, CASE WHEN len(lines) = 0 THEN 0 ELSE greatest(0, least(1,
  least(cjk / 180.0::DOUBLE, 1) * 0.35::DOUBLE + least(para / 6.0::DOUBLE, 1) * 0.25::DOUBLE + least((head + bullet) / 5.0::DOUBLE, 1) * 0.2::DOUBLE + least(docs / 3.0::DOUBLE, 1) * 0.25::DOUBLE - least(ui / 3.0::DOUBLE, 1) * 0.45::DOUBLE
  - CASE WHEN para < 2 THEN 0.25 ELSE 0 END::DOUBLE - CASE WHEN docs <= 0 THEN 0.38 ELSE 0 END::DOUBLE)) END::DOUBLE AS score FROM k""",
    "section_routing": """
SELECT conv_id AS video_id, turn::INT AS pos, coalesce(last_value(CASE WHEN contains(text, ' the ') THEN 'review' WHEN contains(text, ' que ') THEN 'rules' WHEN contains(text, ' der ') THEN 'source' END IGNORE NULLS)
  OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'source') AS section FROM conversations""",
    "layout_difference": """
WITH g AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 255) AS g FROM embeddings),
t AS (SELECT vec_id, g, list_transform(g, lambda x: trunc(x)::INT) AS i FROM g),
p AS (SELECT a.vec_id, a.g AS ag, b.g AS bg, list_transform(list_zip(a.i, b.i), lambda z: abs(z[1] - z[2])) AS d FROM t a JOIN t b ON a.vec_id + 1 = b.vec_id),
q AS (SELECT *, list_sum(d) / (len(d) * 255.0::DOUBLE) AS x, list_sum(d[1:14]) / (14 * 255.0::DOUBLE) AS r, list_sum(d[15:38]) / (24 * 255.0::DOUBLE) AS c FROM p)
SELECT vec_id, x AS grid_diff, x AS edge_diff, r AS row_profile_diff, c AS col_profile_diff,
  round(x * 0.5::DOUBLE + x * 0.3::DOUBLE + abs(ag[1] - bg[1]) * 0.1::DOUBLE + abs(ag[2] - bg[2]) * 0.1::DOUBLE, 9) AS combined_score FROM q""",
    "stable_nav_context": f"""
WITH {EVENTS}, n AS (
  SELECT video_id, event_id, ts, (event_id % 6 - 1)::INT AS i, value / 500 AS c, event_type <> 'error' AND event_id % 6 - 1 >= 0 AS ok FROM e
), m AS (
  SELECT *, CASE WHEN ok AND c >= 0.55 THEN i END AS a, CASE WHEN ok AND c >= 0.75 THEN i END AS b, CASE WHEN ok AND c >= 0.85 THEN i END AS d FROM n
)
SELECT event_id, coalesce(a, lag(b, 1) OVER w, lag(b, 2) OVER w, lead(d, 1) OVER w, lead(d, 2) OVER w, -1)::INT AS context_index FROM m WINDOW w AS (PARTITION BY video_id ORDER BY ts, event_id)""",
    "keyframe_topk": f"""
WITH {EVENTS}, f AS (
  SELECT video_id, event_id AS idx, event_type, row_number() OVER (PARTITION BY video_id ORDER BY event_id) - 1 AS p, count(*) OVER (PARTITION BY video_id) AS n FROM e
), s AS (
  SELECT *, p = 0 OR p = n - 1 OR p = n // 2 AS anchor, CASE WHEN p = 0 OR p = n - 1 THEN 3.5 ELSE 0 END::DOUBLE + CASE WHEN p = n // 2 THEN 2.0 ELSE 0 END::DOUBLE
    + least(length(event_type) / 50.0::DOUBLE, 2.5) + least(idx % 4, 3) * 0.8::DOUBLE + CASE WHEN event_type IN ('error', 'click') THEN 1.2 ELSE 0 END::DOUBLE
    + CASE WHEN event_type = 'click' THEN 1.2 ELSE 0 END::DOUBLE + CASE WHEN event_type = 'error' THEN 0.8 ELSE 0 END::DOUBLE AS score FROM f
), r AS (
  SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY anchor DESC, CASE WHEN anchor THEN 0 ELSE round_even(score * 1000, 0) END DESC, p) AS r FROM s
)
SELECT video_id, idx, round(score, 3) AS score FROM r WHERE r <= 8""",
    "html_guard": r"""
SELECT page_id, regexp_matches(lower(coalesce(html, '')), '^\s*(<!doctype html|<html)') AS is_html, regexp_matches(lower(substr(coalesce(html, ''), 20)), '^\s*(<!doctype html|<html)') AS tail_is_html,
  (trim(coalesce(html, '')) <> '' AND NOT regexp_matches(lower(coalesce(html, '')), '^\s*(<!doctype html|<html)')) OR page_id % 3 > 0 AS has_transcript FROM pages""",
} | evidence_sql.ORACLES
