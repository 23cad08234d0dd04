"""Registered queries of sources, timelines, speech, documents, reports and signals, and DuckDB SQL for those that SQL can
express. Their tables stand for video observations as in `catalogue`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenreel.functions import rules
from lumenreel.functions import text as T
from lumenreel.functions.rules import RulePack
from lumenreel.operators import align, dedupe, layout, longchange, rank, report, speech, timeline
from lumenreel.plans.tables import EVENTS, LINES, MOST, SAMPLE, SEGMENTS, doc_lines, events, read, segments
from lumenreel.sources import landing

#: A pack for the invented prose of the tables, so that every kind of rule has lines to act on.
PROSE = RulePack(
    known_terms=[(r"\bthe\b", "THE"), (r"que", "QUE")],
    misreadings=[(r"\bder\b", "DER"), (r"\bon\b", "ON")],
    useful_terms=["the", "que"],
    chunk_titles=[([["THE"], ["and"]], "English talk"), ([["QUE"]], "Spoken in Spanish")],
    other_title="Other talk",
    chunk_summaries={"English talk": "A talk in English."},
    speech_points=[("points", ["THE", "les"], "It has articles."), ("methods", ["QUE"], "It asks."), ("tools", ["ing"], "It goes on."), ("cases", ["zzz"], "It sleeps.")],
    document_terms=["the", "que", "der", "les"],
    control_terms=["is on", "por la"],
    frame_control_terms=["is on", "por la", "de la"],
    refused_lines=[r"(ouair|estio)"],
    line_repairs=[(r"\ban\b", "AN")],
    heading_end=r"(ing|tion)$",
    broken_fragments=[r"^r"],
    fragment_repairs=[(r"tion\b", "TION.")],
    part_triggers=[("source", [" les "]), ("review", [" THE ", " the "]), ("rules", [" que ", " der "])],
    part_headings={"review": "## Review", "source": "## Source", "rules": "## Rules"},
    review_item=r"(ing|tion)",
    rule_code=r"para",
    rule_item=r"^(el|de|die)",
    stale_uncertainties=[(0.0, [["ocr"], ["ing", "tion"]]), (40.0, [["der"], ["les", "en"]])],
)


# --- sources -------------------------------------------------------------------------------------------------


def _raw_source() -> Column:
    k = F.col("page_id") % 5
    feed = F.concat(F.lit("https://www.douyin.com/jingxuan?from=x&modal_id="), F.col("page_id").cast("string"))
    short = F.concat(F.lit("look: https://vm.tiktok.com/Z"), F.col("page_id").cast("string"), F.lit("."))
    return F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit("see "), F.col("url"), F.lit(", then"))).when(k == 2, feed).when(k == 3, short).otherwise("no address here")


def source_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages", "page_id", "url").withColumn("raw", _raw_source())
    url = T.source_input(F.col("raw"))
    return p.select("page_id", T.is_url(F.col("raw")).alias("is_url"), url.alias("resolved"), T.url_host(url).alias("host"), T.page_video_url(url).alias("page_url"), T.short_url(url).alias("is_short"), T.media_suffix(url, F.lit("video/webm; x=1")).alias("suffix"))


def source_help(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages", "page_id", "url")
    i = F.col("page_id")
    errors = F.element_at(F.array(*[F.lit(w.upper()) for w, _ in rules.ERROR_TIPS], F.lit("unknown")), (i % 7 + 1).cast("int"))
    url = F.when(i % 3 == 0, F.concat(F.lit("https://www.tiktok.com/v/"), i.cast("string"))).otherwise(F.col("url"))
    flag = lambda n: i % n == 0
    kind = F.when(flag(4), "Text/HTML; charset=utf-8").when(flag(3), "video/mp4")
    return p.select(
        "page_id", T.download_help(F.col("url"), url, errors).alias("help"), T.direct_media(kind).alias("direct"),
        F.array_join(T.cookie_browsers(F.when(flag(5), "auto").when(flag(3), "brave"), flag(2)), ",").alias("browsers"),
        T.recommended_path(flag(2), flag(3), flag(5), flag(2), flag(7), flag(11)).alias("path"),
        landing.brief(F.col("url"), flag(2), F.when(flag(3), F.lit("t.srt")), flag(6), F.when(flag(2), F.lit("")).otherwise("why?"), F.when(flag(5), F.lit("native"))).alias("brief"),
    )


def cookie_jar(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumnRenamed("event_id", "pos")
    name = F.col("event_type")
    line = F.when(F.col("pos") % 7 == 0, "# a remark").when(F.col("pos") % 11 == 0, "too\tfew").otherwise(F.concat_ws("\t", F.lit("host"), F.lit("TRUE"), F.lit("/"), F.lit("FALSE"), F.lit("0"), name, F.col("pos").cast("string")))
    return landing.cookie_rows(e.select("video_id", "pos", line.alias("line")), "video_id")


def resolved_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    ok = F.col("event_type") == "purchase"
    a = e.select("video_id", F.col("event_id").alias("attempt_no"), F.when(ok, F.concat(F.lit("/v/"), F.col("event_id").cast("string"))).alias("path"), F.when(~ok, F.concat(F.lit("E"), F.col("event_id").cast("string"))).alias("error"))
    return landing.resolve(a).select("video_id", F.coalesce("path", F.lit("")).alias("path"), F.array_join("errors", "|").alias("errors"))


def chosen_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where("event_id % 3 = 0")
    d = e.select("video_id", F.col("event_id").alias("pos"), F.concat("event_type", F.lit(" "), (F.col("event_id") % 10).cast("string")).alias("name"))
    return landing.choose_device(d, ["purchase", "click [0-4]", "view"], "error", "video_id")


def chosen_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where("event_type in ('view', 'click')")
    kind = F.when(F.col("event_id") % 53 == 0, "path").when(F.col("event_id") % 41 == 0, "folder").otherwise("snapshot")
    path = F.when((F.col("event_type") == "view") & (F.col("event_id") % 10 == 0) | (kind != "snapshot"), F.concat(F.lit("/m/"), F.col("event_id").cast("string")))
    rows = e.select("video_id", F.lit("small").alias("name"), kind.alias("kind"), path.alias("path"), F.col("event_id").alias("changed"))
    first = rows.where("kind = 'snapshot'").unionByName(rows.where("kind != 'snapshot'").groupBy("video_id", "name", "kind").agg(F.min("path").alias("path"), F.min("changed").alias("changed")))
    return landing.resolve_model(first, "video_id")


def scene_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.rint(F.col("ts") * 1000).cast("long")
    shown = F.concat(F.lit("frame pts_time:"), F.floor(ms / 1000).cast("string"), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"), F.lit(" x"))
    logs = events(spark, sf_dir).groupBy("video_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", shown.alias("s")))), lambda x: x["s"]), "\n").alias("log"))
    times = landing.scene_times(logs)
    return times.select("video_id", F.posexplode(timeline.gap_filter(F.array_sort(timeline.distinct_times(F.col("times"))), 7200.0)).alias("pos", "ts"))


# --- timelines -----------------------------------------------------------------------------------------------


def filled_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    few = events(spark, sf_dir).where("event_type = 'error'")
    out = timeline.scene_sampling(few, SAMPLE, MOST)
    return out.select("video_id", "budget", F.posexplode("times").alias("pos", "ts"))


def _known_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, duration): every video that has events; most last on after their last one, a few end before it, and the
    duration of some is zero or unknown."""
    k = F.col("video_id")
    end = F.when(k % 10 == 0, 0.0).when(k % 11 == 0, F.lit(None)).when(k % 7 == 0, F.floor("last") / 2).otherwise(F.floor("last") + 40000.0 * (k % 3))
    return events(spark, sf_dir).groupBy("video_id").agg(F.max("ts").alias("last")).select("video_id", end.cast("double").alias("duration"))


def video_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few candidates in videos whose true durations are known; many videos have none."""
    few = events(spark, sf_dir).where("event_type = 'error' and video_id % 3 > 0")
    out = timeline.scene_sampling(few, SAMPLE, MOST, videos=_known_videos(spark, sf_dir))
    return out.select("video_id", "duration", "budget", F.posexplode("times").alias("pos", "ts"))


def uniform_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = events(spark, sf_dir).groupBy("video_id").agg((F.max("ts") / 1000).alias("duration"))
    times = timeline.uniform_times(F.col("duration"), 60.0, 9)
    label = timeline.sampling_label(F.floor("duration"), F.size(times), "auto", 60.0, 9, False)
    return v.select("video_id", label.alias("label"), F.posexplode(times).alias("pos", "ts"))


def all_changes_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = events(spark, sf_dir).groupBy("video_id").agg(F.max("ts").alias("duration"), F.array_sort(F.collect_list("ts")).alias("ts"))
    times = timeline.all_change_times(F.col("ts"), F.col("duration"), 14400.0)
    v = v.withColumn("times", times).withColumn("inner", timeline.without_anchors(F.col("times"), F.col("duration")))
    label = timeline.sampling_label(F.floor("duration"), F.size("times"), "all-changes", 5.0, 9, True, True)
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + F.rint(x * 1000).cast("long"))
    return v.select("video_id", label.alias("label"), F.size("inner").alias("n_inner"), total(F.col("inner")).alias("checksum"), total(F.col("times")).alias("all_checksum"))


def spaced_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments whose texts repeat, so that repeated choices are left out."""
    e = events(spark, sf_dir).select("video_id", F.col("event_id").alias("seg_idx"), F.lit(0.0).alias("start"), F.lit(1.0).alias("end"), F.concat("event_type", (F.col("event_id") % 5).cast("string")).alias("text"))
    return timeline.representative(e, 24).select("video_id", "seg_idx", "text")


# --- speech --------------------------------------------------------------------------------------------------


def speech_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = speech.normalize_segments(segments(spark, sf_dir))
    v = s.select("video_id").distinct().select("video_id", F.concat(F.lit("/v/"), F.col("video_id").cast("string"), F.lit(".mp4")).alias("path"), F.when(F.col("video_id") % 2 == 0, F.lit("local")).alias("transcript_source"))
    v = v.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("video_id"), F.lit("/v/none.mp4").alias("path"), F.lit(None).cast("string").alias("transcript_source")))
    both = [speech.speech_markdown(s, v, mode, pack=PROSE).withColumn("mode", F.lit(mode)) for mode in ("literal", "knowledge")]
    return both[0].unionByName(both[1]).select("video_id", "mode", "segment_count", "markdown")


def speech_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents", "doc_id", "text")
    marked = F.regexp_replace(F.coalesce("text", F.lit("")), r"\. ", "! ")
    s = d.select("doc_id", T.speech_sentences(marked, PROSE).alias("s"))
    notes = T.note_sentences(F.col("s"), ["the", "QUE", "der"], 5)
    return s.select("doc_id", F.size("s").alias("n_sentences"), F.array_join("s", "\n").alias("sentences"), F.array_join(notes, "\n").alias("notes"))


def term_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    return s.select("video_id", "seg_idx", T.common_terms(F.col("text"), PROSE).alias("repaired"), T.known_terms(F.col("text"), PROSE).alias("known"), T.clip_note(F.col("text"), 40, PROSE).alias("clipped"), T.chunk_title(F.col("text"), PROSE).alias("title"), T.document_spacing(F.col("text")).alias("spaced"), T.has_transcript(F.col("text"), F.lit(0)).alias("has_transcript"))


# --- recognised words and documents ------------------------------------------------------------------------------


def _words(spark: SparkSession, sf_dir: str, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """All words of each document as boxes; where they stand follows from line and place. Documents are dealt by id, or by
    (doc_id, frame_idx), before they are cut to words, so that what groups words by video or below moves no word again."""
    frame = (F.col("doc_id") % 3).cast("int").alias("frame_idx")
    d = doc_lines(spark, sf_dir).select("doc_id", *([frame] if "frame_idx" in by else []), "lines").repartition(*by)
    d = d.select("doc_id", F.col("frame_idx") if "frame_idx" in by else frame, F.posexplode("lines").alias("line_num", "line"))
    w = d.select("doc_id", "frame_idx", "line_num", F.posexplode(F.split("line", " ")).alias("at", "text"))
    i = F.col("line_num").cast("long") * 31 + F.col("at")
    pos = F.shiftleft(F.col("line_num").cast("long"), 32) + F.col("at")
    return w.select(
        F.col("doc_id").alias("video_id"), "frame_idx", F.concat(F.lit("r"), (F.col("line_num") % 2).cast("string")).alias("region"), pos.alias("pos"), "text",
        ((i * 37 + F.col("doc_id")) % 100).cast("double").alias("conf"), (F.col("at") * 40).cast("int").alias("left"), (F.col("line_num") * 22 + F.col("at") % 3).cast("int").alias("top"),
        F.lit(36).alias("width"), F.lit(16).alias("height"), F.lit(1).alias("block_num"), (F.col("line_num") % 2).cast("int").alias("par_num"), "line_num",
    )


def confident_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.confident_text(_words(spark, sf_dir)).select("video_id", "region", "text")


def document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.document_rows(_words(spark, sf_dir)).select("video_id", "row", "line")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are dealt by id first: a file that is read in one piece would have all its lines cleaned in one task."""
    lines = doc_lines(spark, sf_dir).repartition("doc_id").select("doc_id", F.posexplode("lines").alias("line_no", "line"))
    return lines.select("doc_id", "line_no", T.document_line(F.col("line"), PROSE).alias("is_document"), T.markdown_line(F.col("line"), PROSE).alias("markdown"), T.document_fragment(F.col("line"), PROSE).alias("fragment"))


def document_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = doc_lines(spark, sf_dir).withColumn("score", T.document_score(F.col("lines"), PROSE.document_terms, PROSE.control_terms))
    return d.select("doc_id", F.round("score", 6).alias("score"), T.document_candidate(F.col("lines"), F.col("score"), 0.1, PROSE).alias("is_candidate"))


def structured_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of every ninth video are too short to stay."""
    line = F.when(F.col("video_id") % 9 == 0, F.substring("text", 1, 5)).otherwise(F.col("text"))
    s = segments(spark, sf_dir).select("video_id", F.col("seg_idx").alias("pos"), line.alias("line"))
    return report.structured_document(s, pack=PROSE)


def literal_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = doc_lines(spark, sf_dir).select((F.col("doc_id") % 20).alias("video_id"), F.col("doc_id").cast("double").alias("ts"), "lines")
    v = d.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("ts", "lines"))).alias("frames"))
    return v.select("video_id", report.literal_document(F.col("frames"), PROSE).alias("markdown"))


def document_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From words to a document: rows, lines, candidates, the best that are not alike, merged and put in parts."""
    lines = rank.document_lines(_words(spark, sf_dir), pack=PROSE).select((F.col("video_id") % 25).alias("video_id"), F.col("video_id").cast("double").alias("ts"), "lines")
    frames = dedupe.document_frames(lines, 8, 0.05, pack=PROSE)
    merged = dedupe.merged_document(frames)
    return report.structured_document(merged, pack=PROSE)


def frame_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = rank.confident_text(_words(spark, sf_dir)).withColumn("region_no", F.substring("region", 2, 1).cast("int"))
    return dedupe.frame_text(texts, pack=PROSE)


# --- reports -------------------------------------------------------------------------------------------------


def report_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model output with text after a heading, numbered items inside a section, a repeated and an unknown heading."""
    s = segments(spark, sf_dir).groupBy("video_id").agg(F.min_by("text", "seg_idx").alias("a"), F.max_by("text", "seg_idx").alias("b"), F.max("end").alias("end"))
    t = lambda *xs: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in xs])
    a, b = F.col("a"), F.col("b")
    out = t("intro\n1. Summary: ", a, "\n## 2. **时间线**\n1. open the file\n2. save it\n  ", b, "\n3. Key spoken points\nold\n7. Nothing\n3. 关键口播点:", b, "\n4. Key visual events\n\n5. visible TEXT\n**Visible text**: ", a, "\n6. Uncertainties\nocr is doing it\n\n", b, "\nder einen les\n")
    parts = report.clean_sections(report.sections(out), F.col("end"), PROSE)
    return s.select("video_id", *[parts[k].alias(k) for k in report.SECTIONS])


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, duration, segs, frames, alignment, read) of each conversation: a frame at every third turn, texts of the
    assistant as recognised text."""
    s = speech.normalize_segments(segments(spark, sf_dir))
    frames = s.where("seg_idx % 3 = 0").select("video_id", F.col("seg_idx").alias("idx"), (F.col("start") + 9).alias("ts"))
    near = align.attach_segments(frames, s, 2.0)
    seg = F.struct("seg_idx", "start", "end", "speaker", "text")
    ocr = F.when(F.col("speaker") == "assistant", F.struct(F.col("start").alias("ts"), "text"))
    a = s.groupBy("video_id").agg(F.array_sort(F.collect_list(seg)).alias("segs"), (F.max("end") + 1).alias("duration"), F.array_sort(F.collect_list(ocr)).alias("read"))
    b = near.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("idx", "ts", "segments"))).alias("alignment"))
    return a.join(b, "video_id", "left").withColumn("alignment", F.coalesce("alignment", F.array().cast(b.schema["alignment"].dataType)))


def local_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _evidence(spark, sf_dir)
    transcript = report.transcript_text(F.col("segs"), None, F.lit(""), 6)
    parts = report.local_sections(F.lit(" What happens? "), F.col("duration"), F.col("alignment"), transcript, F.col("read"), F.when(F.col("video_id") % 2 == 0, "no key"), F.when(F.col("video_id") % 3 == 0, "no sound"))
    e = e.withColumn("parts", parts).withColumn("output", report.sections_text(F.col("parts")))
    path = F.concat(F.lit("/v/"), F.col("video_id").cast("string"), F.lit(".mp4"))
    e = e.withColumn("parsed", report.sections(F.col("output")))
    return e.select("video_id", "output", report.report_markdown(path, F.lit("none"), F.col("duration"), F.col("video_id") % 2 == 0, F.col("parsed"), F.col("output"), F.col("alignment")).alias("markdown"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _evidence(spark, sf_dir)
    transcript = report.transcript_text(F.col("segs"), None, F.lit(""))
    read_text = F.array_join(F.transform("read", lambda r: F.concat(F.lit("["), report.fixed2(r["ts"]), F.lit("s] "), r["text"])), "\n")
    batches = F.array(F.struct(F.lit(1).alias("batch"), F.lit(0.0).alias("start"), F.col("duration").alias("end"), F.size("alignment").alias("frame_count"), F.lit("said").alias("output_text")))
    audio, ask = F.col("video_id") % 2 == 0, F.lit("What happens?")
    one = report.prompt(ask, F.col("alignment"), F.col("duration"), transcript, audio, read_text)
    two = report.prompt(ask, F.col("alignment"), F.col("duration"), transcript, audio, read_text, batches)
    part = report.batch_prompt(F.lit(1), F.lit(2), ask, F.col("alignment"), F.col("duration"), transcript, audio, read_text)
    return e.where(F.size("alignment") > 0).select("video_id", one.alias("prompt"), two.alias("final_prompt"), part.alias("batch_prompt"))


def long_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that is said in one role as one transcript, far longer than a prompt takes: the segments that stand for it."""
    s = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    i = (F.col("conv_id") * 10 + F.col("turn")).cast("int")
    s = s.select(F.col("role").alias("video_id"), i.alias("seg_idx"), i.cast("double").alias("start"), (i + 0.5).alias("end"), F.lit(None).cast("string").alias("speaker"), "text")
    e = speech.normalize_segments(s).groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("seg_idx", "start", "end", "speaker", "text"))).alias("segs"))
    few, some, many = (report.transcript_text(F.col("segs"), None, F.lit(""), n) for n in (5, 24, 80))
    return e.select("video_id", few.alias("few"), some.alias("some"), many.alias("many"))


def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages", "page_id", "url")
    i = F.col("page_id")
    path = F.concat(F.lit("/videos/My \"clip\" "), i.cast("string"), F.when(i % 2 == 0, F.lit(".tar.mp4")).otherwise(F.lit("")))
    kind = F.when(i % 3 == 0, "speech_note").otherwise("video_report")
    found = report.tags(kind, i % 3 == 0, i % 5 == 0, i % 2 == 0, F.when(i % 4 == 0, F.col("url")), F.when(i % 7 == 0, "all-detected-changes (x)"))
    header = report.front_matter({"title": F.initcap(F.replace(kind, F.lit("_"), F.lit(" "))), "source": F.col("url"), "video_path": path, "created": F.lit("2026-01-01T00:00:00+0000")}, found, report.aliases(kind, path))
    body = F.when(i % 6 == 0, F.lit("﻿---\nx: 1\n---\n")).otherwise("﻿# Note")
    return p.select("page_id", report.with_front_matter(body, header).alias("markdown"), landing.file_text(F.when(i % 2 == 0, F.lit(" ")).otherwise("text"), "nothing said").alias("file"))


def keyframe_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("idx", (F.col("event_id") % 1200).cast("int")).withColumn("ts", F.floor("ts") + (F.col("event_id") % 4) * 0.25)
    name = report.keyframe_file(F.col("idx"), F.col("ts"))
    f = F.struct("event_id", "idx", "ts", F.concat(F.lit("/out/"), F.col("event_type"), F.lit("/"), name).alias("path"), F.when(F.col("event_id") % 2 == 0, F.lit("kept-layout-strong")).alias("keep_reason"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("a  word of "), F.col("event_type"))).alias("ocr_text"))
    v = e.groupBy("video_id").agg(F.array_sort(F.collect_list(f)).alias("frames"))
    part = report.keyframe_markdown(F.when(F.col("video_id") % 9 == 0, F.slice("frames", 1, 0)).otherwise(F.col("frames")), F.when(F.col("video_id") % 2 == 0, F.lit("/out/notes/report.md")), 3)
    return v.select("video_id", report.with_keyframes(F.when(F.col("video_id") % 7 == 0, F.lit("# R\n\n## 关键截图\n")).otherwise("# R \n"), part).alias("markdown"))


def keyframe_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    frames = e.where("event_type = 'view'").select("video_id", F.col("event_id").alias("idx"), "ts")
    aligned = e.where("event_type = 'view' and event_id % 3 > 0").select("video_id", F.col("event_id").alias("idx"), F.array_repeat(F.lit(1), (F.col("event_id") % 5).cast("int")).alias("segments"))
    shift = lambda kind, name: e.where(f"event_type = '{kind}'").select("video_id", ((F.floor(F.col("ts") / 900)) * 0.25).alias("ts"), F.col("event_id").alias("pos"), F.concat(F.lit(kind), F.col("event_id").cast("string")).alias(name))
    frames = frames.withColumn("ts", F.floor(F.col("ts") / 900) * 0.25)
    return rank.nearby_facts(frames, aligned, shift("error", "keep_reason"), shift("click", "text")).select("video_id", "idx", "n_segments", F.coalesce("ocr_text", F.lit("")).alias("ocr_text"), F.coalesce("keep_reason", F.lit("")).alias("keep_reason"))


# --- signals -------------------------------------------------------------------------------------------------


def frame_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    x = lambda k: F.abs(F.element_at("embedding", k).cast("double"))
    s = F.struct((x(1) * 3).alias("dark_ratio"), (x(2)).alias("brightness_mean"), (x(3) / 4).alias("edge_strength"), (x(4) * 3).alias("bright_ratio"))
    p = layout.presenter_signal(x(5) * 2, x(6) * 4, x(7) * 5, x(8) * 5, x(9) * 400)
    return e.select("vec_id", layout.transition_like(s).alias("transition_like"), p["presenter_like"].alias("presenter_like"), p["confidence"].alias("confidence"))


def nav_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    words = e.select("video_id", (F.col("event_id") % 8).cast("int").alias("frame_idx"), F.col("event_id").alias("pos"), F.upper("event_type").alias("text"), (F.col("value") % 97 - 3).alias("conf"), (F.col("event_id") % 900).cast("int").alias("left"), F.lit(60).alias("width"))
    k = F.col("frame_idx")
    bands = words.select("video_id", "frame_idx").distinct().select("video_id", "frame_idx", F.lit(1000).alias("width"), (F.lit(40.0) + k * 2).alias("brightness"), F.array(*[((k * m) % 7 * 10 + m).cast("double") for m in (1, 2, 3, 5)]).alias("segment_means"))
    labels = ["view", "click", "purchase", "error"]
    out = layout.nav_signals(words, bands, labels, [0.1, 0.35, 0.6, 0.85], [("vie", "view"), ("click", "click"), ("purch", "purchase"), ("err", "error")])
    return out.select("video_id", "frame_idx", F.array_join("nav.labels", ",").alias("labels"), F.array_join("nav.detected_labels", ",").alias("detected"), F.col("nav.active_index").alias("active_index"), F.col("nav.active_label").alias("active_label"), F.col("nav.confidence").alias("confidence"), F.col("nav.nav_present").alias("nav_present"))


def title_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _words(spark, sf_dir, ("doc_id", "frame_idx")).withColumns({"width": (F.length("text") * 12).cast("int"), "height": (16 + F.col("line_num") % 3 * 20).cast("int")})
    # a line holds a word at least, so the frames are known without cutting lines
    shown = read(spark, sf_dir, "documents", "doc_id", "text").where(F.col("text").rlike("[^\n]"))
    bands = shown.select(F.col("doc_id").alias("video_id"), (F.col("doc_id") % 3).cast("int").alias("frame_idx")).distinct().withColumns({"width": F.lit(1280), "height": F.lit(400)})
    t = F.col("title")
    return layout.title_blocks(words, bands).select("video_id", t["text"].alias("text"), t["title_block_like"].alias("title_block_like"), F.round(t["candidate_score"], 6).alias("candidate_score"))


def region_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where("event_type = 'purchase'").select("event_id", (F.col("event_id") % 1900 + 20).cast("int").alias("width"), (F.col("event_id") % 1000 + 20).cast("int").alias("height"))
    return layout.regions(e).select("event_id", "region_no", "region", "left", "top", "right", "bottom")


def ocr_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents", "doc_id", "lang")
    have = F.array_compact(F.array(F.when(F.col("doc_id") % 2 == 0, F.lit("eng")), F.when(F.col("doc_id") % 3 == 0, F.lit("chi_sim")), F.col("lang")))
    return d.select("doc_id", T.ocr_languages(have).alias("languages"), T.nav_label(F.concat(F.lit("Open Claw "), F.coalesce("lang", F.lit("")))).alias("label"))


def change_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenreel.plans.catalogue import change_frames

    f = change_frames(spark, sf_dir)
    on = {"title": True, "nav": True, "dedupe": True}
    return layout.diagnostics(f, layout.change_filter(f, presenter=True, **on), **on)


def long_change_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdicts of `change_filter`, each video in parts that fold side by side."""
    from lumenreel.plans.catalogue import change_frames

    out = longchange.change_filter(change_frames(spark, sf_dir), title=True, nav=True, presenter=True, dedupe=True)
    return out.select("video_id", "ts", "keep_reason", "kept", F.round("combined_score", 9).alias("combined_score"))


QUERIES = {
    f.__name__: f
    for f in (
        source_resolution, source_help, cookie_jar, resolved_sources, chosen_devices, chosen_models, scene_logs, filled_timeline, video_timeline, uniform_timeline,
        all_changes_timeline, spaced_segments, speech_markdown, speech_sentences, term_repairs, confident_text, document_rows, document_lines,
        document_candidates, structured_document, literal_document, document_extract, frame_text, report_sections, local_report, prompts, long_transcripts,
        front_matter, keyframe_files, keyframe_facts, frame_flags, nav_signals, title_blocks, region_boxes, ocr_languages, change_diagnostics, long_change_filter,
    )
}
