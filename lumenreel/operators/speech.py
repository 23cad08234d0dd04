"""Transcript operators: normalising, speakers, chunks, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenreel.functions import text as T
from lumenreel.functions.rules import PLAIN, RulePack


def normalize_segments(raw: DataFrame) -> DataFrame:
    """Null or zero times as the speech sources mean them: start 0, end the start; blank texts go."""
    start = F.coalesce(F.col("start"), F.lit(0.0))
    out = raw.withColumns({"start": start, "end": F.coalesce(F.nullif(F.col("end"), F.lit(0.0)), start), "text": T.strip(F.coalesce("text", F.lit("")))})
    return out.where("text != ''")


def speakers(segments: DataFrame, video: str = "video_id", pack: RulePack = PLAIN) -> DataFrame:
    """(video, rank, speaker, segment_count, start, end, joined, summary, excerpt): start is the first segment's, end the
    largest.

    Sums pass a map-side combine; only a speaker's texts meet, as its result holds them all."""
    s = segments.withColumn("speaker", T.strip(F.coalesce("speaker", F.lit("")))).withColumn("text", T.strip(T.known_terms(F.col("text"), pack))).where("speaker != '' and text != ''")
    texts = F.array_sort(F.collect_list(F.struct("seg_idx", "text")))
    out = s.groupBy(video, "speaker").agg(F.count("*").alias("segment_count"), F.min_by("start", "seg_idx").alias("start"), F.max("end").alias("end"), F.array_join(F.transform(texts, lambda x: x["text"]), " ").alias("joined"))
    out = out.withColumns({"summary": T.chunk_summary(F.col("joined"), pack), "excerpt": T.clip_note(F.col("joined"), 220, pack)})
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(video).orderBy(F.desc("segment_count"), "speaker")))


def chunk_fold(segments: Column, target: int) -> Column:
    """Chunks of an ordered array of (start, end, text): texts are joined until they hold `target` signs, then
    begin anew; what remains at the end is a chunk too."""
    kind = "struct<start:double,end:double,text:string>"
    zero = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.lit(None).cast(kind).alias("open"))

    def step(acc: Column, s: Column) -> Column:
        text = F.when(acc["open"].isNull(), s["text"]).otherwise(F.concat_ws(" ", acc["open"]["text"], s["text"]))
        now = F.struct(F.coalesce(acc["open"]["start"], s["start"]).alias("start"), s["end"].alias("end"), text.alias("text")).cast(kind)
        full = F.length(text) >= target
        return F.struct(F.when(full, F.array_append(acc["done"], now)).otherwise(acc["done"]).alias("done"), F.when(~full, now).alias("open"))

    close = lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["open"]))
    return F.aggregate(segments, zero, step, close)


def chunks(segments: DataFrame, target: int = 420, video: str = "video_id", pack: RulePack = PLAIN) -> DataFrame:
    """(video, chunk_idx, start, end, text, title)."""
    one = _chunked(segments, target, video, pack)
    out = one.select(video, F.posexplode("chunks").alias("chunk_idx", "c"))
    return out.select(video, "chunk_idx", "c.start", "c.end", "c.text", T.chunk_title(F.col("c.text"), pack).alias("title"))


def _chunked(segments: DataFrame, target: int, video: str, pack: RulePack) -> DataFrame:
    """(video, segs, chunks): ordered segments of each video, and their chunks."""
    s = segments.withColumn("text", T.strip(T.known_terms(F.col("text"), pack))).where("text != ''")
    one = s.groupBy(video).agg(F.array_sort(F.collect_list(F.struct("seg_idx", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), "text"))).alias("segs"))
    return one.withColumn("chunks", chunk_fold(F.col("segs"), target))


NOT_TRANSCRIBED = "# 博主口播整理\n\n未从视频音轨中提取到稳定的口播转写。"


def speech_markdown(segments: DataFrame, videos: DataFrame, mode: str = "knowledge", target: int = 420, video: str = "video_id", pack: RulePack = PLAIN) -> DataFrame:
    """videos (path, transcript_source) with segment_count and the Markdown of what is said: mode "literal" holds the
    chunks by time, "knowledge" points, methods, tools and cases before them. Videos without segments say so.

    Segments are normalised ones. What meets in a row is what the row's text holds anyway."""
    label = T.timestamp_label
    one = _chunked(segments, target, video, pack)
    counts = segments.groupBy(video).agg(F.count("*").alias("segment_count"), F.min_by("start", "seg_idx").alias("__first"), F.max_by("end", "seg_idx").alias("__last"))
    who = speakers(segments, video, pack)
    people = F.transform(F.array_sort(F.collect_list(F.struct("rank", "speaker", "segment_count", "start", "end", "summary", "excerpt"))), lambda x: x)
    who = who.groupBy(video).agg(people.alias("people"))
    rows = videos.join(counts, video, "left").join(one.select(video, "chunks"), video, "left").join(who, video, "left")
    span = lambda x: F.concat(label(x["start"]), F.lit(" - "), label(x["end"]))
    code = lambda name, value: F.concat(F.lit(f"- {name}: `"), value, F.lit("`"))
    covered = F.concat(F.lit("- 覆盖时间: `"), label(F.col("__first")), F.lit("` - `"), label(F.col("__last")), F.lit("`"))
    path = F.coalesce(F.col("path"), F.lit(""))
    count = F.col("segment_count").cast("string")
    people, parts = F.col("people"), F.col("chunks")
    none = F.array().cast("array<string>")
    several = lambda lines: F.when(F.size(people) >= 2, lines).otherwise(none)
    lit = lambda *xs: F.array(*[F.lit(x) for x in xs])
    if mode == "literal":
        about = F.transform(people, lambda p: F.concat(F.lit("- "), p["speaker"], F.lit("（"), span(p), F.lit("，"), p["segment_count"].cast("string"), F.lit(" 段）: "), p["summary"]))
        said = F.flatten(F.transform(parts, lambda c: F.array(F.lit(""), F.concat(F.lit("### "), span(c)), c["text"])))
        head = F.array(F.lit("# 博主口播转写"), F.lit(""), code("来源视频", path), code("转写片段数", count), covered, F.lit(""), F.lit("## 按时间整理"))
        lines = F.concat(head, several(F.concat(lit("", "## 说话人概览"), about)), said)
    else:
        points = T.speech_points(F.array_join(F.transform(parts, lambda c: c["text"]), "\n"), pack)
        summed = lambda a, n: F.transform(F.slice(parts, a, n), lambda c: T.chunk_summary(c["text"], pack))
        items = lambda xs, n: F.transform(F.slice(xs, 1, n), lambda x: F.concat(F.lit("- "), x))
        or_else = lambda xs, other: F.when(F.size(xs) > 0, xs).otherwise(other)
        told = F.flatten(F.transform(people, lambda p: F.array(F.concat(F.lit("- "), p["speaker"], F.lit("："), p["summary"], F.lit("（"), span(p), F.lit("，"), p["segment_count"].cast("string"), F.lit(" 段）")), F.concat(F.lit("摘录："), p["excerpt"]))))
        said = F.flatten(F.transform(parts, lambda c: F.array(F.lit(""), F.concat(F.lit("### "), span(c), F.lit(" "), T.chunk_title(c["text"], pack)), F.lit(""), F.concat(F.lit("**整理摘要:** "), T.chunk_summary(c["text"], pack)), F.lit(""), F.concat(F.lit("**原文摘录:** "), c["text"]))))
        source = F.coalesce(F.col("transcript_source"), F.lit("unknown"))
        head = F.array(F.lit("# 博主口播整理为知识 Markdown"), F.lit(""), code("来源视频", path), code("转写来源", source), code("转写片段数", count), covered, F.lit("- 说明: 以下知识标题为自动生成，用于整理口播内容；不是视频画面中的原始标题。"), F.lit(""), F.lit("## 核心观点（生成整理）"))
        body = lambda p: F.concat(
            head, items(or_else(p["points"], summed(1, 3)), 8),
            lit("", "## 方法 / 流程（生成整理）"), items(or_else(p["methods"], summed(2, 3)), 8),
            lit("", "## 工具与系统组件（生成整理）"), or_else(items(p["tools"], 10), lit("- 未识别到稳定的工具或系统组件表述。")),
            lit("", "## 案例与应用场景（生成整理）"), or_else(items(p["cases"], 8), lit("- 未识别到稳定的案例或应用场景表述。")),
            several(F.concat(lit("", "## 说话人分工（基于转写标签）"), told)), lit("", "## 原始口播摘录（带时间戳）"), said,
        )
        lines = T.let(points, body)
    text = F.when(F.coalesce(F.col("segment_count"), F.lit(0)) > 0, F.array_join(lines, "\n")).otherwise(NOT_TRANSCRIBED)
    return rows.select(*videos.columns, F.coalesce("segment_count", F.lit(0)).alias("segment_count"), text.alias("markdown"))


def coverage(segments: DataFrame, videos: DataFrame, video: str = "video_id") -> DataFrame:
    """videos with coverage (share of the duration between first start and last end, null without segments
    or duration) and speaker_count."""
    name = T.strip(F.coalesce("speaker", F.lit("")))
    s = segments.groupBy(video).agg(F.min("start").alias("__a"), F.max("end").alias("__b"), F.count_distinct(F.when(name != "", name)).alias("speaker_count"))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("__b") - F.col("__a")) / F.greatest(F.col("duration"), F.lit(0.001))))
    out = videos.join(s, video, "left")
    return out.withColumn("coverage", F.when((F.col("duration") > 0) & F.col("__a").isNotNull(), share)).withColumn("speaker_count", F.coalesce("speaker_count", F.lit(0))).drop("__a", "__b")
