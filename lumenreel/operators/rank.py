"""Keyframe scores and choice, and word boxes put together to lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenreel.functions import text as T
from lumenreel.functions.rules import PLAIN, RulePack
from lumenreel.operators.align import first_within


def keyframe_score(place: Column, total: Column, ocr: Column, segments: Column, reason: Column) -> Column:
    """Points for ends and middle, recognised text, speech nearby and why the frame was kept."""
    chars = T.count(F.coalesce(ocr, F.lit("")), T.USEFUL)
    r = F.lower(F.coalesce(reason, F.lit("")))
    has = lambda word, points: F.when(F.contains(r, F.lit(word)), points).otherwise(0.0)
    score = F.when((place == 0) | (place == total - 1), 3.5).otherwise(0.0) + F.when(place == F.floor(total / 2), 2.0).otherwise(0.0)
    score = score + F.least(chars / 50.0, F.lit(2.5)) + F.least(segments, F.lit(3)) * 0.8
    return score + F.when(r != "", 1.2).otherwise(0.0) + has("chapter", 1.2) + has("title", 0.8) + has("anchor", 0.6)


def keyframes(frames: DataFrame, limit: int = 8, video: str = "video_id") -> DataFrame:
    """Of each video at most `limit` frames (idx, score): first, middle, last, then the best; a limit below three
    holds anchors first. The rank filter reaches the map side as a group limit."""
    w = Window.partitionBy(video)
    f = frames.withColumn("__n", F.count("*").over(w)).withColumn("__p", F.row_number().over(w.orderBy("idx")) - 1)
    anchor = (F.col("__p") == 0) | (F.col("__p") == F.col("__n") - 1) | (F.col("__p") == F.floor(F.col("__n") / 2))
    order = w.orderBy(F.when(anchor, 0).otherwise(1), F.desc(F.when(anchor, F.lit(0.0)).otherwise(F.rint(F.col("score") * 1000))), "__p")
    return f.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= limit).drop("__n", "__p", "__r")


def nearby_facts(frames: DataFrame, alignment: DataFrame, diagnostics: DataFrame, ocr: DataFrame, video: str = "video_id") -> DataFrame:
    """frames (idx, ts) with what a keyframe's score needs: segments near it (joined by idx), and the first recognised text
    and the first diagnostic (by pos) within 0.3 s."""
    near = alignment.select(video, "idx", F.size("segments").alias("n_segments"))
    out = frames.join(near, [video, "idx"], "left").withColumn("n_segments", F.coalesce("n_segments", F.lit(0)))
    out = first_within(out, ocr.select(video, "ts", "pos", F.col("text").alias("ocr_text")), "ocr_text", video=video)
    return first_within(out, diagnostics.select(video, "ts", "pos", "keep_reason"), "keep_reason", video=video)


def _said(words: DataFrame, least: float) -> DataFrame:
    """Word boxes that hold something and are sure enough."""
    return words.where((F.col("conf") >= least) & (T.strip(F.coalesce("text", F.lit(""))) != "")).withColumn("text", T.strip(F.col("text")))


def _joined_words(*order: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "text"))), lambda w: w["text"]), " ")


def lines_of_words(words: DataFrame, least: float, key: list[str], video: str = "video_id") -> DataFrame:
    """(video, frame_idx, *key, line): word boxes that are sure enough, in input order, put together by key."""
    return _said(words, least).groupBy(video, "frame_idx", *key).agg(_joined_words("pos").alias("line"))


def confident_text(words: DataFrame, least: float = 28.0, video: str = "video_id") -> DataFrame:
    """(video, frame_idx, region, text): the lines of each region of a frame, by block, paragraph and line, cleaned one by
    one and together."""
    lines = lines_of_words(words, least, ["region", "block_num", "par_num", "line_num"], video).withColumn("line", T.kept(T.ocr_text(F.col("line")), lambda x: x != ""))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_num", "par_num", "line_num", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy(video, "frame_idx", "region").agg(T.ocr_text(text).alias("text"))


def document_rows(words: DataFrame, least: float = 18.0, video: str = "video_id") -> DataFrame:
    """(video, frame_idx, row, line): word boxes by the height of their middle in steps of 18, halves to even, and from left
    to right."""
    row = F.rint((F.col("top") + F.col("height") / 2) / 18).cast("int")
    return _said(words, least).withColumn("row", row).groupBy(video, "frame_idx", "row").agg(_joined_words("left", "pos").alias("line"))


def document_lines(words: DataFrame, least: float = 18.0, video: str = "video_id", pack: RulePack = PLAIN) -> DataFrame:
    """(video, frame_idx, lines): of each frame's rows those that belong to a document, as Markdown, from the top."""
    rows = document_rows(words, least, video).withColumn("line", T.kept(T.ocr_text(F.col("line")), lambda x: T.document_line(x, pack)))
    rows = rows.withColumn("line", T.kept(T.markdown_line(F.col("line"), pack), lambda x: x != ""))
    return rows.groupBy(video, "frame_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]).alias("lines"))
