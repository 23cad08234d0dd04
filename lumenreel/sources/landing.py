"""Where observations come from and go to. Perception (decoding, recognition, speech, language models) is behind
an adapter that lands tables; nothing here calls it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenreel.functions import text as T

#: The tables that an adapter lands.
SCHEMAS = {
    "sources": "video_id BIGINT, raw STRING, content_type STRING",
    "videos": "video_id BIGINT, path STRING, duration DOUBLE, has_audio BOOLEAN",
    "scene_candidates": "video_id BIGINT, pos INT, ts DOUBLE",
    "frames": "video_id BIGINT, idx INT, ts DOUBLE, path STRING",
    "ocr_words": "video_id BIGINT, frame_idx INT, region STRING, pos INT, text STRING, conf DOUBLE, left INT, top INT, width INT, height INT, block_num INT, par_num INT, line_num INT",
    "ocr_text": "video_id BIGINT, frame_idx INT, ts DOUBLE, text STRING",
    "segments": "video_id BIGINT, seg_idx INT, start DOUBLE, end DOUBLE, speaker STRING, text STRING",
    "model_output": "video_id BIGINT, output_text STRING",
}


def read(spark: SparkSession, path: str, table: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[table]).parquet(path)


def scene_times(logs: DataFrame) -> DataFrame:
    """(video_id, times) from decoder logs (video_id, log)."""
    found = F.regexp_extract_all("log", F.lit(r"pts_time:([0-9]+(?:\.[0-9]+)?)"), F.lit(1))
    return logs.select("video_id", F.transform(found, lambda x: x.cast("double")).alias("times"))


def cookies(spark: SparkSession, path: str) -> DataFrame:
    """(name, value) of a cookie file."""
    return cookie_rows(spark.read.text(path).select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("pos")))


def cookie_rows(lines: DataFrame, *by: str) -> DataFrame:
    """(*by, name, value) of lines (pos, line): seven fields by tab, comments and blank lines skipped, the last one wins."""
    parts = lines.where((T.strip(F.col("line")) != "") & ~F.startswith("line", F.lit("#"))).withColumn("f", F.split("line", "\t")).where(F.size("f") >= 7)
    return parts.groupBy(*by, F.col("f")[5].alias("name")).agg(F.max_by(F.col("f")[6], "pos").alias("value"))


def largest_media(spark: SparkSession, path: str, suffixes: list[str]) -> DataFrame:
    """The largest file with one of the suffixes, at any depth; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(suffixes)).agg(F.max_by("path", "length").alias("path"))


def resolve(attempts: DataFrame) -> DataFrame:
    """(video_id, path, errors) of ordered attempts (attempt_no, path, error): the first that has a path."""
    return attempts.groupBy("video_id").agg(F.min_by("path", F.when(F.col("path").isNotNull(), F.col("attempt_no"))).alias("path"), F.transform(F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("attempt_no", "error")))), lambda e: e["error"]).alias("errors"))


def choose_device(devices: DataFrame, preferred: list[str], rejected: str, *by: str) -> DataFrame:
    """(*by, name): of the devices (pos, name) that are not rejected the one that matches the earliest preferred pattern."""
    rank = F.coalesce(*[F.when(F.lower("name").rlike(p), F.lit(i)) for i, p in enumerate(preferred)], F.lit(len(preferred)))
    ok = devices.where(~F.lower("name").rlike(rejected)).withColumn("__rank", rank)
    return ok.groupBy(*by).agg(F.min_by("name", F.struct("__rank", "pos")).alias("name"))


def resolve_model(candidates: DataFrame, *by: str) -> DataFrame:
    """(*by, model) of candidates (name, kind, path, changed): the path itself if there is one, else a folder of models, else
    the snapshot that changed last, else the name."""
    order = F.when(F.col("path").isNull(), 3).when(F.col("kind") == "path", 0).when(F.col("kind") == "folder", 1).otherwise(2)
    newest = F.when(F.col("kind") == "snapshot", -F.col("changed")).otherwise(F.lit(0))
    return candidates.groupBy(*by).agg(F.min_by(F.coalesce("path", "name"), F.struct(order.alias("o"), newest.alias("n"))).alias("model"))


def ask(batches: DataFrame, call: Callable[[str], str], prompt: str = "prompt") -> DataFrame:
    """batches with output_text from a language model's adapter, a call a row, inside executors."""
    schema = batches.select("*", F.lit("").alias("output_text")).schema

    def calls(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pdf.assign(output_text=[call(p) for p in pdf[prompt]])

    return batches.mapInPandas(calls, schema)


# What a report must hold, and the question where none is asked.
REQUIRED_OUTPUT = ["one_paragraph_summary", "timeline", "key_spoken_points", "key_visual_events", "visible_text", "uncertainties"]
QUESTION = "Summarize what is said and shown over time."


def brief(video_path: Column, video_exists: Column, transcript_path: Column, transcript_exists: Column, question: Column, mode: Column) -> Column:
    """What is to be analysed, as JSON; null fields are written."""
    fields = F.struct(
        video_path.alias("video_path"), video_exists.alias("video_exists"), transcript_path.alias("transcript_path"), (transcript_path.isNotNull() & transcript_exists).alias("transcript_exists"),
        F.coalesce(F.nullif(question, F.lit("")), F.lit(QUESTION)).alias("question"), F.coalesce(mode, F.lit("auto")).alias("mode"), F.array(*map(F.lit, REQUIRED_OUTPUT)).alias("required_output"),
    )
    return as_json(fields)


def as_json(fields: Column) -> Column:
    return F.to_json(fields, {"ignoreNullFields": "false"})


def write_json(df: DataFrame, path: str) -> None:
    """A result as one JSON object a row, null fields written."""
    df.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def file_text(markdown: Column, otherwise: str, mark: bool = True) -> Column:
    """What a Markdown file holds: the text or a remark, after a byte order mark if wanted."""
    text = F.coalesce(F.nullif(T.strip(F.coalesce(markdown, F.lit(""))), F.lit("")), F.lit(otherwise))
    return F.concat(F.lit("\ufeff"), text) if mark else text


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).alias("value")).write.mode("errorifexists").text(path)


def copy_files(files: DataFrame, source: str = "path", target: str = "target") -> DataFrame:
    """(source, target, bytes) of files copied by executors. Both paths must be mounted where executors run."""
    import os
    import shutil

    def copied(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for a, b in zip(pdf[source], pdf[target]):
                os.makedirs(os.path.dirname(b), exist_ok=True)
                shutil.copyfile(a, b)
            yield pd.DataFrame({"source": pdf[source], "target": pdf[target], "bytes": [os.path.getsize(b) for b in pdf[target]]})

    return files.select(source, target).mapInPandas(copied, "source string, target string, bytes long")
