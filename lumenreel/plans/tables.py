"""How the generic tables stand for video observations: as DataFrames, and as the same tables in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SAMPLE, MOST = 21_600.0, 12


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, event_id, event_type, value, ts): ts in seconds since the video's first event."""
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
    e = read(spark, sf_dir, "events", "user_id", "event_id", "event_type", "value", "ts").withColumn("ms", ms)
    rel = F.col("ms") - F.min("ms").over(Window.partitionBy("user_id"))
    return e.select(F.col("user_id").alias("video_id"), "event_id", "event_type", "value", (rel / 1000).alias("ts"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return c.select(F.col("conv_id").alias("video_id"), F.col("turn").cast("int").alias("seg_idx"), (F.col("turn") * 4.0).alias("start"), (F.col("turn") * 4.0 + 3.0).alias("end"), F.col("role").alias("speaker"), "text")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda t: t != "").alias("lines"))


EVENTS = """e0 AS (
  SELECT user_id AS video_id, event_id, event_type, value, epoch_us(ts) // 1000 AS ms FROM events
), e AS (
  SELECT video_id, event_id, event_type, value, (ms - min(ms) OVER (PARTITION BY video_id)) / 1000 AS ts FROM e0
)"""
SEGMENTS = """s AS (
  SELECT conv_id AS video_id, turn::INT AS seg_idx, turn * 4.0::DOUBLE AS start, turn * 4.0::DOUBLE + 3.0::DOUBLE AS end_, role AS speaker, text
  FROM conversations WHERE trim(coalesce(text, '')) <> ''
)"""
LINES = """d AS (
  SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda t: t <> '') AS lines FROM documents
)"""
