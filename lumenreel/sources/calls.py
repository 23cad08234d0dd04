"""Calls of a language model that a rerun takes up again: answers are logged by a hash of what was asked."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LOG = "__asked string, answer string, error string, tries long, run string"


def _log(spark, log: str) -> DataFrame:
    """What was logged so far; nothing before the first run."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(log)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(_LOG).parquet(log) if there else spark.createDataFrame([], _LOG)


def _answers(spark, log: str) -> DataFrame:
    return _log(spark, log).where("answer is not null").dropDuplicates(["__asked"]).select("__asked", "answer")


def ask_logged(prompts: DataFrame, call: Callable[[str], str], log: str, prompt: str = "prompt", lanes: int = 8, slices: int = 16, tries: int = 3, pause: float = 1.0) -> DataFrame:
    """prompts with answer (null where every try failed, or the prompt is null) and error (why the last try failed).

    `log` is a folder that driver and executors share. Prompts that are equal are asked once; those whose hash is in the
    log are not asked again, so a rerun after a failure asks only for what is missing. What is missing is asked in
    `slices` jobs, each of which appends its answers to the log: a job that is lost costs one slice. At most `lanes`
    calls run at a time; a call is tried up to `tries` times, with pauses that double. Failures are logged as such and asked
    again by the next run.
    Empty table: no rows. Other columns are kept; answer and error are replaced.
    """
    spark = prompts.sparkSession
    kept = prompts.select([c for c in prompts.columns if c not in ("answer", "error")])
    keyed = kept.withColumn("__asked", F.sha2(F.col(prompt), 256))

    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for key, text in zip(part["__asked"], part["text"]):
                answer, wrong, n = None, None, 0
                while answer is None and n < tries:
                    n += 1
                    try:
                        answer = str(call(text))
                    except Exception as e:  # whatever a caller's service raises
                        wrong = f"{type(e).__name__}: {e}"
                        if n < tries:
                            time.sleep(pause * 2 ** (n - 1))
                yield pd.DataFrame({"__asked": [key], "answer": [answer], "error": [None if answer is not None else wrong], "tries": [n]})

    run = uuid.uuid4().hex
    for i in range(slices):
        some = keyed.where(F.col(prompt).isNotNull() & (F.pmod(F.xxhash64("__asked"), F.lit(slices)) == i))
        missing = some.groupBy("__asked").agg(F.first(prompt).alias("text")).join(_answers(spark, log), "__asked", "left_anti")
        told = missing.repartition(lanes).mapInPandas(ask, "__asked string, answer string, error string, tries long")
        told.withColumn("run", F.lit(run)).write.mode("append").parquet(log)
    errors = _log(spark, log).where((F.col("run") == run) & F.col("answer").isNull()).groupBy("__asked").agg(F.max("error").alias("error"))
    out = keyed.join(_answers(spark, log), "__asked", "left").join(errors, "__asked", "left")
    return out.withColumn("error", F.when(F.col("answer").isNull(), F.col("error"))).drop("__asked")
