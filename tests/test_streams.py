"""Streams against the batch operators: rows out of order, restarts, and state that goes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenreel.operators import align, chains
from lumenreel.streaming.align import stream_attach_segments
from lumenreel.streaming.timed import PROVIDER, timed_gap_filter


@pytest.fixture()
def store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def land(spark, folder, n, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/part={n}")


def read(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def run(df, where):
    q = df.writeStream.format("parquet").option("checkpointLocation", f"{where}/checkpoint").option("path", f"{where}/out").trigger(availableNow=True).start()
    q.awaitTermination(150)
    assert q.exception() is None
    return q


def test_gap_filter_out_of_order_and_restarted(store, tmp_path):
    spark, schema = store, "video_id long, ts double"
    rng = np.random.default_rng(3)
    rows = [(int(v), round(float(t), 3)) for v, t in zip(rng.integers(0, 4, 600), np.sort(rng.uniform(0, 300, 600)))]
    order = np.argsort([t + rng.uniform(0, 8) for _, t in rows])  # up to eight seconds out of order
    parts = np.array_split(order, 5)
    source = f"{tmp_path}/in"
    for n in (0, 1, 2):
        land(spark, source, n, [rows[i] for i in parts[n]], schema)
    run(timed_gap_filter(read(spark, source, schema), 2.5, idle=20.0), tmp_path)
    first = spark.read.parquet(f"{tmp_path}/out").count()
    for n in (3, 4):
        land(spark, source, n, [rows[i] for i in parts[n]], schema)
    land(spark, source, 5, [(99, 1000.0)], schema)  # moves the clock past all others
    land(spark, source, 6, [(99, 2000.0)], schema)
    run(timed_gap_filter(read(spark, source, schema), 2.5, idle=20.0), tmp_path)
    got = [(r["video_id"], r["ts"]) for r in spark.read.parquet(f"{tmp_path}/out").where("video_id < 99").collect()]
    want = chains.gap_filter_rows(spark.createDataFrame(rows, schema), 2.5).collect()
    assert 0 < first < len(got) and sorted(got) == sorted(map(tuple, want))
    held = spark.read.format("statestore").option("stateVarName", "last").load(f"{tmp_path}/checkpoint").select("key.*").collect()
    assert {r[0] for r in held} <= {99}  # ended videos hold no state


def test_segments_of_frames_on_two_streams(store, tmp_path):
    spark = store
    rng = np.random.default_rng(6)
    seg = "video_id long, seg_idx int, start double, end double, speaker string, text string"
    fra = "video_id long, idx int, ts double"
    segments = [(int(rng.integers(0, 3)), i, float(a), float(a + d), None, f"t{i}") for i, (a, d) in enumerate(zip(np.sort(rng.uniform(0, 200, 60)), rng.uniform(0, 20, 60)))]
    frames = [(int(rng.integers(0, 3)), i, float(t)) for i, t in enumerate(np.sort(rng.uniform(0, 220, 80)))]
    for n, part in enumerate(np.array_split(np.arange(60), 3)):
        land(spark, f"{tmp_path}/seg", n, [segments[i] for i in part], seg)
    for n, part in enumerate(np.array_split(np.arange(80), 3)):
        land(spark, f"{tmp_path}/fra", n, [frames[i] for i in part], fra)
    for n in (7, 8):  # the clock runs on
        land(spark, f"{tmp_path}/seg", n, [(9, 900 + n, 1000.0 * n, 1000.0 * n, None, "")], seg)
        land(spark, f"{tmp_path}/fra", n, [(9, 900 + n, 1000.0 * n)], fra)
    out = stream_attach_segments(read(spark, f"{tmp_path}/fra", fra), read(spark, f"{tmp_path}/seg", seg), 4.0, longest=30.0, delay="200 seconds")
    q = run(out, tmp_path)
    got = [(r["video_id"], r["idx"], r["segment"] and r["segment"]["seg_idx"]) for r in spark.read.parquet(f"{tmp_path}/out").where("idx < 900").collect()]
    batch = align.attach_segments(spark.createDataFrame(frames, fra), spark.createDataFrame(segments, seg), 4.0)
    want = [(r["video_id"], r["idx"], s and s["seg_idx"]) for r in batch.collect() for s in (r["segments"] or [None])]
    assert sorted(got, key=str) == sorted(want, key=str)
    rows = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert rows < 20  # what can meet no more is gone
