"""The change filter in parts against the plain fold: random walks, pictures that stand still, ties and odd rows."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lumenreel.operators import layout, longchange
from lumenreel.plans import catalogue, evidence

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
ALL = {"title": True, "nav": True, "presenter": True, "dedupe": True}


def video(rows, spark):
    """Frames (video_id, ts, level, k) with signals that follow from them."""
    f = spark.createDataFrame(rows, "video_id long, ts double, level int, k int")
    grid = F.array_repeat("level", 8)
    word = F.concat(F.lit("title"), (F.col("k") % 4).cast("string"))
    return f.select(
        "video_id", "ts", grid.alias("grid"), F.array_repeat((F.col("level") * 3 % 256).cast("int"), 6).alias("edge_grid"), F.array(F.col("level").cast("double")).alias("row_profile"), F.array(F.lit(0.0)).alias("col_profile"),
        (F.col("level") / 255).alias("brightness_mean"), F.lit(0.1).alias("edge_strength"), (F.col("k") % 11 == 0).alias("transition_like"), (F.col("k") % 3 > 0).alias("title_meaningful"), F.lit(True).alias("title_block_like"),
        F.array(word).alias("title_tokens"), word.alias("title_meaning"), (F.col("k") % 2 == 0).alias("nav_present"), (F.col("k") % 3).cast("int").alias("active_index"), F.lit(0.6).alias("nav_confidence"),
        (F.col("k") % 3).cast("int").alias("context_index"), (F.col("k") % 13 == 0).alias("presenter_like"), F.lit(0.8).alias("presenter_confidence"),
    )


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.fixture(scope="module")
def walks(spark):
    rnd, rows = random.Random(5), []
    for v in range(12):
        level = 100
        for i in range(rnd.choice([1, 2, 3, 40, 150])):
            level = min(255, max(0, level + rnd.choice([0, 0, 0, 4, -4, 30, -60]) * (v % 4)))
            rows.append((v, i * 1.5, level, rnd.randrange(60)))
    return video(rows, spark).cache()


@pytest.mark.parametrize("span", [3.0, 10.0, 1e6])
@pytest.mark.parametrize("on", [{}, ALL])
def test_parts_equal_the_plain_fold(spark, walks, span, on):
    got = longchange.change_filter(walks, span=span, **on)
    assert same(got, layout.change_filter(walks, **on))


def test_a_picture_that_stands_still_takes_no_more_rounds(spark):
    """Slow drift below the threshold and then a jump: every part but two keeps nothing of its own."""
    still = video([(1, float(i), 90 + (i > 500) * 120, 1) for i in range(800)], spark)
    on = layout.rules_on(0.18, 0.35, False, False, False, False)
    _, parts, rounds = longchange.entered_parts(still, on, span=8.0)
    assert parts.count() == 100 and rounds <= 2
    assert same(longchange.change_filter(still, span=8.0), layout.change_filter(still))


def test_odd_rows(spark, walks):
    odd = video([(None, 1.0, 5, 1), (1, None, 5, 1), (1, 2.0, 5, 1), (1, 2.0, 5, 1), (1, -700.0, 200, 1), (2, 0.0, 5, 1)], spark).withColumn("__part", F.lit("x")).withColumn("kept", F.lit(1))
    got = longchange.change_filter(odd).select("video_id", "ts", "keep_reason").collect()
    assert sorted(map(tuple, got)) == [(1, -700.0, "kept-anchor"), (1, 2.0, "kept-anchor"), (1, 2.0, "kept-layout-strong"), (2, 0.0, "kept-anchor")]
    assert longchange.change_filter(walks.limit(0)).count() == 0


@needs_data
def test_query_equals_the_plain_fold(spark):
    assert same(evidence.long_change_filter(spark, SF), catalogue.change_filter(spark, SF))
