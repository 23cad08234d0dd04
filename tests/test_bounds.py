"""The histogram bound spares ratios and changes no decision; the diverse choice and the choice from arrays."""

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenreel.operators import dedupe, timeline

DOCS = "/root/testdata/sf0.001/documents.parquet"


def document_lines():
    lines = [x.lower().replace(" ", "") for t in pd.read_parquet(DOCS)["text"] for x in (t or "").split("\n")]
    rng = np.random.default_rng(1)
    edited = ["".join(c for c in x if rng.random() > 0.06) for x in lines[:200]]
    long = "".join(rng.choice(list("abcdefgh"), 260))  # popular characters of long texts are passed over by the matcher
    more = ["", "短い行", "短い行と", "tide", "diet", "x" * 9, "x" * 10, long, long[:130] + "z" + long[130:], long[::-1]]
    return [x for pair in zip(lines[:200], edited) for x in pair] + more


@pytest.mark.parametrize("least, hold, most, contained", [(0.9, 8, 12, True), (0.9, 30, None, True), (0.88, 8, None, False)])
def test_decisions_are_those_of_the_plain_matcher(monkeypatch, least, hold, most, contained):
    lines, asked = document_lines(), [0, 0]

    def counted(a, b):
        asked[0] += 1
        return SequenceMatcher(None, a, b).ratio()

    def plain(a, b):
        if not a or not b:
            return False
        if a == b or (contained and min(len(a), len(b)) >= hold and (a in b or b in a)):
            return True
        if contained or min(len(a), len(b)) >= hold:
            asked[1] += 1
            return SequenceMatcher(None, a, b).ratio() >= least
        return False

    monkeypatch.setattr(dedupe, "ratio", counted)
    held, seen = dedupe.Kept(least, hold, most), []
    held.contained = contained
    for text, count in zip(lines, dedupe.histograms(lines)):
        alike = held.alike(text, count)
        assert alike == any(plain(text, x) for x in (seen[-most:] if most else seen))
        if not alike and text:
            held.add(text, count)
            seen.append(text)
    assert len(seen) < len(lines) - 100 and asked[0] < asked[1] / 4  # most ratios are spared


def test_histograms_count_every_character():
    h = dedupe.histograms(["aab", "", "日本😀", "a" * 5000])
    assert h.sum(1).tolist() == [3, 0, 3, 5000] and h[0][ord("a") % 64] == 2


def test_diverse_choice_of_many_frames(spark):
    """One video of 20,000 frames in partitions of one fold; ties go to the earlier frame."""
    line = F.concat(F.lit("a line about topic "), (F.col("id") % 11).cast("string"), F.repeat(F.lit(" word"), (F.col("id") % 11 * 3).cast("int")))
    f = spark.range(20_000).select((F.col("id") % 4 == 3).cast("int").alias("video_id"), F.col("id").cast("double").alias("ts"), (F.col("id") % 7 / 7).alias("score"), F.array(line).alias("lines"))
    got = sorted((r["video_id"], r["ts"]) for r in dedupe.diverse_frames(f, 4).collect())
    want = []
    rows = f.withColumn("d", dedupe.T.document_density(F.col("lines"))).withColumn("b", dedupe.bare(F.col("lines")[0])).toPandas()
    for v, g in rows.groupby("video_id"):
        texts = []
        for r in g.sort_values(["score", "d", "ts"], ascending=[False, False, True]).itertuples():
            if len(texts) < 4 and not any(dedupe.near(r.b, t, 0.9, 30) for t in texts):
                texts.append(r.b)
                want.append((v, r.ts))
    assert got == sorted(want) and len(got) == 8


@pytest.mark.parametrize("most", [0, 1, 4, 6, 7, 8, 24, 80])
def test_choice_from_an_array_equals_the_choice_of_rows(spark, most):
    rows = [(v, i, float(i % 90), float(i % 90) + 1, f"t{i % 45}") for v, n in ((1, 200), (2, 7), (3, 1), (4, 81)) for i in range(n)]
    s = spark.createDataFrame(rows, "video_id long, seg_idx int, start double, end double, text string")
    want = sorted((r["video_id"], r["seg_idx"]) for r in timeline.representative(s, most).collect())
    e = s.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("seg_idx", "start", "end", "text"))).alias("segs"))
    got = e.select("video_id", F.explode(timeline.representative_of(F.col("segs"), most)).alias("s")).select("video_id", "s.seg_idx").collect()
    assert sorted(map(tuple, got)) == want
