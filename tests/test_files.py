"""Files a video, all or none, and files by byte ranges: read back equal to the tables they come from."""

import os
import time

import pytest
from pyspark.sql import functions as F

from lumenreel.operators import speech
from lumenreel.plans.tables import segments
from lumenreel.sources import files, landing

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def found(path):
    return {os.path.relpath(os.path.join(d, f), path): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(path) for f in names}


def settle(path, want):
    """Tasks of a job that failed may end after it."""
    for _ in range(50):
        if os.listdir(path) == want:
            return
        time.sleep(0.1)
    assert os.listdir(path) == want


@needs_data
def test_a_report_a_video_with_its_pictures(spark, tmp_path):
    picture = tmp_path / "a.jpg"
    picture.write_bytes(b"\xff\xd8x")
    s = speech.normalize_segments(segments(spark, SF))
    v = s.groupBy("video_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "text"))), lambda x: x["text"]), "\n").alias("text"))
    stem = F.concat(F.lit("v"), F.col("video_id").cast("string"))
    copies = F.array(F.struct(F.lit(str(picture)).alias("source"), F.concat(stem, F.lit("/keyframes/frame-001.jpg")).alias("target")))
    files.write_files(v, str(tmp_path / "out"), F.concat(stem, F.lit("/report.md")), landing.file_text(F.col("text"), "none"), copies)
    got, want = found(tmp_path / "out"), {}
    for r in v.collect():
        want[f"v{r['video_id']}/report.md"] = b"\xef\xbb\xbf" + r["text"].strip().encode()
        want[f"v{r['video_id']}/keyframes/frame-001.jpg"] = b"\xff\xd8x"
    assert got == want and sorted(os.listdir(tmp_path)) == ["a.jpg", "out"]


def test_all_or_none(spark, tmp_path):
    out = str(tmp_path / "out")
    write = lambda rows, **kw: files.write_files(spark.createDataFrame(rows, "n string, t string").repartition(3), out, F.col("n"), F.col("t"), **kw)
    for bad in ([("a", "1"), ("../b", "2")], [("a", "1"), (None, "2")], [("a", "1"), ("a", "2")], [("a", "1"), ("/etc/x", "2")]):
        with pytest.raises(Exception):  # noqa: B017
            write(bad)
        assert not os.path.exists(out)
        settle(tmp_path, [])
    write([("a", "1"), ("b/c", None)])
    assert found(out) == {"a": b"1", "b/c": b""}
    with pytest.raises(Exception, match="out"):
        write([("z", "3")])
    assert found(out) == {"a": b"1", "b/c": b""}
    write([("z", "a\r\nb")], overwrite=True)
    assert found(out) == {"z": b"a\r\nb"}
    settle(tmp_path, ["out"])


def test_killed_and_doubled_attempts_leave_whole_files(tmp_path):
    w = files.TextFilesWriter(str(tmp_path / "out"), False)
    rows = [{"name": n, "text": n * 1000, "copies": None} for n in "abc"]

    def killed():
        yield rows[0]
        yield rows[1]
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        w.write(killed())
    assert not os.path.exists(tmp_path / "out")
    messages = [w.write(iter(rows)), None]
    w.write(iter(rows[:2]))  # a copy of the task that is not counted
    w.commit(messages)
    assert found(tmp_path / "out") == {n: n.encode() * 1000 for n in "abc"} and os.listdir(tmp_path) == ["out"]


@needs_data
@pytest.mark.parametrize("size", [7, 61, 32 << 20])
def test_subtitles_read_back_equal_the_segments(spark, tmp_path, size):
    few = 6 if size == 7 else 10**9
    s = segments(spark, SF).where(f"video_id < {few}")
    clean = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    stamp = lambda t: F.format_string("%02d:%02d:%02d,000", (t / 3600).cast("int"), (t / 60 % 60).cast("int"), (t % 60).cast("int"))
    cue = F.concat((F.col("seg_idx") + 1).cast("string"), F.lit("\r\n"), stamp(F.col("start")), F.lit(" --> "), stamp(F.col("end")), F.lit("\r\n<v "), F.col("speaker"), F.lit(">"), clean, F.lit("\r\n\r\n"))
    v = s.groupBy("video_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", cue.alias("c")))), lambda x: x["c"]), "").alias("t"))
    files.write_files(v, str(tmp_path / "srt"), F.concat(F.col("video_id").cast("string"), F.lit(".srt")), F.concat(F.lit("﻿"), F.col("t")))
    back = files.read_ranges(spark, str(tmp_path / "srt"), "subtitles", size=size)
    got = back.select(F.regexp_extract("file", r"(\d+)\.srt$", 1).cast("long"), "start", "end", "speaker", "text").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, s.select("video_id", "start", "end", "speaker", clean).collect()))


@pytest.mark.parametrize("size", [1, 5, 1000])
def test_logs_and_cookies_in_ranges(spark, tmp_path, size):
    (tmp_path / "logs").mkdir()
    log = "[showinfo] n:0 pts_time:1.5 x\nnothing\npts_time:2 pts_time:3.25\n\npts_time:é4"
    (tmp_path / "logs" / "7.log").write_text(log)
    (tmp_path / "logs" / "empty.log").write_text("")
    rows = files.read_ranges(spark, str(tmp_path / "logs"), "scene_log", size=size).orderBy("pos").collect()
    assert [r["ts"] for r in rows] == [1.5, 2.0, 3.25]
    table = landing.scene_times(spark.createDataFrame([(7, log)], "video_id long, log string")).first()["times"]
    assert [r["ts"] for r in rows] == table
    jar = tmp_path / "cookies.txt"
    jar.write_text("# c\n\nh\tT\t/\tF\t0\tsid\tone\nshort\tline\nh\tT\t/\tF\t0\tsid\ttwo\nh\tT\t/\tF\t0\tk\tv")
    got = files.read_ranges(spark, str(jar), "cookies", ["value", "name", "pos"], size)
    assert got.columns == ["value", "name", "pos"]
    last = got.groupBy("name").agg(F.max_by("value", "pos").alias("value"))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, landing.cookies(spark, str(jar)).collect())) == [("k", "v"), ("sid", "two")]
    (tmp_path / "none").mkdir()
    assert files.read_ranges(spark, str(tmp_path / "none"), "cookies").count() == 0


def test_odd_cues(spark, tmp_path):
    vtt = tmp_path / "a.vtt"
    vtt.write_text("WEBVTT\n\n00:01.5 --> 00:02.000 align:start\n<v.loud Ann>Hi <i>you</i>\nthere\n1:00:00.000 --> 01:00:01.000\nlast --> one\n\nNOTE x\n\n00:03.000 --> 00:04.000")
    want = [(1.5, 2.0, "Ann", "Hi you\nthere"), (3.0, 4.0, None, ""), (3600.0, 3601.0, None, "last --> one")]
    for size in (1, 9, 10_000):
        assert sorted(map(tuple, files.read_ranges(spark, str(vtt), "subtitles", ["start", "end", "speaker", "text"], size).collect())) == want
