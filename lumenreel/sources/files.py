"""Files as a Spark source and sink: one text file a video with what lies beside it, and logs, cookie files and subtitles
read by byte ranges. Paths are on a file system that driver and executors mount alike."""

from __future__ import annotations

import contextlib
import os
import re
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

# --- one file a video ----------------------------------------------------------------------------------------

COPIES = "array<struct<source:string,target:string>>"


@dataclass
class Written(WriterCommitMessage):
    files: int


class TextFiles(DataSource):
    """Rows (name, text, copies) as files below a folder, all or none."""

    @classmethod
    def name(cls) -> str:
        return "text_files"

    def schema(self) -> str:
        return f"name string, text string, copies {COPIES}"

    def writer(self, schema: StructType, overwrite: bool) -> TextFilesWriter:
        return TextFilesWriter(self.options["path"], self.options.get("overwrite") == "true")


class TextFilesWriter(DataSourceWriter):
    """Made by the driver, with the folders that tasks write to. An attempt writes each file under a name of its own and then moves it to a folder that no reader knows, where another
    attempt may have put the same one. Once all tasks are done that folder gets its final name by one rename, however
    many files there are."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        job = uuid.uuid4().hex
        self.pending, self.attempts, self.old = (f"{self.path}.{kind}-{job}" for kind in ("pending", "attempts", "old"))
        os.makedirs(self.pending)
        os.mkdir(self.attempts)

    def _place(self, name: str | None) -> str:
        parts = (name or "").split("/")
        if any(p in ("", ".", "..") for p in parts):
            raise ValueError(f"not a name below the folder: {name!r}")
        place = self.pending
        for p in parts[:-1]:
            place = os.path.join(place, p)
            with contextlib.suppress(FileExistsError):
                os.mkdir(place)
        return os.path.join(place, parts[-1])

    def write(self, iterator: Iterator) -> Written:
        own, n = os.path.join(self.attempts, uuid.uuid4().hex), 0
        os.mkdir(own)
        half = os.path.join(own, "file")
        for row in iterator:
            with open(half, "w", encoding="utf-8", newline="") as f:
                f.write(row["text"] or "")
            os.replace(half, self._place(row["name"]))
            for c in row["copies"] or []:
                shutil.copyfile(c["source"], half)
                os.replace(half, self._place(c["target"]))
            n += 1 + len(row["copies"] or [])
        return Written(n)

    def commit(self, messages: list) -> None:
        there = sum(len(files) for *_, files in os.walk(self.pending))
        if there != sum(m.files for m in messages if m):
            self.abort(messages)
            raise ValueError("two files have one name; none was written")
        if os.path.exists(self.path):
            if not self.overwrite:
                self.abort(messages)
                raise FileExistsError(self.path)
            os.rename(self.path, self.old)
        os.rename(self.pending, self.path)
        self._drop(self.attempts, self.old)

    def abort(self, messages: list) -> None:
        self._drop(self.pending, self.attempts)

    def _drop(self, *folders: str) -> None:
        """Folders go under another name first, so that tasks that still run find none to write to."""
        for x in folders:
            with contextlib.suppress(FileNotFoundError):
                os.rename(x, x + "-gone")
            shutil.rmtree(x + "-gone", ignore_errors=True)


def write_files(rows: DataFrame, path: str, name: Column, text: Column, copies: Column | None = None, overwrite: bool = False) -> None:
    """Each row as one file `name` below `path` (null text: an empty file), and `copies` (source, target) of files beside it.

    All files appear at once or, after a failure, none; a folder that exists is an error or is replaced as a whole. Two
    files of one name, and names that leave the folder, are errors. For a byte order mark see `landing.file_text`."""
    rows.sparkSession.dataSource.register(TextFiles)
    beside = F.lit(None) if copies is None else copies
    out = rows.select(name.cast("string").alias("name"), text.cast("string").alias("text"), beside.cast(COPIES).alias("copies"))
    out.write.format("text_files").mode("append").option("path", path).option("overwrite", str(overwrite).lower()).save()


# --- files by byte ranges ------------------------------------------------------------------------------------

_PTS = re.compile(r"pts_time:([0-9]+(?:\.[0-9]+)?)")
_CUE = re.compile(r"^\s*(?:(\d+):)?(\d{1,2}):(\d{2})[.,](\d{1,3})\s*-->\s*(?:(\d+):)?(\d{1,2}):(\d{2})[.,](\d{1,3})(?:\s.*)?$")
_VOICE, _TAG = re.compile(r"<v(?:\.\S+)?\s+([^>]+)>"), re.compile(r"<[^>]*>")


def _lines(f, start: int, stop: int | None) -> Iterator[tuple[int, str]]:
    """(offset, line) of the lines that begin in [start, stop); the caller may go on beyond stop."""
    if start:
        f.seek(start - 1)
        f.readline()
    at = f.tell()
    while stop is None or at < stop:
        raw = f.readline()
        if not raw:
            return
        yield at, raw.decode("utf-8", "replace").removeprefix("﻿" if at == 0 else "").rstrip("\r\n")
        at += len(raw)


def _seconds(h: str | None, m: str, s: str, part: str) -> float:
    return (int(h or 0) * 3_600_000 + int(m) * 60_000 + int(s) * 1000 + int(part.ljust(3, "0"))) / 1000


def _scene_log(f, start: int, stop: int) -> Iterator[dict]:
    for at, line in _lines(f, start, stop):
        for m in _PTS.finditer(line):
            yield {"pos": at + m.start(), "ts": float(m[1])}


def _cookies(f, start: int, stop: int) -> Iterator[dict]:
    for at, line in _lines(f, start, stop):
        parts = line.split("\t")
        if line.strip() and not line.startswith("#") and len(parts) >= 7:
            yield {"pos": at, "name": parts[5], "value": parts[6]}


def _cue(at: int, m: re.Match, lines: list[str]) -> dict:
    text = "\n".join(lines)
    voice = _VOICE.search(text)
    return {"pos": at, "start": _seconds(*m.groups()[:4]), "end": _seconds(*m.groups()[4:]), "speaker": voice and voice[1].strip(), "text": _TAG.sub("", text).strip()}


def _subtitles(f, start: int, stop: int) -> Iterator[dict]:
    """A cue belongs to the range in which its line of times begins; its text may reach beyond. It ends at an empty line or at
    the next line of times."""
    open_, texts = None, []
    for at, line in _lines(f, start, None):
        m = _CUE.match(line)
        if open_ and (m or not line.strip()):
            yield _cue(*open_, texts)
            open_, texts = None, []
        if at >= stop and not open_:
            return
        if m:
            open_ = at, m
        elif open_:
            texts.append(line)
    if open_:
        yield _cue(*open_, texts)


KINDS = {
    "scene_log": (_scene_log, "file string, pos long, ts double"),
    "cookies": (_cookies, "file string, pos long, name string, value string"),
    "subtitles": (_subtitles, "file string, pos long, start double, end double, speaker string, text string"),
}


@dataclass
class Range(InputPartition):
    file: str
    start: int
    stop: int


class ByteRanges(DataSource):
    """Files of one kind below a folder; a partition is a range of bytes of one file."""

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return KINDS[self.options["kind"]][1]

    def reader(self, schema: StructType) -> ByteRangesReader:
        return ByteRangesReader(self.options["path"], self.options["kind"], int(self.options.get("size", 32 << 20)), schema.names)


class ByteRangesReader(DataSourceReader):
    def __init__(self, path: str, kind: str, size: int, columns: list[str]):
        self.path, self.kind, self.size, self.columns = path, kind, size, columns

    def partitions(self) -> list[Range]:
        files = [self.path] if os.path.isfile(self.path) else sorted(os.path.join(d, f) for d, _, names in os.walk(self.path) for f in names)
        return [Range(f, a, min(a + self.size, n)) for f in files for n in [os.path.getsize(f)] for a in range(0, n, self.size)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if partition.file:
            with open(partition.file, "rb") as f:
                for row in KINDS[self.kind][0](f, partition.start, partition.stop):
                    yield tuple((row | {"file": partition.file})[c] for c in self.columns)


def read_ranges(spark: SparkSession, path: str, kind: str, columns: list[str] | None = None, size: int = 32 << 20) -> DataFrame:
    """Rows of the scene logs, cookie files or subtitles (SubRip or WebVTT) below `path`, at any depth: file, pos (the offset of
    the row in its file, so that it orders a file's rows) and what the kind holds; only `columns`, if given. Bytes that are
    no UTF-8 are replaced; lines that do not belong to the kind are passed over. A task reads `size` bytes."""
    spark.dataSource.register(ByteRanges)
    kinds = dict(c.split(" ") for c in KINDS[kind][1].split(", "))
    shape = ", ".join(f"{c} {kinds[c]}" for c in columns or kinds)
    return spark.read.format("byte_ranges").schema(shape).option("kind", kind).option("size", str(size)).load(path)
