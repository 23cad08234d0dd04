"""What several operators share: scratch tables, bounded Arrow batches, words and local union-find."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: An Arrow batch handed to Python holds about this many bytes at most (plus one row).
BATCH_BYTES = 16 << 20

_fallback: dict[str, str] = {}

try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:
    _libc = None


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where that is unset a folder of our own serves a local master, whose
    tasks run in the driver; on a cluster it is an error, as no executor could read such a folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        key = spark.sparkContext.applicationId
        base = _fallback.setdefault(key, "file://" + tempfile.mkdtemp(prefix="scratch-"))
    return base


class Scratch:
    """Tables written once under the shared folder, so that lineage is cut and a lost executor costs one task.

    Every run has a folder of its own, which goes when the driver ends: until then results may read it. ``drop``
    removes a table that no later plan reads, ``close`` the folder once its results are written.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        bound_batches(spark)
        atexit.register(self.close)

    def write(self, df: DataFrame, tag: str) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{tag}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(t._scratch_path)

    def close(self) -> None:
        atexit.unregister(self.close)
        if self.spark.sparkContext._jsc is not None:  # else the session has ended before
            self._delete(self.root)

    def _delete(self, where: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches are cut by bytes as well as by rows, so long texts cannot fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def text_bytes(col: str = "text") -> Column:
    """The whole text as UTF-8; a null text is an empty one."""
    return F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")


def release() -> None:
    """Give freed memory of this worker back, so that what a reused worker held does not add up."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def lower_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z only (bytes.lower and bytes.split are ASCII)."""
    return text.lower().split()


def n_words(col: str = "text") -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` runs, JVM-side; null counts 0."""
    return F.coalesce(F.regexp_count(F.col(col).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def unsigned(col: pa.Array) -> np.ndarray:
    return col.to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)


def chunks(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches put together to about that many rows."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def runs_of(sizes: np.ndarray, most: int, rows: int) -> Iterator[slice]:
    """Consecutive slices of at most `rows` rows whose sizes sum to at most `most`; a larger row stands alone."""
    at, end = 0, np.cumsum(sizes)
    while at < len(sizes):
        before = end[at - 1] if at else 0
        to = max(at + 1, min(at + rows, int(np.searchsorted(end, before + most, "right"))))
        yield slice(at, to)
        at = to


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Components of edges (a, b): distinct nodes, and the smallest node of the component of each."""
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = code[: len(a)], code[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, before[i], low)
        np.minimum.at(root, before[j], low)
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        if np.array_equal(root, before):
            return nodes, nodes[root]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the runs [start, start + length), one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
