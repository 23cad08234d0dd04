"""Centroid clustering of integer vectors: distances by a matrix product, exact sums up a tree of tasks."""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenreel.llm.common import Scratch, bound_batches, release

#: Rows of a block of one matrix product.
BLOCK = 4096
#: Branches of the tree that adds sums up are combined in this many levels below the driver.
DEPTH = 3
LONGEST = (1 << 63) - 1


def floors(x: np.ndarray, factor: int) -> np.ndarray:
    """floor(factor * x) of finite doubles, factor a power of two: long integers, or Python's where one is too large."""
    with np.errstate(over="ignore"):
        y = np.floor(x * factor)
    if not y.size or np.abs(y).max() < float(1 << 62):
        return y.astype(np.int64)
    exact = [int(v) * factor if abs(v) >= 1 << 53 else math.floor(v * factor) for v in x.ravel().tolist()]
    out = np.empty(x.size, object)
    out[:] = exact
    return out.reshape(x.shape)


def largest(x: np.ndarray) -> int:
    """The largest magnitude, as an exact integer."""
    return max(int(x.max()), -int(x.min())) if x.size else 0


def by_product(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances as |x|^2 - 2 x c + |c|^2 in doubles; exact where every sum is an integer below 2^53."""
    a, b = x.astype(np.float64), c.astype(np.float64)
    return ((a * a).sum(1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(1)[None]).astype(np.int64)


def by_integers(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The same in integers: 64 bits where every sum fits, else Python's."""
    far = largest(x) + largest(c)
    kind = np.int64 if x.shape[1] * far * far <= LONGEST else object
    x, c = x.astype(kind), c.astype(kind)
    return np.stack([((x - c[j]) ** 2).sum(1) for j in range(len(c))], 1)


def nearest_centroid(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, the smaller of several; squared distance) of each integer vector.

    Rows and centroids whose components are small enough that no sum of the product reaches 2^53 go through
    the product, in blocks; all other pairs are compared in integers.
    """
    bound = math.isqrt(((1 << 53) - 1) // (4 * max(1, x.shape[1])))
    small = np.flatnonzero([largest(v) <= bound for v in c])
    wide = np.setdiff1d(np.arange(len(c)), small)
    near, far = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for at in range(0, len(x), BLOCK):
        part = x[at : at + BLOCK]
        fits = (np.abs(part) <= bound).all(1) if part.dtype != object else np.array([largest(v) <= bound for v in part])
        for rows, quick in ((np.flatnonzero(fits), True), (np.flatnonzero(~fits), False)):
            if not len(rows):
                continue
            sides = [(small, by_product), (wide, by_integers)] if quick else [(np.arange(len(c)), by_integers)]
            found = []
            for which, distance in sides:
                if len(which):
                    d = distance(part[rows], c[which])
                    best = d.argmin(1)
                    found.append((d[np.arange(len(rows)), best], which[best]))
            d, k = found[0]
            for other, j in found[1:]:
                closer = (other < d) | ((other == d) & (j < k))
                d, k = np.where(closer, other, d), np.where(closer, j, k)
            if d.dtype == object:
                far = far.astype(object)
            near[at + rows], far[at + rows] = k, d
    return near, far


def sums_by_centroid(x: np.ndarray, near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, sum of rows) of each centroid, exact: in long integers where a block's sums fit, else in Python's."""
    count = np.bincount(near, minlength=k)
    kind = np.int64 if x.dtype != object and largest(x) * max(1, len(x)) <= LONGEST else object
    total = np.zeros((k, x.shape[1]), kind)
    for j in np.flatnonzero(count):
        total[j] = x[near == j].astype(kind).sum(0)
    return count.astype(object), total.astype(object)


@dataclass
class Clustering:
    """What rounds end with: the last centroids, Python integers."""

    centroids: np.ndarray

    def digests(self) -> list[str]:
        return [hashlib.sha256(",".join(str(int(v)) for v in c).encode()).hexdigest() for c in self.centroids]


def of_length(vectors: DataFrame, vec_id: str, embedding: str, dim: int) -> DataFrame:
    """(id, e) of the rows with exactly `dim` components, in doubles."""
    v = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("e"))
    return v.where(F.size("e") == dim)


def _blocks(batches: Iterator[pa.RecordBatch], dim: int, factor: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and integer vectors, without rows that hold a null or non-finite component."""
    for b in batches:
        for at in range(0, b.num_rows, 4 * BLOCK):
            part = b.slice(at, 4 * BLOCK)
            x = pc.list_flatten(part.column("e")).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            good = np.isfinite(x).all(1)  # a null came as a NaN
            yield part.column("id").filter(pa.array(good)), floors(x[good], factor)


def cluster(scratch: Scratch, vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, dim: int = 64, factor: int = 64, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, Clustering]:
    """(vec_id, cluster, distance) of every kept vector, and the centroids after the rounds.

    Components become floor(factor * x). Centroids start as the k vectors whose id hashes smallest; a round
    assigns every vector to the nearest centroid (ties: the smaller number) and replaces every non-empty one by
    the floored mean of its vectors. A task hands over one row of k sums, which a tree of tasks adds up; the
    driver gets k sums and counts whatever the input.

    Vectors that are null, of another length, or hold null or non-finite components do not come back. Rows without an id
    are clustered like others but start no centroid; rows that share one are separate vectors (of starts with
    equal ids the smaller vector comes first). Fewer vectors than k: so many centroids. Empty table: no rows. A
    distance beyond a long integer is null; sums and comparisons are exact all the same. Other columns are not
    read.
    """
    bound_batches(scratch.spark)
    v = of_length(vectors, vec_id, embedding, dim)
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = v.where(F.col("id").isNotNull() & finite).select(digest.alias("h"), "e").orderBy("h", "e").limit(k).collect()
    now = floors(np.array([r["e"] for r in first], np.float64).reshape(-1, dim), factor).astype(object)

    def summed(sent):
        def run(batches):
            c = sent.value
            count, total = np.zeros(len(c), object), np.zeros((len(c), dim), object)
            for _, x in _blocks(batches, dim, factor):
                n, s = sums_by_centroid(x, nearest_centroid(x, c)[0], len(c))
                count, total = count + n, total + s
            release()
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((count, total))], pa.binary())], names=["sums"])

        return run

    zero = (0, 0)
    add = lambda a, b: (a[0] + b[0], a[1] + b[1])
    for _ in range(rounds if len(now) else 0):
        sent = scratch.spark.sparkContext.broadcast(now)
        rows = v.mapInArrow(summed(sent), "sums binary").rdd
        count, total = rows.treeAggregate(zero, lambda a, r: add(a, pickle.loads(r["sums"])), add, DEPTH)
        now = np.array([[int(t) // int(n) for t in total[j]] if n else list(now[j]) for j, n in enumerate(count)], object).reshape(-1, dim)
        sent.unpersist()
    sent = scratch.spark.sparkContext.broadcast(now)

    def assigned(batches):
        for ids, x in _blocks(batches, dim, factor):
            near, far = nearest_centroid(x, sent.value)
            far = pa.array(far) if far.dtype != object else pa.array([d if d <= LONGEST else None for d in far.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(near.astype(np.int32)), far], names=["vec_id", "cluster", "distance"])
        release()

    return v.mapInArrow(assigned, "vec_id long, cluster int, distance long"), Clustering(now)


def inertia_of(scratch: Scratch, placed: DataFrame) -> DataFrame:
    """(cluster, cluster_inertia, inertia): distances summed by cluster and over all, one row a cluster; a sum that holds a
    distance beyond a long integer, or is one, is null."""
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    whole = F.when(F.count("*") == F.count("distance"), exact)
    per = placed.groupBy("cluster").agg(whole.alias("s")).collect()  # one row a centroid
    fits = lambda x: None if x is None or x > LONGEST else int(x)
    total = None if any(r["s"] is None for r in per) else sum(r["s"] for r in per)
    return scratch.spark.createDataFrame([(r["cluster"], fits(r["s"]), fits(total)) for r in per], "cluster int, cluster_inertia long, inertia long")


def with_facts(scratch: Scratch, placed: DataFrame, found: Clustering) -> DataFrame:
    """placed with the inertia of its cluster and of all, and the digest of its centroid."""
    placed = scratch.write(placed, "placed")
    names = scratch.spark.createDataFrame(list(enumerate(found.digests())), "cluster int, centroid_sha256 string")
    facts = inertia_of(scratch, placed).join(names, "cluster")
    return placed.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
