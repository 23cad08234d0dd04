"""Distributed union-find: connected components of an edge table."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenreel.llm.common import Scratch, chunks, local_roots

#: Neighbour minima are kept once for each salt, so the rows of a hot node meet in several tasks.
SALTS = 8


def _contract(batches):
    """Edges of a task become a forest of stars; memory is bounded by the chunk."""
    for t in chunks(batches, 1_000_000):
        a, b = (t.column(k).to_numpy() for k in ("a", "b"))
        node, root = local_roots(a, b)
        keep = node != root
        yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(root[keep])], names=["a", "b"])


def _with_minimum(pairs: DataFrame, floor: bool) -> DataFrame:
    """pairs (u, v) with m, the least v of each u (and u itself where floor).

    The minima pass a map-side combine; the join is salted, and both of its sides come straight
    from an exchange, so that adaptive execution can split a hot node further.
    """
    least = F.least(F.col("u"), F.min("v")) if floor else F.min("v")
    m = pairs.groupBy("u").agg(least.alias("m"))
    m = m.select("u", "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    return salted.join(m, ["u", "salt"])


def _are_stars(e: DataFrame) -> bool:
    """Whether each node points to one other, and none that is pointed to points on: then rounds are done,
    as every edge goes from a larger node to a smaller one and rounds keep what is connected."""
    counts = e.groupBy("a").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()
    return counts[0] <= 1 and e.join(e.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node that can be reached.

    Alternating large and small stars (O(log^2 n) rounds), after edges were contracted in each task.
    Rounds are written to the shared folder; only a count reaches the driver.
    """
    e = scratch.write(edges.select("a", "b").where("a != b").mapInArrow(_contract, "a long, b long"), "edges")
    while not _are_stars(e):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _with_minimum(both, True).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = scratch.write(large.where("a != b").distinct(), "large")
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        small = _with_minimum(down, False).select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("e"))
        new = scratch.write(small.select("e.a", "e.b").where("a != b").distinct(), "small")
        scratch.drop(e, large)
        e = new
    stars = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def follow(comp: DataFrame, more: DataFrame) -> DataFrame:
    """comp (node, root) with each root replaced by that which `more` (node, root) leads it to, and the nodes that only
    `more` has. A large component is one hot root, so the join is salted by node."""
    to = more.select(F.col("node").alias("__node"), F.col("root").alias("__root"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    salted = comp.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    led = salted.join(to, (F.col("root") == F.col("__node")) & (F.col("salt") == F.col("__salt")), "left")
    return led.select("node", F.coalesce("__root", "root").alias("root")).unionByName(more.join(comp.select("node"), "node", "left_anti"))
