"""Sharding by a k-d tree over row metadata, in DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenreel.llm.common import Scratch

#: A coordinate is 30 bits of place in its dimension's range and 32 bits that settle ties.
PLACE, TIE = 30, 32
#: Bins that a pass deals a node's range to.
BINS = 4096
#: Copies of one text stay together up to this share of a shard; larger groups are dealt row by row.
HEAVY = 1 / 16
#: Nodes of a level that are sent to all tasks (a few MB); beyond, no node is hot and the join is shuffled.
SENT_NODES = 1 << 16
#: A cut that is off by this share of a leaf's bytes at most is not refined.
FINE = 0.002
#: Rows numbered by one task.
SLOT_ROWS = 20_000


def _number(col: Column, kind: str) -> Column:
    """An order-keeping number; a string counts by its first six bytes, null as least."""
    if kind == "string":
        lead = F.rpad(F.hex(F.substring(col.cast("binary"), 1, 6)), 12, "0")
        return F.coalesce(F.conv(lead, 16, 10).cast("double"), F.lit(0.0))
    n = col.cast("double")
    return F.when(n.isNull() | F.isnan(n), F.lit(0.0)).otherwise(n)


def kd_shards(scratch: Scratch, docs: DataFrame, shards: int | None = 16, target_bytes: int | None = None, dims: tuple[str, ...] = ("source", "lang", "n_chars"), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard) for every row.

    The tree: a node is split along the dimension in which its rows spread widest (as a share of the
    whole range), at the median weighted by bytes, until there are `shards` leaves or each leaf has
    at most `target_bytes`. All nodes of a level are measured together. The median is found by radix
    over bin sums with map-side combine, so no node's rows are sorted or meet in one task. Nodes, cuts and
    bin sums are tables, however many there are; the driver sees one row of limits. Shards of one parent are
    neighbours.

    Equal texts have one point (that of their smallest row) and stay together unless the group holds
    over 1/16 of a shard's bytes; then its rows are dealt one by one, so a hot group splits.
    Null text: empty; null metadata: least in its dimension; null doc_id: kept. Empty table: no rows.
    A dimension that docs lacks is left out.
    """
    kinds = dict(docs.dtypes)
    dims = tuple(d for d in dims if d in kinds) or (doc_id,)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).cast("long").alias("text_crc32"), F.xxhash64(body).alias("g"), *[_number(F.col(d), kinds[d]).alias(f"c{i}") for i, d in enumerate(dims)])
    cs = [f"c{i}" for i in range(len(dims))]
    rows = scratch.write(base, "rows")
    lim = rows.agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), *[f(c).alias(f"{w}{c}") for c in cs for w, f in (("lo", F.min), ("hi", F.max))]).first()
    leaves = shards if target_bytes is None else max(1, -(-(lim["bytes"] or 0) // target_bytes))
    if not lim["n"]:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"))
    heavy = lim["bytes"] / leaves * HEAVY
    many = rows.groupBy("g").agg(F.count("*").alias("n"), F.sum("size").alias("w"), F.min(F.struct("doc_id", *cs)).alias("m")).where(f"n > 1 and w <= {heavy}")
    light = scratch.write(many.select("g", "m"), "groups")
    big = scratch.write(rows.groupBy("g").agg(F.sum("size").alias("w"), F.count("*").alias("n")).where(f"n > 1 and w > {heavy}").select("g"), "heavy")
    # At most leaves / HEAVY groups can be heavy: the lookup has a proven bound.
    p = rows.join(light, "g", "left").join(F.broadcast(big.withColumn("own", F.lit(True))), "g", "left")
    tie = F.when(F.col("own"), F.xxhash64("doc_id", "g")).otherwise(F.xxhash64(F.col("g")))

    def key(c: str) -> Column:
        lo, hi = lim[f"lo{c}"], lim[f"hi{c}"]
        at = F.coalesce(F.col(f"m.{c}"), F.col(c))
        place = F.floor((at - lo) / (hi - lo) * float((1 << PLACE) - 1)) if hi > lo else F.lit(0)
        return F.shiftleft(place.cast("long"), TIE).bitwiseOR(F.shiftrightunsigned(tie, 64 - TIE))

    points = scratch.write(p.select("doc_id", "size", "text_crc32", "g", *[key(c).alias(c) for c in cs], F.lit(1).cast("long").alias("node")), "points")
    nodes = scratch.spark.range(1).select(F.lit(1).cast("long").alias("node"), F.lit(leaves).cast("long").alias("leaves"), F.lit(0).cast("long").alias("first"))
    depth = (leaves - 1).bit_length()
    for level in range(depth):
        cuts = _cuts(scratch, points, nodes, cs, level, FINE * lim["bytes"] / leaves)
        along = _along(cs)
        right = F.coalesce(along >= F.col("cut"), F.lit(False))
        moved = F.when(F.col("cut").isNull(), F.col("node")).otherwise(F.col("node") * 2 + right.cast("long"))
        points = points.join(_sent(cuts, level), "node", "left").withColumn("node", moved).drop("dim", "cut")
        if level % 2:
            points = scratch.write(points, f"level{level}")
        left = F.ceil(F.col("leaves") / 2)
        halves = F.array(F.struct((F.col("node") * 2).alias("node"), left.alias("leaves"), F.col("first")), F.struct((F.col("node") * 2 + 1).alias("node"), (F.col("leaves") - left).alias("leaves"), (F.col("first") + left).alias("first")))
        whole = F.array(F.struct("node", "leaves", "first"))
        nodes = nodes.select(F.explode(F.when(F.col("leaves") > 1, halves).otherwise(whole)).alias("n")).select("n.*")
    return points.join(_sent(nodes.select("node", F.col("first").cast("int").alias("shard")), depth), "node").select("doc_id", "size", "text_crc32", "shard")


def _sent(nodes: DataFrame, level: int) -> DataFrame:
    """A table of at most 2^level nodes, broadcast while that bounds it."""
    return F.broadcast(nodes) if 1 << level <= SENT_NODES else nodes


def _along(cs: list[str]) -> Column:
    return F.element_at(F.array(*cs), F.col("dim"))


def _cuts(scratch: Scratch, points: DataFrame, nodes: DataFrame, cs: list[str], level: int, fine: float) -> DataFrame:
    """(node, dim, cut) of the nodes with several leaves: the widest dimension, and the coordinate from which rows go
    right. Each pass deals what is left of a node's range to BINS bins and goes on in the one that holds the median;
    a node is done once its cut is near enough or its bin holds one coordinate."""
    open_ = nodes.where("leaves > 1").select("node", "leaves")
    ends = F.array(*[F.struct((F.max(c) - F.min(c)).alias("wide"), F.lit(-i).alias("dim"), F.min(c).alias("lo"), F.max(c).alias("hi")) for i, c in enumerate(cs)])
    stat = points.join(_sent(open_, level), "node").groupBy("node", "leaves").agg(F.sum("size").alias("w"), F.array_max(ends).alias("at"))
    state = stat.select("node", (1 - F.col("at.dim")).alias("dim"), (F.col("w") * F.ceil(F.col("leaves") / 2) / F.col("leaves")).alias("want"), F.lit(0).cast("long").alias("below"), "at.lo", "at.hi")
    state = scratch.write(state, f"state{level}")
    ready = []
    while True:
        here = points.join(_sent(state, level), "node").withColumn("k", _along(cs)).where("k between lo and hi")
        bin_ = F.expr(f"(k - lo) div ((hi - lo) div {BINS} + 1)")
        sums = here.groupBy("node", bin_.alias("bin")).agg(F.sum("size").alias("w"), F.min("k").alias("lo"), F.max("k").alias("hi"), *[F.first(c).alias(c) for c in ("dim", "want", "below")])
        run = F.sum("w").over(Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        sums = sums.withColumn("to", F.col("below") + run).withColumn("from", F.col("to") - F.col("w"))
        cross = sums.where("to >= want").groupBy("node").agg(F.min(F.struct("bin", "from", "to", "lo", "hi", "dim", "want")).alias("at")).select("node", "at.*")
        under, over = F.col("want") - F.col("from"), F.col("to") - F.col("want")
        done = (F.least(under, over) <= fine) | (F.col("lo") == F.col("hi"))
        cut = F.when(done, F.when(under <= over, F.col("lo")).otherwise(F.col("hi") + 1))
        state = scratch.write(cross.select("node", "dim", "want", F.col("from").alias("below"), "lo", "hi", cut.alias("cut")), f"pass{level}")
        ready.append(state.where("cut is not null").select("node", "dim", "cut"))
        state = state.where("cut is null").drop("cut")
        if state.isEmpty():
            return reduce(DataFrame.unionByName, ready)


def number_rows(scratch: Scratch, df: DataFrame, group: str, order: list[str], slot: str = "slot") -> DataFrame:
    """df with row numbers from 0, gapless in each group, in two levels: no group meets in one task."""
    rows = scratch.write(df, "to_number")
    n = rows.count()
    parts = max(1, n // SLOT_ROWS)
    rows = rows.withColumn("__part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    tally = rows.groupBy(group, "__part").agg(F.count("*").alias("__n"))
    base = tally.select(group, "__part", F.coalesce(F.sum("__n").over(Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    base = scratch.write(base, "bases")
    inside = F.row_number().over(Window.partitionBy(group, "__part").orderBy(*order)) - 1
    out = rows.withColumn("__in", inside).join(base, [group, "__part"])
    return out.withColumn(slot, (F.col("__base") + F.col("__in")).cast("long")).drop("__part", "__in", "__base")
