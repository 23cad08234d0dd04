"""Approximate nearest neighbours: a navigable small-world hierarchy for each shard, in flat arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenreel.llm.common import Scratch

#: Distinct vectors of a shard (its graph takes some 20 MB at 64 dimensions), and of a block of queries; blocks that share
#: one copy of a shard's graph. A query's cost grows with the number of shards, and inside one with its logarithm.
SHARD = 16_384
BLOCK, BLOCKS = 1024, 8
#: Links of a node in the upper layers (twice as many in the lowest), and beam widths.
LINKS, BUILD_BEAM, SEARCH_BEAM = 16, 80, 128
#: Nodes inserted, or queries searched, together.
TOGETHER = 256


def beam(x: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The best `width` nodes found for each query from its entries, best first: (nodes, similarities).

    All queries step together: each expands its best open node, until none has an open node left
    among its best.
    """
    q = len(queries)
    row = np.arange(q)
    nodes = np.full((q, width), -1, np.int64)
    sims = np.full((q, width), -np.inf, np.float32)
    opened = np.ones((q, width), bool)
    seen = np.zeros((q, len(x)), bool)
    k = min(width, entry.shape[1])
    nodes[:, :k] = entry[:, :k]
    sims[:, :k] = np.einsum("qd,qkd->qk", queries, x[entry[:, :k]])
    sims[:, :k][entry[:, :k] < 0] = -np.inf
    opened[:, :k] = entry[:, :k] < 0
    seen[row[:, None], entry] = True
    live = row
    while len(live):
        open_sims = np.where(opened[live], -np.inf, sims[live])
        best = open_sims.argmax(1)
        ok = open_sims[np.arange(len(live)), best] > -np.inf
        live, best = live[ok], best[ok]
        if not len(live):
            break
        opened[live, best] = True
        near = links[nodes[live, best]]
        fresh = (near >= 0) & ~seen[live[:, None], near]
        seen[live[:, None], np.where(near >= 0, near, nodes[live, best][:, None])] = True
        s = np.einsum("qd,qkd->qk", queries[live], x[near])
        s[~fresh] = -np.inf
        all_sims = np.concatenate([sims[live], s], 1)
        top = np.argsort(-all_sims, 1, kind="stable")[:, :width]
        pick = np.arange(len(live))[:, None]
        sims[live] = all_sims[pick, top]
        nodes[live] = np.concatenate([nodes[live], near], 1)[pick, top]
        opened[live] = np.concatenate([opened[live], ~fresh], 1)[pick, top]
    nodes[sims == -np.inf] = -1
    return nodes, sims


def spread(x: np.ndarray, nodes: np.ndarray, sims: np.ndarray, keep: int) -> np.ndarray:
    """Of candidates sorted by similarity, those nearer to the node than to any kept one; the rest fill up."""
    q, k = nodes.shape
    v = x[nodes]
    between = np.einsum("qid,qjd->qij", v, v)
    kept = np.zeros((q, k), bool)
    count = np.zeros(q, np.int64)
    closest = np.full((q, k), -np.inf, np.float32)
    for i in range(k):
        good = (nodes[:, i] >= 0) & (count < keep) & (sims[:, i] > closest[:, i])
        kept[good, i] = True
        count += good
        closest = np.where(good[:, None], np.maximum(closest, between[:, i]), closest)
    order = np.argsort(np.where(kept, 0, np.where(nodes >= 0, 1, 2)) * k + np.arange(k), 1)[:, :keep]
    out = np.take_along_axis(nodes, order, 1)
    if out.shape[1] < keep:
        out = np.pad(out, ((0, 0), (0, keep - out.shape[1])), constant_values=-1)
    return out


class Hierarchy:
    """Layers of flat neighbour arrays: layer l has one row of links for every node, -1 where there is none."""

    def __init__(self, x: np.ndarray, links: list[np.ndarray], entry: int):
        self.x, self.links, self.entry = x, links, entry

    @classmethod
    def build(cls, x: np.ndarray, seed: int = 7) -> Hierarchy:
        n = len(x)
        level = np.minimum((-np.log(np.random.default_rng(seed).random(n)) / np.log(LINKS)).astype(int), 8)
        order = np.lexsort((np.arange(n), -level))
        top = int(level[order[0]])
        graph = cls(x, [np.full((n, LINKS * (2 if l == 0 else 1)), -1, np.int64) for l in range(top + 1)], int(order[0]))
        at = 1
        while at < n:
            many = min(TOGETHER, at, n - at)
            batch = order[at : at + many]
            batch = batch[level[batch] == level[batch[0]]]  # ordered by level
            graph._insert(batch, int(level[batch[0]]))
            at += len(batch)
        return graph

    def _insert(self, batch: np.ndarray, level: int) -> None:
        x = self.x
        entry = self._descend(x[batch], level)
        among = x[batch] @ x[batch].T
        np.fill_diagonal(among, -np.inf)
        for layer in range(level, -1, -1):
            links = self.links[layer]
            nodes, sims = beam(x, links, x[batch], entry, BUILD_BEAM)
            entry = np.where(nodes[:, :8] >= 0, nodes[:, :8], nodes[:, :1])
            all_nodes = np.concatenate([nodes, np.broadcast_to(batch, among.shape)], 1)
            all_sims = np.concatenate([sims, among.astype(np.float32)], 1)
            best = np.argsort(-all_sims, 1, kind="stable")[:, :BUILD_BEAM]
            sims = np.take_along_axis(all_sims, best, 1)
            nodes = np.where(sims > -np.inf, np.take_along_axis(all_nodes, best, 1), -1)
            chosen = spread(x, nodes, sims, links.shape[1] // (2 if layer == 0 else 1))
            links[batch, : chosen.shape[1]] = chosen
            self._link_back(links, batch, chosen)

    def _link_back(self, links: np.ndarray, batch: np.ndarray, chosen: np.ndarray) -> None:
        to, frm = chosen.ravel(), np.repeat(batch, chosen.shape[1])
        to, frm = to[to >= 0], frm[to >= 0]
        order = np.argsort(to, kind="stable")
        to, frm = to[order], frm[order]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        width = links.shape[1]
        pad = np.full((len(nodes), width + int(count.max(initial=0))), -1, np.int64)
        pad[:, :width] = links[nodes]
        pad[np.repeat(np.arange(len(nodes)), count), width + np.arange(len(to)) - np.repeat(first, count)] = frm
        ordered = np.sort(pad, 1)  # one of each
        twice = np.c_[np.zeros(len(nodes), bool), ordered[:, 1:] == ordered[:, :-1]]
        ordered[twice] = -1
        sims = np.einsum("qd,qkd->qk", self.x[nodes], self.x[ordered])
        sims[ordered < 0] = -np.inf
        best = np.argsort(-sims, 1, kind="stable")[:, : 2 * width]
        sims, near = np.take_along_axis(sims, best, 1), np.take_along_axis(ordered, best, 1)
        links[nodes] = spread(self.x, near, sims, width)

    def _descend(self, queries: np.ndarray, level: int) -> np.ndarray:
        entry = np.full((len(queries), 1), self.entry)
        for layer in range(len(self.links) - 1, level, -1):
            entry = beam(self.x, self.links[layer], queries, entry, 4)[0][:, :1]
        return entry

    def search(self, queries: np.ndarray, width: int = SEARCH_BEAM) -> tuple[np.ndarray, np.ndarray]:
        return beam(self.x, self.links[0], queries, self._descend(queries, 0), width)


def lifted(x: np.ndarray) -> np.ndarray:
    """Scaled, and with one coordinate more, so that all have one norm: then nearest is the largest inner product. The vectors
    of a shard have norms within a factor of two, so that coordinate hides none of the others."""
    x = x / np.abs(x).max()
    norms = (x * x).sum(1)
    return np.c_[x, np.sqrt(np.maximum(norms.max() - norms, 0))].astype(np.float32)


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision; where one passes beyond doubles on the way, in wider numbers."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = x @ q
        wide = ~np.isfinite(out)
        if wide.any():
            out[wide] = (x[wide].astype(np.longdouble) * q.astype(np.longdouble)).sum(1).astype(np.float64)
    return out


def layer_of(e: Column) -> Column:
    """The whole part of the binary logarithm of a vector's norm."""
    most = F.array_max(F.transform(e, F.abs))
    square = F.aggregate(e, F.lit(0.0), lambda a, x: a + (x / most) * (x / most))
    return F.floor(F.log2(most) + F.log2(square) / 2).cast("int")


def _matrix(col: pa.ChunkedArray, dim: int) -> np.ndarray:
    col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def nearest(scratch: Scratch, vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", every: int = 20, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows whose id is divisible by `every`, the k nearest other rows found.

    Equal vectors are one node that carries its k + 1 smallest ids, so copies neither crowd a graph nor
    meet in one task (a partial limit comes before the shuffle); queries that are equal are searched
    once. Distinct vectors are dealt to layers by the power of two below their norm, and in a layer by hash to shards
    of about 16,384; each has its graph, a row of flat arrays, at a scale of its own. So a few very long vectors
    leave the graphs of all others as they were. Blocks of queries meet each shard's graph, and the shards' best
    are merged by query.

    Vectors that are null, empty, zero, or hold null or non-finite components take no part; a query meets
    vectors of its own length. Rows with one id are one candidate. Ties go to the smaller id. Rows with
    a null id are no queries and no candidates. Empty table: no rows. Fewer than k candidates: all. Other
    columns are not read.
    """
    e = F.col(embedding).cast("array<double>")
    v = vectors.select(F.col(vec_id).cast("long").alias("id"), e.alias("e")).where("id is not null and e is not null and size(e) > 0")
    v = v.where(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0))
    v = scratch.write(v.withColumn("e", F.transform("e", lambda x: x + F.lit(0.0))).select("id", "e", F.xxhash64("e").alias("key"), F.size("e").alias("dim")), "vectors")
    least = v.select("key", "id").distinct().withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("r") <= k + 1)
    ids = least.groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    nodes = v.groupBy("key", "dim").agg(F.min("id").alias("id"), F.min("e").alias("e")).join(ids, "key")
    nodes = scratch.write(nodes.select("key", "dim", "e", "ids", layer_of(F.col("e")).alias("layer")), "nodes")
    asked = scratch.write(v.where(F.col("id") % every == 0).groupBy("key", "dim").agg(F.min("e").alias("e")), "asked")
    layers = nodes.groupBy("dim", "layer").agg(F.ceil(F.count("*") / SHARD).alias("shards"))  # one row for each length and power of two
    blocks = max(1, -(-asked.count() // BLOCK))
    groups = -(-blocks // BLOCKS)

    def index(t: pa.Table) -> pa.Table:
        dim = t.column("dim")[0].as_py()
        x = _matrix(t.column("e"), dim)
        order = np.argsort(t.column("key").to_numpy(), kind="stable")
        x = x[order]
        members = t.column("ids").take(pa.array(order)).to_pylist()
        flat = np.full((len(x), k + 1), -1, np.int64)
        held = np.array([len(m) for m in members])
        flat[np.arange(k + 1) < held[:, None]] = np.concatenate(members)
        graph = Hierarchy.build(lifted(x))
        return pa.table({"dim": t.column("dim").slice(0, 1), "layer": t.column("layer").slice(0, 1), "shard": t.column("shard").slice(0, 1), "entry": pa.array([graph.entry], pa.int32()), "x": pa.array([x.tobytes()], pa.binary()), "ids": pa.array([flat.tobytes()], pa.binary()), "held": pa.array([held.astype(np.int32).tobytes()], pa.binary()), "links": pa.array([[g.astype(np.int32).tobytes() for g in graph.links]], pa.list_(pa.binary()))})

    dealt = nodes.join(F.broadcast(layers), ["dim", "layer"]).withColumn("shard", F.pmod(F.xxhash64("key", F.lit(1)), F.col("shards")).cast("int")).drop("shards")
    graphs = scratch.write(dealt.groupBy("dim", "layer", "shard").applyInArrow(index, "dim int, layer int, shard int, entry int, x binary, ids binary, held binary, links array<binary>"), "graphs")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"key": [], "id": [], "score": []}
        if left.num_rows and right.num_rows:
            dim = left.column("dim")[0].as_py()
            x = np.frombuffer(left.column("x")[0].as_py(), np.float64).reshape(-1, dim)
            ids = np.frombuffer(left.column("ids")[0].as_py(), np.int64).reshape(len(x), -1)
            held = np.frombuffer(left.column("held")[0].as_py(), np.int32)
            links = [np.frombuffer(g, np.int32).reshape(len(x), -1).astype(np.int64) for g in left.column("links")[0].as_py()]
            graph = Hierarchy(lifted(x), links, left.column("entry")[0].as_py())
            queries, keys = _matrix(right.column("e"), dim), right.column("key").to_numpy()
            for at in range(0, len(queries), TOGETHER):
                q = queries[at : at + TOGETHER]
                scale = np.abs(q).max(1, keepdims=True)
                found, _ = graph.search(np.c_[q / scale, np.zeros(len(q))].astype(np.float32))
                for i in range(len(q)):
                    near = found[i][found[i] >= 0]
                    score = products(x[near], q[i])
                    best = np.argsort(-score, kind="stable")[: k + 1]
                    some = np.repeat(score[best], held[near[best]])
                    who = ids[near[best]][np.arange(ids.shape[1]) < held[near[best]][:, None]]
                    top = np.lexsort((who, -some))[: k + 1]
                    out["key"].append(np.full(len(top), keys[at + i]))
                    out["id"].append(who[top])
                    out["score"].append(some[top])
        join = lambda k, t: pa.array(np.concatenate(out[k]) if out[k] else [], t)
        return pa.table({"key": join("key", pa.int64()), "id": join("id", pa.int64()), "score": join("score", pa.float64())})

    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    copies = graphs.withColumn("part", each(groups))
    shard_keys = layers.select("dim", "layer", F.explode(F.sequence(F.lit(0), (F.col("shards") - 1).cast("int"))).alias("shard"))
    questions = asked.withColumn("part", F.pmod(F.xxhash64("key", F.lit(2)), F.lit(groups)).cast("int")).join(F.broadcast(shard_keys), "dim")
    found = copies.groupBy("dim", "layer", "shard", "part").cogroup(questions.groupBy("dim", "layer", "shard", "part")).applyInArrow(search, "key long, id long, score double")
    best = Window.partitionBy("key").orderBy(F.desc("score"), "id")
    merged = scratch.write(found.dropDuplicates(["key", "id"]).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1), "found")
    lists = scratch.write(merged.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("r", "id", "score"))).alias("near")), "lists")
    ask = v.where(F.col("id") % every == 0).select("key", F.col("id").alias("query_id")).dropDuplicates(["query_id"])
    own = F.slice(F.filter("near", lambda s: s["id"] != F.col("query_id")), 1, k)
    out = ask.join(lists, "key").select("query_id", F.posexplode(own).alias("p", "s"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("s.id").alias("vec_id"), F.col("s.score").alias("score"))
