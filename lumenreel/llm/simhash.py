"""SimHash near-duplicates by a hierarchical Gray-order index over masked bit patterns.

The index is a tree. An upper node is a mask and the bits that its fingerprints share under it. The
first levels are spread over the cluster: 64 bits fall into four blocks, and of two fingerprints that
differ in at most three bits one block is equal; the rest is cut into four again, and so on. So every
link is below some node (mask, pattern), and each node can be searched by itself. Below such a node the
fingerprints are sorted by Gray rank, neighbours are grouped, and a group is pruned as a whole once the
differences gathered from its shared bits exceed the bound.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenreel.llm.common import Scratch, chunks, local_roots, lower_words, ragged, signed, text_bytes, unsigned
from lumenreel.llm.graph import components

SEED = 42
BITS = 64
#: Differing bits of a link.
NEAR = 3
#: A node of the spread levels with more fingerprints is cut into its four children.
LEAF = 2048
#: Children of a node of the Gray-order tree.
FAN = 8
#: Rows searched at once in a task.
CHUNK = 200_000

_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)


def shingle_hashes(text: bytes, width: int = 3) -> np.ndarray:
    """XXH64 of every shingle of `width` words, repeats included; fewer words: the whole sequence."""
    w = lower_words(text)
    if not w:
        return np.zeros(0, np.uint64)
    n = max(1, len(w) - width + 1)
    grams = map(b" ".join, zip(*(w[i:] for i in range(width)))) if len(w) >= width else [b" ".join(w)]
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n)


def majority(group: list[np.ndarray]) -> np.ndarray:
    """The fingerprint of each array of hashes."""
    counts = np.array([len(h) for h in group])
    hashes = np.concatenate(group)
    row = np.repeat(np.arange(len(group)) * 256, counts)
    packed = hashes.view(np.uint8).reshape(-1, 8)
    bits = np.empty((len(group), 8, 8))
    for byte in range(8):
        seen = np.bincount(row + packed[:, byte], minlength=256 * len(group)).reshape(-1, 256)
        bits[:, byte] = seen @ _BYTE_BITS
    ones = (2 * bits > counts[:, None, None]).astype(np.uint64)
    shift = (np.arange(8)[:, None] * 8 + np.arange(8)).astype(np.uint64)
    return (ones << shift).sum((1, 2), dtype=np.uint64)


def fingerprints(texts: list[bytes], width: int = 3) -> np.ndarray:
    """A bit is 1 if set in over half of a text's hashes. No words: 0."""
    out = np.zeros(len(texts), np.uint64)
    at = 0
    while at < len(texts):
        group: list[np.ndarray] = []
        n = 0
        while at + len(group) < len(texts) and len(group) < 256 and n < 500_000:
            group.append(shingle_hashes(texts[at + len(group)], width))
            n += len(group[-1])
        out[at : at + len(group)] = majority(group)
        at += len(group)
    return out


def children(mask: int) -> list[int]:
    """The masks one level down: the bits outside the mask in four parts, each added to it."""
    rest = [b for b in range(BITS) if not mask >> b & 1]
    parts = [rest[len(rest) * i // (NEAR + 1) : len(rest) * (i + 1) // (NEAR + 1)] for i in range(NEAR + 1)]
    return [mask | sum(1 << b for b in p) for p in parts]


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of a code word in the order of the reflected Gray code."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def links(fp: np.ndarray, group: np.ndarray, most: int = NEAR, budget: int = 2_000_000):
    """Pairs (i, j), i < j, of one group that differ in at most `most` bits; yields arrays.

    fp is sorted by group and Gray rank. Levels hold (first child, children, mask, pattern); the mask
    has the bits in which all fingerprints below agree. A pair (query, node) lives while the query
    differs from the pattern in at most `most` masked bits, so a whole group goes at once.
    """
    n = len(fp)
    first, count = np.arange(n), np.ones(n, np.int64)
    last = np.arange(n)
    mask, pattern, owner = np.full(n, ~np.uint64(0)), fp, group
    levels = [(first, count, mask, pattern, last)]
    while True:
        new = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        sizes = np.diff(np.r_[new, len(owner)])
        if sizes.max(initial=1) == 1:
            break
        inside = np.arange(len(owner)) - np.repeat(new, sizes)
        first = np.flatnonzero(inside % FAN == 0)
        count = np.diff(np.r_[first, len(owner)])
        both = np.bitwise_and.reduceat(pattern, first)
        any_ = np.bitwise_or.reduceat(pattern, first)
        mask = np.bitwise_and.reduceat(mask, first) & ~(both ^ any_)
        last = last[first + count - 1]
        pattern, owner = both & mask, owner[first]
        levels.append((first, count, mask, pattern, last))
    root = np.searchsorted(owner, group)  # one node a group is left
    sizes = np.bincount(np.searchsorted(owner, group), minlength=len(owner))[root]
    queries = np.flatnonzero(sizes > 1)
    edges = np.searchsorted(np.cumsum(sizes[queries]), np.arange(budget, int(sizes[queries].sum()) + budget, budget))
    for part in np.split(queries, np.unique(edges)):
        q, node = part, root[part]
        for depth in range(len(levels) - 1, -1, -1):
            _, _, mask, pattern, last = levels[depth]
            alive = (np.bitwise_count((fp[q] ^ pattern[node]) & mask[node]) <= most) & (last[node] > q)
            q, node = q[alive], node[alive]
            if depth:
                first, count = levels[depth][0][node], levels[depth][1][node]
                q, node = np.repeat(q, count), ragged(first, count)
        if len(q):
            yield q, node


def _search(batches):
    """Rows (mask, pattern, fp) sorted by node. kind 0: an edge (a, b) of a forest with the components of the links
    below the nodes at hand, of fingerprints. kind 1: a row of a node that is too large, for the node's child."""
    names = ["kind", "mask", "pattern", "fp", "a", "b"]

    def batch(kind, mask, pattern, fp, a, b):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), signed(mask), signed(pattern), signed(fp), signed(a), signed(b)], names=names)

    def passed_on(mask, fp):
        for m in np.unique(mask):
            here = mask == m
            for child in children(int(m)):
                c = np.uint64(child)
                z = np.zeros(int(here.sum()), np.uint64)
                yield batch(1, np.full(len(z), c), fp[here] & c, fp[here], z, z)

    def searched(mask, pattern, fp):
        start = np.r_[True, (mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1])]
        group = np.cumsum(start) - 1
        sizes = np.bincount(group)[group]
        if (sizes > LEAF).any():
            over = sizes > LEAF
            yield from passed_on(mask[over], fp[over])
        keep = (sizes > 1) & (sizes <= LEAF)
        group, fp = group[keep], fp[keep]
        if not len(fp):
            return
        order = np.lexsort((gray_rank(fp), group))
        group, fp = group[order], fp[order]
        for i, j in links(fp, group):
            a, r = local_roots(fp[i], fp[j])
            a, r = a[a != r], r[a != r]
            z = np.zeros(len(a), np.uint64)
            yield batch(0, z, z, z, a, r)

    held: pa.Table | None = None
    hot: tuple | None = None  # a node whose rows have been passed on so far
    for t in chunks(batches, CHUNK):
        t = t if held is None else pa.concat_tables([held, t])
        mask, pattern, fp = (unsigned(t.column(k)) for k in ("mask", "pattern", "fp"))
        if hot:
            n = int(np.argmin(np.r_[(mask == hot[0]) & (pattern == hot[1]), False]))
            yield from passed_on(mask[:n], fp[:n])
            if n == len(fp):
                held = None
                continue
            hot, t, mask, pattern, fp = None, t.slice(n), mask[n:], pattern[n:], fp[n:]
        ends = np.flatnonzero((mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1]))
        cut = int(ends[-1]) + 1 if len(ends) else 0
        if len(fp) - cut > LEAF:  # the last node is too large already
            yield from passed_on(mask[cut:], fp[cut:])
            hot, held = (mask[-1], pattern[-1]), None
        else:
            held = t.slice(cut)
        if cut:
            yield from searched(mask[:cut], pattern[:cut], fp[:cut])
    if held is not None and held.num_rows:
        yield from searched(*(unsigned(held.column(k)) for k in ("mask", "pattern", "fp")))


_FOUND = "kind int, mask long, pattern long, fp long, a long, b long"


def fingerprint_edges(scratch: Scratch, classes: DataFrame) -> DataFrame:
    """(a, b): a forest with the components of all distinct fingerprints (fp) that differ in at most NEAR bits."""
    masks = [m for top in children(0) for m in children(top)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    nodes = classes.select(F.explode(F.array(*map(F.lit, masks))).alias("mask"), "fp").select("mask", F.expr("fp & mask").alias("pattern"), "fp")
    edges = None
    while True:
        dealt = nodes.select("mask", "pattern", "fp").repartition("mask", "pattern").sortWithinPartitions("mask", "pattern")
        found = scratch.write(dealt.mapInArrow(_search, _FOUND), "found")
        more = found.where("kind = 0").select("a", "b")
        edges = more if edges is None else edges.unionByName(more)
        nodes = found.where("kind = 1")
        if nodes.isEmpty():
            break
    return edges


def simhash_components(scratch: Scratch, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp long, component_id) for every row.

    Exact copies fall together first (map-side combine by fingerprint). Each distinct fingerprint then
    goes to its 16 nodes of two spread levels, 28 shared bits each; a node with over 2048 fingerprints
    is dealt again to its children, whose count is bounded by the bits left, so no group is ever held
    whole. Tasks return forests, never pairs; components come from distributed union-find.

    Null or empty text, or no words: fingerprint 0, linked like any other. Rows with one doc_id are one
    document and join all their classes. A row without an id links like any other, and its component is the
    smallest id that it reaches; null if there is none. Repeated rows come back as often as they stand. Empty
    table: no rows. Other columns are not read.
    """

    def hashed(batches):
        for b in batches:
            fp = fingerprints(b.column("text").to_pylist(), width)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), signed(fp)], names=["doc_id", "fp"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("text"))
    prints = scratch.write(rows.mapInArrow(hashed, "doc_id long, fp long"), "prints")
    classes = scratch.write(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    edges = fingerprint_edges(scratch, classes)
    # The classes of one id are one component: each is joined to the id's least.
    named = prints.where("doc_id is not null").select("doc_id", "fp")
    several = named.groupBy("doc_id").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b < top").select("doc_id", "b")
    same = named.join(several, "doc_id").select(F.col("fp").alias("a"), "b").where("a != b")
    comp = components(scratch, edges.unionByName(same))
    members = scratch.write(comp.join(classes, comp["node"] == classes["fp"]).select("fp", "root", "first"), "members")
    least = members.groupBy("root").agg(F.min("first").alias("least"))
    linked = members.join(least, "root").select("fp", "least")
    named = scratch.write(classes.join(linked, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")), "named")
    return prints.join(named, "fp", "left").select("doc_id", "fp", "component_id")
