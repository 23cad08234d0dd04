"""Near copies of documents: SimHash components and MinHash bands over word shingles, exact Jaccard, union-find.

The components of op1's index hold what differs in at most three of 64 bits. Texts at five-word similarity 0.8 differ in about
ten of them, and no block of a useful width is equal then: bands find these. The sets of shingles decide on both.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenreel.llm.common import Scratch, local_roots, release, signed, text_bytes
from lumenreel.llm.graph import components, follow
from lumenreel.llm.lines import _mix, _pairs, _tiles
from lumenreel.llm.simhash import fingerprint_edges, majority, shingle_hashes

#: Words of a shingle, and the least Jaccard similarity of a link.
WIDTH, SIMILAR = 5, 0.8
#: 24 bands of 4: texts at 0.8 share no band with probability 3e-6.
BANDS, ROWS = 24, 4
#: Columns of a tile's incidence matrix held at once; shingles sketched at once.
COLUMNS, SLICE = 8192, 500_000

_rng = np.random.default_rng(808)
_XOR = _rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_ODD = _rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)


def shingles(text: bytes) -> np.ndarray:
    """The sorted set of a text's shingles, by 64-bit hashes; no words: empty."""
    return np.unique(shingle_hashes(text, WIDTH))


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BANDS keys for each set; none may be empty."""
    h = np.concatenate(sets)
    start = np.cumsum([0, *map(len, sets[:-1])])
    keys = np.zeros((len(sets), BANDS), np.uint64)
    for k in range(BANDS * ROWS):
        least = np.minimum.reduceat((h ^ _XOR[k]) * _ODD[k], start)
        band = k // ROWS
        keys[:, band] = _mix(keys[:, band] * np.uint64(0x100000001B3) + least + np.uint64(band))
    return keys


def is_near(x: np.ndarray, y: np.ndarray) -> bool:
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared >= SIMILAR * (len(x) + len(y) - shared) - 1e-9


def tile_links(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all near sets, from the products of their incidence with shingles."""
    own = np.array([len(x) for x in sets], float)
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), own.astype(np.int64))
    common = count[code] > 1
    row, col = row[common], (np.cumsum(count > 1) - 1)[code[common]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    shared = np.zeros((len(sets), len(sets)))
    for low in range(0, int(col[-1]) + 1 if len(col) else 0, COLUMNS):
        i, j = np.searchsorted(col, [low, low + COLUMNS])
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[row[i:j], col[i:j] - low] = 1
        shared += m @ m.T
    return np.nonzero(np.triu(shared >= SIMILAR * (own[:, None] + own - shared) - 1e-9, 1))


def _sketch(batches):
    """(doc_id, uid, h, n, keys, fp) of every row: h names the set of shingles, fp is the text's fingerprint."""
    names = ["doc_id", "uid", "h", "n", "keys", "fp"]
    for b in batches:
        at, texts = 0, b.column("text")
        while at < b.num_rows:
            hashes: list[np.ndarray] = []
            held = 0
            while at + len(hashes) < b.num_rows and held < SLICE:
                hashes.append(shingle_hashes(texts[at + len(hashes)].as_py(), WIDTH))
                held += len(hashes[-1])
            sets = [np.unique(x) for x in hashes]
            part = b.slice(at, len(sets))
            at += len(sets)
            full = [x for x in sets if len(x)]
            found = iter(band_keys(full).view(np.int64) if full else [])
            keys = pa.array([next(found) if len(x) else None for x in sets], pa.list_(pa.int64()))
            h = np.array([xxhash.xxh64_intdigest(x.tobytes(), 42) for x in sets], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("uid"), signed(h), pa.array([len(x) for x in sets], pa.int64()), keys, signed(majority(hashes))], names=names)
    release()


def _sets(batches):
    for b in batches:
        for at in range(0, b.num_rows, 200):
            part = b.slice(at, 200)
            yield pa.RecordBatch.from_arrays([part.column("h"), pa.array([shingles(x.as_py()).tobytes() for x in part.column("text")], pa.binary())], names=["h", "set"])
    release()


def _verify(batches):
    for b in batches:
        near = [is_near(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(b.column("x"), b.column("y"))]
        ok = pa.array(near, pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok)], names=["a", "b"])
    release()


def _joined(batches):
    """Which components the links of a tile join; rows come sorted by tile."""
    tile, comps, sets = None, [], []

    def done():
        comp = np.array(comps, np.int64)
        i, j = tile_links(sets)
        i, j = i[comp[i] != comp[j]], j[comp[i] != comp[j]]
        if len(i):
            node, root = local_roots(comp[i], comp[j])
            yield pa.RecordBatch.from_arrays([pa.array(node[node != root]), pa.array(root[node != root])], names=["a", "b"])

    for b in batches:
        for *at, comp, x in zip(*(b.column(c).to_pylist() for c in ("key", "near", "far", "comp", "set"))):
            if at != tile:
                if len(sets) > 1:
                    yield from done()
                tile, comps, sets = at, [], []
            comps.append(comp)
            sets.append(np.frombuffer(x, np.uint64))
    if len(sets) > 1:
        yield from done()
    release()


def by_fingerprint(scratch: Scratch, prints: DataFrame) -> DataFrame:
    """(key, h): sets of shingles by the SimHash component of their texts; each component is a bucket as a band's is."""
    texts = scratch.write(prints.where("n > 0").select("fp", "h").distinct(), "fingerprints")
    roots = components(scratch, fingerprint_edges(scratch, texts.select("fp").distinct()))
    own = texts.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
    return own.select(F.xxhash64(F.coalesce("root", "fp"), F.lit("simhash")).alias("key"), "h").distinct()


def near_copies(scratch: Scratch, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, uid, n, component) of every distinct row: uid hashes the row, n counts it.

    Rows are linked at a Jaccard similarity of 0.8 or more of their sets of five-word shingles (fewer words:
    the whole text), exactly compared; equal sets, those without words too, are one node, and so are rows of
    one id. Candidates share a SimHash component or a band of MinHashes. A bucket of more than 16 sets is compared with its lead
    first; all that are not in one component by then are compared in tiles, so no link of a bucket is lost.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(*docs.columns).alias("uid"), text_bytes(text).alias("text"))
    prints = scratch.write(rows.mapInArrow(_sketch, "doc_id long, uid long, h long, n long, keys array<long>, fp long"), "prints")
    kinds = scratch.write(prints.groupBy("h").agg(F.first("n").alias("n"), F.first("keys").alias("keys"), F.min("uid").alias("uid")), "kinds")
    dealt = kinds.select(F.explode("keys").alias("key"), "h").unionByName(by_fingerprint(scratch, prints)).repartition("key").sortWithinPartitions("key")
    met = scratch.write(dealt.mapInArrow(_pairs, "a long, b long, key long"), "met")
    size = lambda c: kinds.select(F.col("h").alias(c), F.col("n").alias(f"n_{c}"))
    hopeful = met.select("a", "b").distinct().join(size("a"), "a").join(size("b"), "b").where(f"least(n_a, n_b) >= {SIMILAR} * greatest(n_a, n_b) - 1e-9")
    pairs = scratch.write(hopeful.select("a", "b"), "pairs")
    starred = met.where("key is not null")
    wanted = pairs.unionByName(starred.select("a", "b")).select(F.explode(F.array("a", "b")).alias("h")).distinct()
    # equal rows give equal sets, so one row of a uid is enough
    wanted = scratch.write(kinds.select("h", "uid").join(wanted, "h", "left_semi"), "wanted")
    sets = rows.select("uid", "text").join(wanted, "uid").mapInArrow(_sets, "h long, set binary")
    sets = scratch.write(sets.dropDuplicates(["h"]), "sets")
    side = lambda c, x: sets.select(F.col("h").alias(c), F.col("set").alias(x))
    links = scratch.write(pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(_verify, "a long, b long"), "links")
    named = prints.where("doc_id is not null").groupBy("doc_id").agg(F.min("h").alias("b"), F.max("h").alias("top")).where("b < top")
    same = prints.select("doc_id", F.col("h").alias("a")).join(named, "doc_id").where("a != b").select("a", "b")
    comp = scratch.write(components(scratch, links.unionByName(same)), "components")
    tiles = _tiles(starred, comp).join(sets, "h")
    tiles = tiles.repartition("key", "near", "far").sortWithinPartitions("key", "near", "far").select("key", "near", "far", "comp", "set")
    more = components(scratch, tiles.mapInArrow(_joined, "a long, b long"))
    comp = scratch.write(follow(comp, more), "joined")
    distinct = prints.groupBy("doc_id", "uid", "h").agg(F.count("*").alias("n"))
    return distinct.join(comp, distinct["h"] == comp["node"], "left").select("doc_id", "uid", "n", F.coalesce("root", "h").alias("component"))
