"""Fuzzy line dedup: MinHash over character shingles, banding, exact Jaccard, union-find."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenreel.llm.common import Scratch, bound_batches, chunks, local_roots, ragged, release, runs_of, signed, unsigned
from lumenreel.llm.graph import components, follow

#: Characters of a shingle, and the least Jaccard similarity of a link.
SHINGLE, SIMILAR = 7, 0.8
#: 12 bands of 4: lines at 0.8 share a band with probability 0.998, at 0.85 with 0.9996.
BANDS, ROWS = 12, 4
#: Lines of one bucket paired with each other; larger buckets are compared in tiles of two blocks of lines.
RUN, BLOCK = 16, 128
#: Shingles of a tile coded at once, and columns of its incidence matrix held at once.
CODED, COLUMNS = 2_000_000, 8192
#: Bits for each line in the filter that says which lines have candidates, and the most bits of a filter (16 MB). Beyond
#: that many lines their texts are fetched by a join.
FILTER_SHARE, FILTER_BITS = 16, 27
#: Parts that the lines of a large bucket are joined to their bucket's counts in.
SALTS = 16
#: Lines hashed at once, characters of the pairs compared at once (a longer line stands alone); hashes a task remembers.
SLICE, CHARACTERS, SEEN = 20_000, 1_000_000, 500_000
#: Characters hashed at once (a longer line stands alone): the arrays stay in the processor's cache, and memory that was given
#: back isn't asked for anew in each step.
AT_ONCE = 32_000

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _runs(lines: list[str]):
    """Slices of lines that are hashed at once."""
    return runs_of(np.fromiter(map(len, lines), np.int64, len(lines)), AT_ONCE, SLICE)


#: Of the polynomial that hashes a shingle's signs.
PRIME = 0x100000001B3


def _hashed(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles of each line, one line after another, and their numbers."""
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    x = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(lengths)
    n = np.maximum(lengths - SHINGLE + 1, 0)
    h, held = x, 1
    while held < SHINGLE:  # runs of 1, 2, 4, 6 and 7 signs, each from two shorter ones
        more = min(held, SHINGLE - held, 2)
        h = h[: max(0, len(x) - held - more + 1)] * np.uint64(pow(PRIME, more, 1 << 64))
        h += (x if more == 1 else two)[held : held + len(h)]
        held += more
        if held == 2:
            two = h
    whole = np.ones(len(h), bool)  # those that reach over a line's end go
    last = (ends[:, None] - np.arange(1, SHINGLE))[np.arange(1, SHINGLE) <= lengths[:, None]]
    whole[last[last < len(h)]] = False
    return _mix(h[whole]), n


def signatures(lines: list[str]) -> np.ndarray:
    """One-permutation MinHash: the least shingle hash in each of 48 bins, empty bins filled from the next
    full one. Lines of fewer characters than a shingle have none: all bins stay empty."""
    bins = BANDS * ROWS
    h, n = _hashed(lines)
    sig = np.full(len(lines) * bins, _NONE)
    at = ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).view(np.int64) + np.repeat(np.arange(len(lines)) * bins, n)
    np.minimum.at(sig, at, h)
    sig = sig.reshape(-1, bins)
    twice = np.tile(np.where(sig == _NONE, 10_000, np.arange(bins)), 2) + np.repeat([0, bins], bins)
    step = np.minimum.accumulate(twice[:, ::-1], 1)[:, ::-1][:, :bins]
    far = step - np.arange(bins)
    full = np.take_along_axis(sig, step % bins, 1)
    return np.where(n[:, None] > 0, full + far.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), _NONE)


def band_keys(sig: np.ndarray) -> np.ndarray:
    parts = sig.reshape(len(sig), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(ROWS):
        key = _mix(key ^ parts[:, :, r])
    return key


#: Bits of a character in a packed shingle: seven fill 63 bits, so equal numbers are equal shingles.
PACKED = 9


def packed(lines: list[str]) -> list[list]:
    """The shingles of each line in order, as exact numbers where all its characters are below 512, else
    as strings; a line shorter than a shingle is its own."""
    runs = list(_runs(lines))
    if len(runs) > 1:
        return [x for cut in runs for x in packed(lines[cut])]
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    x = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(lengths)
    h = np.zeros(max(0, len(x) - SHINGLE + 1), np.uint64)
    for j in range(SHINGLE):
        h <<= np.uint64(PACKED)
        h |= x[j : j + len(h)]
    wide = np.r_[0, np.cumsum(x >> np.uint64(PACKED) > 0)]
    out = []
    for line, a, b in zip(lines, (ends - lengths).tolist(), ends.tolist()):
        if b - a < SHINGLE:
            out.append([line])
        elif wide[b] > wide[a]:
            out.append(_cut(line))
        else:
            out.append(h[a : b - SHINGLE + 1])
    return out


def _cut(line: str) -> list[str]:
    return [line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))]


def _set(part) -> set:
    return set(part.tolist() if isinstance(part, np.ndarray) else part)


def similar(x, of_y: set) -> bool:
    """Whether the exact Jaccard similarity of two lines' shingle sets reaches SIMILAR; x in order.

    |x & y| must reach s/(1+s) (|x| + |y|), so x may miss at most |x|/(1+s) - |y| s/(1+s) of its shingles
    in y. x is looked through part by part, and given up once it has missed more.
    """
    n = len(x)
    if n < SIMILAR * len(of_y):
        return False
    share = SIMILAR / (1 + SIMILAR)
    may_miss = n * (1 - share) - len(of_y) * share + 1e-9
    step = -(-n // 3)
    seen: set = set()
    missed = 0
    for at in range(0, n, step):
        seen |= _set(x[at : at + step])
        missed = len(seen - of_y)
        if missed > may_miss:
            return False
    return len(seen) - missed >= SIMILAR * (len(of_y) + missed) - 1e-9


#: Pairs of a part. Slots of a line's map for each of its shingles in the mean, and the most slots of all maps of a part.
PART, SLOTS, MAPS = 500, 16, 1 << 24


def _maps(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A bit map of each line, in which every shingle marks the slot that its hash gives, and the numbers of shingles."""
    size = max(1, len(lines))
    wide = max(6, min((SLOTS * sum(map(len, lines)) // size).bit_length(), (MAPS // size).bit_length() - 1))
    maps, counts = np.zeros((len(lines), 1 << wide >> 3), np.uint8), np.zeros(len(lines), np.int64)
    for cut in _runs(lines):
        h, n = _hashed(lines[cut])
        marks = np.zeros(len(n) << wide, bool)
        marks[(h >> np.uint64(64 - wide)).view(np.int64) + np.repeat(np.arange(len(n)) << wide, n)] = True
        maps[cut], counts[cut] = np.packbits(marks).reshape(len(n), -1), n
    return maps.view(np.uint64), counts


def _near(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which pairs of maps allow SIMILAR, n being the numbers of shingles of both lines.

    At a similarity of s the sets x and y differ in at most (1 - s) / (1 + s) (|x| + |y|) shingles. Slots marked in one map
    only are never more than the shingles in one set only, so no pair that reaches s is left out.
    """
    apart = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
    return apart <= (1 - SIMILAR) / (1 + SIMILAR) * n + 1e-6


def hopeful(xs: list[str], ys: list[str]) -> np.ndarray:
    """Which pairs may reach SIMILAR, so that the exact comparison is spared for most others. Each different line is hashed
    once, in however many pairs it stands."""
    own: dict[str, int] = {}
    code = np.array([own.setdefault(x, len(own)) for x in (*xs, *ys)], np.int64)
    maps, n = _maps(list(own))
    i, j = code[: len(xs)], code[len(xs) :]
    return _near(maps[i], maps[j], n[i] + n[j])


def _unlike(lines: list[str], comp: np.ndarray) -> np.ndarray:
    """The lines of a tile that may reach SIMILAR with one of another component; all of a tile of very long lines."""
    if sum(map(len, lines)) > CODED:
        return np.arange(len(lines))
    maps, n = _maps(lines)
    some = np.zeros(len(lines), bool)
    for i in range(len(lines) - 1):
        j = np.flatnonzero(comp[i + 1 :] != comp[i]) + i + 1
        j = j[_near(maps[i], maps[j], n[i] + n[j])]
        some[j] = True
        some[i] |= len(j) > 0
    return np.flatnonzero(some)


def _split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(text, line number, code) of every line that isn't blank, the distinct lines and their hashes."""
    lists = pc.split_pattern(texts.cast(pa.string()), "\n")
    counts = np.diff(lists.offsets.to_numpy())
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    lines = coded.dictionary
    blank = pc.equal(pc.utf8_length(pc.utf8_trim_whitespace(lines)), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(counts)), counts)
    number = np.arange(len(codes)) - np.repeat(np.cumsum(counts) - counts, counts)
    ok = ~blank[codes] if len(codes) else np.zeros(0, bool)
    hashes = np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in lines.cast(pa.binary()).to_pylist()), np.uint64, len(lines))
    return row[ok], number[ok], codes[ok], lines, hashes


def _parts(b: pa.RecordBatch, rows: int = 100):
    for at in range(0, b.num_rows, rows):
        yield b.slice(at, rows)


def _sketch(batches):
    """Every line with its hash; the first one of its kind in the task also with its band keys."""
    seen: set[int] = set()
    for batch in batches:
        for b in _parts(batch):
            row, number, code, lines, hashes = _split(b.column("text"))
            used, first = np.unique(code, return_index=True)
            new = np.array([x not in seen for x in hashes[used].tolist()], bool)
            new, first = used[new], first[new]
            if len(seen) > SEEN:
                seen.clear()
            seen.update(hashes[new].tolist())
            keys = np.zeros((len(new), BANDS), np.int64)
            full = np.zeros(len(new), bool)
            lengths = pc.utf8_length(lines.take(pa.array(new))).to_numpy(zero_copy_only=False)
            for cut in runs_of(lengths, AT_ONCE, SLICE):
                sig = signatures(lines.take(pa.array(new[cut])).to_pylist())
                keys[cut], full[cut] = band_keys(sig).view(np.int64), sig[:, 0] != _NONE
            at = np.zeros(len(code), bool)
            at[first[full]] = True
            keys = keys[full][np.argsort(first[full])]
            bands = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(at * BANDS)], pa.int32()), pa.array(keys.ravel()), mask=pa.array(~at))
            doc = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(doc), b.column("uid").take(doc), pa.array(number, pa.int32()), signed(hashes[code]), bands], names=["doc_id", "uid", "line_no", "h", "bands"])
        release()


def _pairs(batches):
    """Candidates (a, b) of rows (key, h) sorted by key. Up to RUN lines of a bucket: all pairs. A larger
    bucket: each line with the bucket's lead, with the key beside the pair."""
    held: pa.Table | None = None
    lead: tuple | None = None
    for t in chunks(batches, 200_000):
        t = t if held is None else pa.concat_tables([held, t])
        held = None
        key, h = unsigned(t.column("key")), unsigned(t.column("h"))
        ends = np.flatnonzero(key[1:] != key[:-1])
        cut = int(ends[-1]) + 1 if len(ends) else 0
        open_ = len(key) - cut <= RUN and not (lead and lead[0] == key[-1])
        after = None
        if open_:
            held = t.slice(cut)
            key, h = key[:cut], h[:cut]
        else:
            after = lead if lead and lead[0] == key[-1] else (key[-1], h[cut:].min())
        if len(key):
            yield from _emit(key, h, [x for x in (lead, after) if x])
        lead = after or lead
    if held is not None and held.num_rows:
        yield from _emit(unsigned(held.column("key")), unsigned(held.column("h")), [lead] if lead else [])
    release()


def _emit(key: np.ndarray, h: np.ndarray, leads: list[tuple]):
    """leads: (key, lead) of buckets that reach beyond these rows."""
    edge = np.r_[True, key[1:] != key[:-1], True]
    several = ~(edge[1:] & edge[:-1])  # most buckets hold one line
    for k, _ in leads:
        several |= key == k
    key, h = key[several], h[several]
    order = np.lexsort((h, key))
    key, h = key[order], h[order]
    fresh = np.r_[True, (key[1:] != key[:-1]) | (h[1:] != h[:-1])][: len(key)]
    key, h = key[fresh], h[fresh]
    if not len(key):
        return
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, len(key)])
    first, large = h[start], size > RUN
    for k, x in leads:
        first[key[start] == k] = x
        large[key[start] == k] = True
    group = np.repeat(np.arange(len(start)), size)
    star = large[group]
    a, b = [], []
    live = np.flatnonzero(~star & (size[group] > 1))
    for d in range(1, RUN):
        live = live[live + d < len(key)]
        live = live[group[live + d] == group[live]]
        if not len(live):
            break
        a.append(h[live])
        b.append(h[live + d])
    if a:
        x, y = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
        both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
        none = pa.nulls(len(both), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1])), none], names=["a", "b", "key"])
    far = np.flatnonzero(star & (h != first[group]))
    if len(far):
        x, y = first[group[far]].view(np.int64), h[far].view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), signed(key[far])], names=["a", "b", "key"])


def _tiles(stars: DataFrame, comp: DataFrame) -> DataFrame:
    """(key, near, far, h, comp): the lines of large buckets dealt to tiles, so that any two lines of a bucket
    that are not in one component yet stand in one tile.

    The lines of a bucket's largest component need not meet each other. The others are cut into blocks of
    about BLOCK lines; each block meets each block of the bucket. Buckets of one component have no tiles,
    so a bucket of copies costs nothing here, and a tile holds about two blocks however large the bucket.
    """
    h = F.explode(F.array("a", "b")).alias("h")
    lines = stars.select("key", h).distinct().join(comp.select(F.col("node").alias("h"), "root"), "h", "left").select("key", "h", F.coalesce("root", "h").alias("comp"))
    main = lines.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "comp")).alias("main"), F.sum("n").alias("n"))
    blocks = main.where("n > main.n").select("key", F.col("main.comp").alias("main"), F.ceil(F.col("main.n") / BLOCK).alias("ins"), F.ceil((F.col("n") - F.col("main.n")) / BLOCK).alias("outs"))
    out = F.col("comp") != F.col("main")
    blocks = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("h", F.lit(7)), F.lit(SALTS)).cast("int"))
    at = salted.join(blocks, ["key", "salt"]).withColumn("own", F.pmod(F.xxhash64("h"), F.when(out, F.col("outs")).otherwise(F.col("ins"))))
    # blocks of the others are numbered 0, 1, ... and those of the largest component -1, -2, ...
    meets = F.when(out, F.sequence(-F.col("ins"), F.col("outs") - 1)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("outs") - 1))
    own = F.when(out, F.col("own")).otherwise(-F.col("own") - 1)
    at = at.select("key", "h", "comp", own.alias("own"), F.explode(meets).alias("other"))
    return at.select("key", F.least("own", "other").alias("near"), F.greatest("own", "other").alias("far"), "h", "comp")


def tile_links(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all lines of a tile whose Jaccard similarity reaches SIMILAR, from the products of their
    incidence with shingles; shingles are known by 64-bit hashes and taken in parts of bounded size."""
    total = sum(map(len, lines))
    parts = total // CODED + 1
    own, shared = np.zeros(len(lines)), np.zeros((len(lines), len(lines)))
    for part in range(parts):
        if parts == 1:
            h, n = _hashed(lines)
        else:
            held = [np.unique(_hashed([x])[0]) for x in lines]
            held = [x[x % np.uint64(parts) == part] for x in held]
            h, n = np.concatenate(held), np.fromiter(map(len, held), np.int64, len(held))
        _, code = np.unique(h, return_inverse=True)
        kinds = int(code.max()) + 1 if len(code) else 1
        cell = np.unique(code * len(lines) + np.repeat(np.arange(len(lines)), n))
        col, row = cell // len(lines), cell % len(lines)
        own += np.bincount(row, minlength=len(lines))
        count = np.bincount(col, minlength=kinds)
        common = count[col] > 1
        row, col = row[common], (np.cumsum(count > 1) - 1)[col[common]]
        wide = int(col[-1]) + 1 if len(col) else 0
        for low in range(0, wide, COLUMNS):
            i, j = np.searchsorted(col, [low, low + COLUMNS])
            m = np.zeros((len(lines), min(COLUMNS, wide - low)), np.float32)
            m[row[i:j], col[i:j] - low] = 1
            shared += m @ m.T
    return np.nonzero(np.triu(shared >= SIMILAR * (own[:, None] + own - shared) - 1e-9, 1))


def _joined(batches):
    """Which components the links of a tile join, as a forest of stars; rows come sorted by tile."""
    tile, comps, lines = None, [], []

    def done():
        comp = np.array(comps, np.int64)
        some = _unlike(lines, comp)
        if not len(some):
            return
        comp = comp[some]
        i, j = tile_links([lines[k] for k in some.tolist()])
        i, j = i[comp[i] != comp[j]], j[comp[i] != comp[j]]
        if len(i):
            node, root = local_roots(comp[i], comp[j])
            yield pa.RecordBatch.from_arrays([pa.array(node[node != root]), pa.array(root[node != root])], names=["a", "b"])

    for b in batches:
        for *at, comp, line in zip(*(b.column(c).to_pylist() for c in ("key", "near", "far", "comp", "line"))):
            if at != tile:
                if len(lines) > 1:
                    yield from done()
                tile, comps, lines = at, [], []
            comps.append(comp)
            lines.append(line)
    if len(lines) > 1:
        yield from done()
    release()


def _uid(doc_id: str, text: str):
    return F.xxhash64(F.col(doc_id).cast("long"), F.col(text).cast("string"))


def _texts_by_filter(pairs: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """(h, line) of all lines of the pairs, and of a few others that a filter of 2^size bits lets through."""
    low = (1 << size) - 1
    words = pairs.select(F.explode(F.array("a", "b")).alias("h")).select(F.shiftright(F.col("h").bitwiseAND(low), 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"))
    bits = words.groupBy("w").agg(F.bit_or("bit").alias("bits")).coalesce(1)

    def fill(batches):
        out = np.zeros(1 << (size - 6), np.int64)
        for b in batches:
            out[b.column("w").to_numpy()] = b.column("bits").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["bits"])

    filled = np.zeros(1 << (size - 6), np.int64)
    for r in bits.mapInArrow(fill, "bits binary").collect():
        filled |= np.frombuffer(r["bits"], np.int64)
    sent = pairs.sparkSession.sparkContext.broadcast(filled)

    def wanted(batches):
        known = sent.value.view(np.uint64)
        seen: set[int] = set()
        for batch in batches:
            for b in _parts(batch):
                _, _, code, texts, hashes = _split(b.column("text"))
                code = np.unique(code)
                x = hashes[code] & np.uint64(low)
                code = code[(known[(x >> np.uint64(6)).astype(np.int64)] >> (x & np.uint64(63))) & np.uint64(1) == 1]
                code = np.array([c for c in code.tolist() if int(hashes[c]) not in seen], np.int64)
                if len(seen) > SEEN:
                    seen.clear()
                seen.update(hashes[code].tolist())
                yield pa.RecordBatch.from_arrays([signed(hashes[code]), texts.take(pa.array(code))], names=["h", "line"])

    return rows.select("text").mapInArrow(wanted, "h long, line string").dropDuplicates(["h"])


def _texts_by_join(pairs: DataFrame, lines: DataFrame, rows: DataFrame) -> DataFrame:
    """(h, line) of all lines of the pairs, each taken from the one row that holds its first occurrence; rows that hold none
    are not read further. Nothing is broadcast."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct()
    first = lines.join(wanted, "h", "left_semi").groupBy("h").agg(F.min(F.struct("uid", "line_no")).alias("at"))
    own = first.groupBy("at.uid").agg(F.collect_list(F.struct("at.line_no", "h")).alias("own"))
    held = rows.select("uid", "text").dropDuplicates(["uid"]).join(own, "uid")
    cut = held.select(F.split("text", "\n", -1).alias("parts"), F.explode("own").alias("o"))
    return cut.select("o.h", F.get("parts", F.col("o.line_no")).alias("line"))


def line_classes(scratch: Scratch, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, uid, line_no, line_class, kept) of every line that isn't blank.

    Lines are cut at newlines. Equal lines are one node, known by a 64-bit hash; different ones are linked
    at a Jaccard similarity of 0.8 or more of their sets of 7-character shingles. Of each component one
    line is kept: that of the smallest (doc_id, row, line number), null ids last. Lines under seven
    characters are linked to equal lines only.

    Each task sketches a line once; only band keys and hashes are shuffled. The texts of lines that have
    candidates are read again behind a bit filter sized by their number (beyond 16 MB by a join with the rows
    that hold them), joined to the distinct candidate pairs and compared whole. A bucket of more than 16 lines is compared with its lead first; all its lines that are
    not in one component by then are compared exactly in tiles, so no link of a bucket is lost. Null or empty text: no lines. Empty table: no rows. Rows alike in id and text are
    one document, whose lines are kept or not alike in each. Lines are known by 64-bit hashes: of n different lines
    some n^2 / 2^65 are taken for others. Other columns are not read.
    """
    bound_batches(scratch.spark)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), _uid(doc_id, text).alias("uid"), body.alias("text"))
    lines = scratch.write(rows.mapInArrow(_sketch, "doc_id long, uid long, line_no int, h long, bands array<long>"), "lines")
    dealt = lines.where("bands is not null").select(F.explode("bands").alias("key"), "h").repartition("key").sortWithinPartitions("key")
    met = scratch.write(dealt.mapInArrow(_pairs, "a long, b long, key long"), "found")
    pairs = scratch.write(met.select("a", "b").distinct(), "pairs")

    asked = 2 * pairs.count()
    bits = max(20, (asked * FILTER_SHARE).bit_length())
    texts = scratch.write(_texts_by_filter(pairs, rows, bits) if bits <= FILTER_BITS else _texts_by_join(pairs, lines, rows), "texts")
    whole = pairs.join(texts.select(F.col("h").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("h").alias("b"), F.col("line").alias("y")), "b")

    def verify(batches):
        last, its = None, set()
        for batch in batches:
            long_ = sum(pc.utf8_length(batch.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("x", "y"))
            for cut in runs_of(long_, CHARACTERS, PART):
                b = batch.slice(cut.start, cut.stop - cut.start)
                b = b.filter(pa.array(hopeful(b.column("x").to_pylist(), b.column("y").to_pylist())))
                near = np.zeros(b.num_rows, bool)
                ys = b.column("y").dictionary_encode()
                of_ys = packed(ys.dictionary.to_pylist())
                for i, (x, k) in enumerate(zip(packed(b.column("x").to_pylist()), ys.indices.to_pylist())):
                    if k != last or not i:  # rows come sorted by b
                        last, its = k, _set(of_ys[k])
                    if isinstance(x, np.ndarray) == isinstance(of_ys[k], np.ndarray):
                        near[i] = similar(x, its)
                    else:  # only one line has wide characters
                        s, t = b.column("x")[i].as_py(), b.column("y")[i].as_py()
                        near[i] = similar(_cut(s), set(_cut(t)))
                yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(near)), b.column("b").filter(pa.array(near))], names=["a", "b"])
            release()

    links = scratch.write(whole.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long"), "links")
    comp = scratch.write(components(scratch, links), "components")
    tiles = _tiles(met.where("key is not null"), comp).join(texts.select("h", "line"), "h")
    tiles = tiles.repartition("key", "near", "far").sortWithinPartitions("key", "near", "far").select("key", "near", "far", "comp", "line")
    more = components(scratch, tiles.mapInArrow(_joined, "a long, b long"))
    comp = scratch.write(follow(comp, more), "joined")
    first = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc"), "uid", "line_no")
    kinds = lines.groupBy("h").agg(F.count("*").alias("n"), F.min(first).alias("at"))
    kinds = scratch.write(kinds.join(comp, kinds["h"] == comp["node"], "left").select("h", "n", "at", F.coalesce("root", "h").alias("line_class")), "kinds")
    keep = kinds.groupBy("line_class").agg(F.sum("n").alias("n"), F.min("at").alias("keep")).where("n > 1").drop("n")
    several = scratch.write(kinds.join(keep, "line_class").select("h", "line_class", "keep"), "several")
    out = lines.select("doc_id", "uid", "line_no", "h", first.alias("at")).join(several, "h", "left")
    return out.select("doc_id", "uid", "line_no", F.coalesce("line_class", "h").alias("line_class"), (F.col("keep").isNull() | (F.col("keep") == F.col("at"))).alias("kept"))


def dedup_lines(scratch: Scratch, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with each text rebuilt from the lines that line_classes keeps, and blank ones; no row goes."""
    gone = line_classes(scratch, docs, doc_id, text).where("not kept").groupBy("uid").agg(F.collect_set("line_no").alias("__gone"))
    gone = scratch.write(gone.withColumnRenamed("uid", "__uid"), "gone")
    out = docs.withColumn("__uid", _uid(doc_id, text)).join(gone, "__uid", "left")
    kept = F.array_join(F.filter(F.split(F.col(text), "\n", -1), lambda x, i: ~F.array_contains("__gone", i)), "\n")
    return out.withColumn(text, F.when(F.col("__gone").isNull(), F.col(text)).otherwise(kept)).select(docs.columns)
