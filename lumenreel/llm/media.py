"""Copies among images by local descriptors: multiscale corners, oriented binary tests, Hamming-table joins
and geometric consensus."""

from __future__ import annotations

import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenreel.llm.common import Scratch, chunks, local_roots, release, signed, unsigned
from lumenreel.llm.graph import components, follow
from lumenreel.llm.lines import _tiles

#: Scales of the pyramid; a corner is the strongest of its neighbourhood (pixels to each side), so how many there
#: are grows with the area and a crop keeps those inside it; half-width of a patch; least strength of a corner.
SCALES = (1.0, 0.84, 0.71, 0.59, 0.5)
APART, HALF, STRONG = 6, 9, 4.0
#: Binary tests of a descriptor, and differing bits of a match.
TESTS, NEAR = 256, 48
#: Tables; each is keyed by 12 bits of a corner, 12 of one of its six nearest corners, and their geometry: angles in
#: steps of a turn, the distance in steps of an octave.
TABLES, KEY_BITS, NEIGHBOURS, TURNS, OCTAVE = 2, 12, 6, 16, 4
#: Of 64 further bits beside a key at most so many may differ; then two images are compared whole.
REST = 6
#: Matches that must agree on one similarity transform, within so many pixels.
AGREE, SLACK = 6, 3.0
#: Corners in one cell of so many pixels count once: one corner is found at several scales.
CELL = 6
#: Entries of one bucket compared with each other; larger buckets are compared in tiles.
RUN = 4096
#: Longer sides are scaled down to this, which bounds the corners of an image.
SIDE_LIMIT = 512


def decode(data: bytes) -> np.ndarray | None:
    """Grey values of a PGM or PPM (binary, up to 255) or PNG (8 bits, not interlaced); None for anything else, and for files
    that are cut off, corrupt, or say they are larger than their data can be."""
    try:
        x = _pnm(data) if data[:2] in (b"P5", b"P6") else _png(data) if data[:8] == b"\x89PNG\r\n\x1a\n" else None
    except (ValueError, struct.error, zlib.error):
        return None
    if x is None or 0 in x.shape:
        return None
    x = x.astype(np.float32)
    return x[..., 0] if x.shape[2] < 3 else x[..., :3] @ np.array([0.299, 0.587, 0.114], np.float32)


#: Head of a PGM or PPM: three numbers, set apart by white space and comments; one white space before the values.
_HEAD = re.compile(rb"P[56]" + rb"(?:\s|#[^\n\r]*[\n\r])+(\d{1,9})" * 3 + rb"\s")


def _pnm(data: bytes) -> np.ndarray | None:
    head = _HEAD.match(data)
    if not head:
        return None
    w, h, top = map(int, head.groups())
    k = 3 if data[1:2] == b"6" else 1
    if not 0 < top < 256 or len(data) - head.end() < w * h * k:
        return None
    x = np.frombuffer(data, np.uint8, w * h * k, head.end()).reshape(h, w, k)
    return x if top == 255 else np.minimum(x, top) * np.float32(255 / top)


def _png(data: bytes) -> np.ndarray | None:
    at, body, head = 8, [], None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        if len(part) < n:
            return None
        if kind == b"IHDR" and head is None:
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        elif kind == b"IEND":
            break
        at += 12 + n
    if head is None or head[2] != 8 or head[4] or head[5] or head[6] or head[3] not in (0, 2, 4, 6):
        return None
    w, h, k = head[0], head[1], {0: 1, 2: 3, 4: 2, 6: 4}[head[3]]
    packed = b"".join(body)
    if h * (1 + w * k) > 1040 * len(packed) + 64:  # more than deflate can hold
        return None
    rows = zlib.decompressobj().decompress(packed, h * (1 + w * k))
    if len(rows) < h * (1 + w * k):
        return None
    rows = np.frombuffer(rows, np.uint8).reshape(h, 1 + w * k)
    if rows.size and rows[:, 0].max() > 4:
        return None
    out = np.zeros((h, w * k), np.uint8)
    for y in range(h):
        kind, line = rows[y, 0], rows[y, 1:].astype(np.int64)
        up = out[y - 1].astype(np.int64) if y else np.zeros(w * k, np.int64)
        if kind == 2:
            line = line + up
        elif kind == 1:
            line = line.reshape(w, k).cumsum(0).ravel()
        elif kind:
            line = line.tolist()
            for i in range(w * k):
                a, b, c = (line[i - k] if i >= k else 0), int(up[i]), (int(up[i - k]) if i >= k else 0)
                p = a + b - c
                paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                line[i] = (line[i] + ((a + b) // 2 if kind == 3 else paeth)) & 255
        out[y] = np.asarray(line) & 255
    return out.reshape(h, w, k)


def _resize(x: np.ndarray, scale: float) -> np.ndarray:
    """Bilinear, after a small blur where it shrinks."""
    if scale == 1.0:
        return x
    h, w = max(2, round(x.shape[0] * scale)), max(2, round(x.shape[1] * scale))
    x = _blur(x)
    ys, xs = (np.arange(h) + 0.5) * x.shape[0] / h - 0.5, (np.arange(w) + 0.5) * x.shape[1] / w - 0.5
    return _sample(x, xs[None, :] + np.zeros((h, 1)), ys[:, None] + np.zeros((1, w)))


def _sample(x: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    xs, ys = np.clip(xs, 0, x.shape[1] - 1.001), np.clip(ys, 0, x.shape[0] - 1.001)
    i, j = ys.astype(np.int64), xs.astype(np.int64)
    fy, fx = (ys - i).astype(np.float32), (xs - j).astype(np.float32)
    return (x[i, j] * (1 - fx) + x[i, j + 1] * fx) * (1 - fy) + (x[i + 1, j] * (1 - fx) + x[i + 1, j + 1] * fx) * fy


def _blur(x: np.ndarray) -> np.ndarray:
    p = np.pad(x, 2, mode="edge")
    k = np.array([1, 4, 6, 4, 1], np.float32) / 16
    p = sum(k[i] * p[:, i : i + x.shape[1]] for i in range(5))
    return sum(k[i] * p[i : i + x.shape[0]] for i in range(5))


def _largest_near(r: np.ndarray) -> np.ndarray:
    """The largest value within APART pixels to each side."""
    p = np.pad(r, APART, constant_values=-np.inf)
    across = p[:, : r.shape[1]].copy()
    for i in range(1, 2 * APART + 1):
        np.maximum(across, p[:, i : i + r.shape[1]], out=across)
    out = across[: r.shape[0]].copy()
    for i in range(1, 2 * APART + 1):
        np.maximum(out, across[i : i + r.shape[0]], out=out)
    return out


def describe(grey: np.ndarray, tests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x, y, angle, size) and a bit for each test of all corners of an image at all scales.

    Corners are local maxima of the smaller eigenvalue of the gradient matrix, placed between pixels by
    a parabola; the angle is that of the patch's intensity centroid, and the tests are turned by it, so a
    turned copy has the same bits.
    """
    while max(grey.shape) > SIDE_LIMIT:
        grey = _resize(grey, max(SIDE_LIMIT / max(grey.shape), 0.5))
    spots, bits = [np.zeros((0, 4), np.float32)], [np.zeros((0, len(tests)), bool)]
    d = np.arange(-HALF + 1, HALF)
    far = d[:, None] ** 2 + d[None] ** 2
    window = (np.exp(-far / (HALF * HALF / 2)) * (far < HALF * HALF)).astype(np.float32)
    for scale in SCALES:
        x = _resize(grey, scale)
        if min(x.shape) <= 2 * HALF + 4:
            continue
        s = _blur(x)
        gx, gy = np.zeros_like(s), np.zeros_like(s)
        gx[:, 1:-1], gy[1:-1] = s[:, 2:] - s[:, :-2], s[2:] - s[:-2]
        a, b, c = _blur(gx * gx), _blur(gx * gy), _blur(gy * gy)
        r = (a + c) / 2 - np.sqrt(((a - c) / 2) ** 2 + b * b)
        inner = np.zeros(r.shape, bool)
        inner[HALF + 1 : -HALF - 1, HALF + 1 : -HALF - 1] = True
        iy, ix = np.nonzero((r >= _largest_near(r)) & (r > STRONG) & inner)
        if not len(iy):
            continue
        place = []
        for at, dy, dx in ((ix, 0, 1), (iy, 1, 0)):
            low, mid, high = r[iy - dy, ix - dx], r[iy, ix], r[iy + dy, ix + dx]
            bend = np.minimum(low - 2 * mid + high, -1e-6)
            place.append(at + np.clip((low - high) / (2 * bend), -0.5, 0.5))
        px, py = place
        s = _blur(s)
        patch = _sample(s, px[:, None, None] + d[None, None], py[:, None, None] + d[None, :, None]) * window
        angle = np.arctan2((patch * d[:, None]).sum((1, 2)), (patch * d[None]).sum((1, 2)))
        co, si = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
        tx, ty = tests[..., 0][None] * co - tests[..., 1][None] * si, tests[..., 0][None] * si + tests[..., 1][None] * co
        v = _sample(s, px[:, None, None] + tx, py[:, None, None] + ty)
        bits.append(v[..., 0] < v[..., 1])
        fx, fy = grey.shape[1] / x.shape[1], grey.shape[0] / x.shape[0]
        spots.append(np.stack([(px + 0.5) * fx, (py + 0.5) * fy, angle, np.full(len(px), fx)], 1).astype(np.float32))
    return np.concatenate(spots), np.concatenate(bits)


@lru_cache(1)
def chosen_tests(pool: int = 1500, pictures: int = 30) -> np.ndarray:
    """Pairs of points whose test says much: of a fixed pool, those that are 1 about as often as 0 and that depend
    least on those chosen before, seen on corners of smooth random fields. The same on every run."""
    rng = np.random.default_rng(2024)
    points = np.clip(rng.normal(0, HALF / 2.0, (pool, 2, 2)), -HALF + 2, HALF - 2)
    f = np.fft.fftfreq(128)
    k = np.hypot(f[:, None], f[None])
    k[0, 0] = 1
    seen = []
    for _ in range(pictures):
        z = np.fft.ifft2(np.fft.fft2(rng.normal(size=(128, 128))) / k**1.2).real
        seen.append(describe(((z - z.min()) / np.ptp(z) * 255).astype(np.float32), points)[1])
    bits = np.concatenate(seen).astype(np.float32)
    mean = bits.mean(0)
    bits = (bits - mean) / np.maximum(bits.std(0), 1e-6)
    alike = np.abs(bits.T @ bits / len(bits))
    order = np.argsort(np.abs(mean - 0.5), kind="stable")
    limit = 0.2
    while True:
        chosen: list[int] = []
        for i in order:
            if not chosen or alike[i, chosen].max() < limit:
                chosen.append(i)
            if len(chosen) == TESTS:
                return points[chosen]
        limit += 0.05


def _packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).reshape(len(bits), TESTS // 64)


def table_entries(spots: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (key, rest) of an image. A key holds 12 bits of a corner and of a near corner of its scale, the direction
    between them, the difference of their angles and their distance; rest, 32 further bits of each. The corner with
    the smaller code comes first."""
    keys, rests = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    half = np.uint64(0xFFFFFFFF)
    for size in np.unique(spots[:, 3]):
        at = np.flatnonzero(spots[:, 3] == size)
        p = spots[at, :2] / size
        for low in range(0, len(at), 256):
            gap = np.hypot(p[low : low + 256, None, 0] - p[None, :, 0], p[low : low + 256, None, 1] - p[None, :, 1])
            gap[gap < CELL] = np.inf
            near = np.argsort(gap, 1, kind="stable")[:, :NEIGHBOURS]
            i, j = np.repeat(at[low : low + 256], near.shape[1]), at[near].ravel()
            ok = np.isfinite(np.take_along_axis(gap, near, 1).ravel())
            i, j = i[ok], j[ok]
            for t in range(TABLES):
                code = bits[:, 0] >> np.uint64(t * KEY_BITS) & np.uint64((1 << KEY_BITS) - 1)
                swap = code[i] > code[j]
                a, b = np.where(swap, j, i), np.where(swap, i, j)
                way = np.arctan2(spots[b, 1] - spots[a, 1], spots[b, 0] - spots[a, 0]) - spots[a, 2]
                far = np.log2(np.hypot(spots[b, 0] - spots[a, 0], spots[b, 1] - spots[a, 1]) / size)
                key = code[a] << np.uint64(KEY_BITS) | code[b]
                for v, steps in ((way / (2 * np.pi) * TURNS, TURNS), ((spots[b, 2] - spots[a, 2]) / (2 * np.pi) * TURNS, TURNS), (OCTAVE * far, 64)):
                    key = key * np.uint64(steps) + np.mod(np.floor(v + t / TABLES), steps).astype(np.uint64)
                keys.append((key * np.uint64(TABLES) + np.uint64(t)) * np.uint64(0x9E3779B97F4A7C15))
                rests.append((bits[a, 1] & half) << np.uint64(32) | bits[b, 1] & half)
    key, rest = np.concatenate(keys), np.concatenate(rests)
    order = np.lexsort((rest, key))
    key, rest = key[order], rest[order]
    fresh = np.r_[True, (key[1:] != key[:-1]) | (rest[1:] != rest[:-1])][: len(key)]
    return key[fresh], rest[fresh]


#: Bytes of working arrays when descriptors or matches are compared.
ROOM = 32 << 20
#: Matches of a block that are tried as transforms at once, before all are.
TRIED = 32


def consensus(p: np.ndarray, q: np.ndarray, enough: int | None = None, tried: np.ndarray | None = None) -> int:
    """Most matches that agree on one turn, scale and shift: each match (or each of `tried`) gives a transform by its own
    angle and size, under which all are counted, each place of either image once. It ends once `enough` agree. Transforms
    are tried some at a time, so memory is linear in the matches."""
    if len(p) < AGREE:
        return 0
    order = np.arange(len(p)) if tried is None else tried
    step = max(1, ROOM // (48 * len(p)))
    best = 0
    for at in range(0, len(order), step):
        i = order[at : at + step]
        turn, size = (q[i, 2] - p[i, 2])[:, None], (q[i, 3] / p[i, 3])[:, None]
        px, py = p[None, :, 0] - p[i, :1], p[None, :, 1] - p[i, 1:2]
        qx, qy = q[None, :, 0] - q[i, :1], q[None, :, 1] - q[i, 1:2]
        co, si = size * np.cos(turn), size * np.sin(turn)
        near = np.hypot(co * px - si * py - qx, si * px + co * py - qy) < SLACK * np.maximum(1.0, size)
        near &= np.abs(((q[:, 2] - p[:, 2])[None] - turn + np.pi) % (2 * np.pi) - np.pi) < 0.5
        count = near.sum(1)
        for j in np.argsort(-count, kind="stable"):
            if count[j] <= best:
                break
            best = max(best, min(len(np.unique(z[near[j], :2] // CELL, axis=0)) for z in (p, q)))
            if enough is not None and best >= enough:
                return best
    return best


def agree(one: tuple, other: tuple) -> bool:
    """Whether two images, each (spots, packed bits), show the same: enough matches agree on one transform.

    Corners of the first meet those of the other in blocks. After each block a few of its matches are tried as
    transforms of all found so far; more matches can only add to those that agree, so pictures of a repeated
    pattern, in which all corners match, are decided by their first blocks. If none suffices, all are tried.
    """
    rows = max(1, ROOM // (TESTS // 8 * 2 * max(1, len(other[1]))))
    p, q, held = np.zeros((0, 4), np.float32), np.zeros((0, 4), np.float32), []
    for at in range(0, len(one[1]), rows):
        i, j = np.nonzero(np.bitwise_count(one[1][at : at + rows, None] ^ other[1][None]).sum(2, dtype=np.int16) <= NEAR)
        if not len(i):
            continue
        held.append((one[0][at + i], other[0][j]))
        p, q = (np.concatenate(z) for z in zip(*held))
        held = [(p, q)]
        tried = np.unique(np.linspace(len(p) - len(i), len(p) - 1, TRIED).astype(np.int64))
        if consensus(p, q, AGREE, tried) >= AGREE:
            return True
    return consensus(p, q, AGREE) >= AGREE


def _image(spots: bytes, bits: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(spots, np.float32).reshape(-1, 4), np.frombuffer(bits, np.uint64).reshape(-1, TESTS // 64)


_MET = "a long, b long, key long, near boolean"


def _meet(batches):
    """Pairs (a, b) of rows (key, h, rest) sorted by key and h: different images of a bucket of up to RUN entries whose
    rests are near. In larger buckets each entry with the bucket's first, the key and whether the rests are near."""
    held: pa.Table | None = None
    lead: tuple | None = None  # (key, h, rest) that a bucket over RUN began with
    for t in chunks(batches, 100_000):
        t = t if held is None else pa.concat_tables([held, t])
        held = None
        key, h, rest = (unsigned(t.column(c)) for c in ("key", "h", "rest"))
        ends = np.flatnonzero(key[1:] != key[:-1])
        cut = int(ends[-1]) + 1 if len(ends) else 0
        leads = [lead] if lead else []
        if len(key) - cut <= RUN and not (lead and lead[0] == key[-1]):
            held = t.slice(cut)
            key, h, rest, lead = key[:cut], h[:cut], rest[:cut], None
        elif not lead or lead[0] != key[-1]:
            lead = (key[cut], h[cut], rest[cut])
            leads.append(lead)
        if len(key):
            yield from _near_in_buckets(key, h, rest, leads)
    if held is not None and held.num_rows:
        yield from _near_in_buckets(*(unsigned(held.column(c)) for c in ("key", "h", "rest")), [])


def _near_in_buckets(key: np.ndarray, h: np.ndarray, rest: np.ndarray, leads: list[tuple]):
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, len(key)])
    group = np.repeat(np.arange(len(start)), size)
    large, lead_h, lead_rest = size > RUN, h[start], rest[start]
    for k, x, r in leads:
        here = key[start] == k
        large[here], lead_h[here], lead_rest[here] = True, x, r
    a, b = [], []
    live = np.flatnonzero(~large[group] & (size[group] > 1))
    for d in range(1, RUN):
        live = live[live + d < len(key)]
        live = live[group[live + d] == group[live]]
        if not len(live):
            break
        near = live[(np.bitwise_count(rest[live] ^ rest[live + d]) <= REST) & (h[live] != h[live + d])]
        a.append(h[near]), b.append(h[near + d])
    if a:
        x, y = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
        both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1])), pa.nulls(len(both), pa.int64()), pa.nulls(len(both), pa.bool_())], names=["a", "b", "key", "near"])
    far = np.flatnonzero(large[group])
    if len(far):
        of = group[far]
        near = (np.bitwise_count(rest[far] ^ lead_rest[of]) <= REST) & (h[far] != lead_h[of])
        yield pa.RecordBatch.from_arrays([signed(lead_h[of]), signed(h[far]), signed(key[far]), pa.array(near)], names=["a", "b", "key", "near"])


def tile_pairs(key: np.uint64, images: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the images that have near rests under the key."""
    held = [table_entries(*x) for x in images]
    rests = [r[k == key] for k, r in held]
    rest, who = np.concatenate(rests), np.repeat(np.arange(len(images)), [len(r) for r in rests])
    i, j = np.nonzero(np.triu(np.bitwise_count(rest[:, None] ^ rest[None]) <= REST, 1))
    both = np.unique(np.stack([who[i], who[j]], 1), axis=0)
    return both[:, 0], both[:, 1]


def _joined(batches):
    """Which components the links of a tile join, as a forest of stars; rows come sorted by tile."""
    tile, comps, images = None, [], []

    def done():
        a, b = [], []
        for i, j in zip(*tile_pairs(np.int64(tile[0]).view(np.uint64), images)):
            if comps[i] != comps[j] and agree(images[i], images[j]):
                a.append(comps[i]), b.append(comps[j])
        if a:
            node, root = local_roots(np.array(a), np.array(b))
            yield pa.RecordBatch.from_arrays([pa.array(node[node != root]), pa.array(root[node != root])], names=["a", "b"])

    for batch in batches:
        for *at, comp, spots, bits in zip(*(batch.column(c).to_pylist() for c in ("key", "near", "far", "comp", "spots", "bits"))):
            if at != tile:
                if len(images) > 1:
                    yield from done()
                tile, comps, images = at, [], []
            comps.append(comp)
            images.append(_image(spots, bits))
    if len(images) > 1:
        yield from done()
    release()


def _verify(batches):
    for b in batches:
        same = []
        for sa, da, sb, db in zip(*(b.column(c).to_pylist() for c in ("spots_a", "bits_a", "spots_b", "bits_b"))):
            same.append(agree(_image(sa, da), _image(sb, db)))
        ok = pa.array(same, pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok)], names=["a", "b"])
    release()


def image_copies(scratch: Scratch, images: DataFrame, image_id: str = "image_id", data: str = "data") -> DataFrame:
    """(image_id, class_id, class_size, corners) of every image row.

    Equal bytes are one image. Of the others, two are compared whole if they share a key of the tables, with
    at most 6 of 64 further bits different; they are linked if at least six corner matches (48 of 256 bits differ at most) agree on one similarity transform,
    as for crops, turns, scalings, noise and changes of brightness or contrast. Mirrored copies are not found.
    class_id is the smallest id that links reach, class_size the number of different images there.

    In buckets of more than 4096 entries each is compared with the bucket's first; all that are not in one
    component by then meet in tiles, where every pair is compared. So no pair is left out for a bucket's size. Descriptors are shuffled only for images that have candidates.

    Null, empty or undecodable data: no corners, a class with equal bytes only (null: by itself). Flat
    images: likewise. Null ids: returned with a null class. Empty table: no rows. Repeated rows: alike. Other
    columns are not read.
    """
    rows = images.select(F.col(image_id).cast("long").alias("image_id"), F.col(data).cast("binary").alias("data"))
    rows = rows.withColumn("h", F.xxhash64("data"))
    names = ["image_id", "h", "n", "spots", "bits"]
    tests = chosen_tests()

    def corners(batches):
        last: dict[int, int] = {}  # of copies in a task the first holds the descriptors
        for b in batches:
            n, spots, bits = [], [], []
            for i, h, x in zip(*(b.column(c).to_pylist() for c in ("image_id", "h", "data"))):
                again = h in last
                if not again:
                    grey = decode(x) if x is not None else None
                    s, d = describe(grey, tests) if grey is not None else (np.zeros((0, 4), np.float32), np.zeros((0, TESTS), bool))
                    if i is not None:
                        last = last if len(last) < 100_000 else {}
                        last[h] = len(s)
                n.append(None if x is None else last[h] if again else len(s))
                some = not again and i is not None and len(s) > 0
                spots.append(s.tobytes() if some else None), bits.append(_packed(d).tobytes() if some else None)
            yield pa.RecordBatch.from_arrays([b.column("image_id"), b.column("h"), pa.array(n, pa.int32()), pa.array(spots, pa.binary()), pa.array(bits, pa.binary())], names=names)
        release()

    rows = scratch.write(rows.mapInArrow(corners, "image_id long, h long, n int, spots binary, bits binary"), "corners")
    described = rows.where("bits is not null").select("h", "spots", "bits")

    def spread(batches):
        for b in batches:
            h = b.column("h").to_numpy()
            for at in range(0, b.num_rows, 500):
                found = [table_entries(*_image(s.as_py(), d.as_py())) for s, d in zip(b.column("spots")[at : at + 500], b.column("bits")[at : at + 500])]
                key, rest = (np.concatenate(x) for x in zip(*found))
                owner = np.repeat(h[at : at + 500], [len(k) for k, _ in found])
                yield pa.RecordBatch.from_arrays([signed(key), pa.array(owner), signed(rest)], names=["key", "h", "rest"])

    entries = described.mapInArrow(spread, "key long, h long, rest long").repartition("key").sortWithinPartitions("key", "h")
    met = scratch.write(entries.mapInArrow(_meet, _MET), "met")
    pairs = scratch.write(met.where("near or key is null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    large = met.where("key is not null")
    wanted = pairs.unionByName(large.select("a", "b")).select(F.explode(F.array("a", "b")).alias("h")).distinct()
    shown = scratch.write(described.join(wanted, "h", "left_semi").dropDuplicates(["h"]), "shown")
    side = lambda c: shown.select(F.col("h").alias(c), F.col("spots").alias(f"spots_{c}"), F.col("bits").alias(f"bits_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "spots_a", "bits_a", "spots_b", "bits_b")
    comp = scratch.write(components(scratch, both.mapInArrow(_verify, "a long, b long")), "components")
    tiles = _tiles(large, comp).join(shown, "h").repartition("key", "near", "far").sortWithinPartitions("key", "near", "far")
    more = components(scratch, tiles.select("key", "near", "far", "comp", "spots", "bits").mapInArrow(_joined, "a long, b long"))
    comp = follow(comp, more).withColumnRenamed("node", "h")
    kinds = rows.where("image_id is not null and n is not null").groupBy("h").agg(F.min("image_id").alias("image"), F.max("n").alias("corners"))
    kinds = scratch.write(kinds.join(comp, "h", "left").withColumn("root", F.coalesce("root", "h")), "kinds")
    classes = kinds.groupBy("root").agg(F.min("image").alias("class_id"), F.count("*").alias("class_size"))
    named = scratch.write(kinds.join(classes, "root").select("h", "class_id", "class_size"), "named")
    known = rows.select("image_id", "n", F.when(F.col("n").isNotNull() & F.col("image_id").isNotNull(), F.col("h")).alias("h")).join(named, "h", "left")
    return known.select("image_id", F.when(F.col("image_id").isNotNull(), F.coalesce("class_id", "image_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), F.coalesce("n", F.lit(0)).alias("corners"))


def draw(vector: np.ndarray, side: int = 96) -> np.ndarray:
    """A picture of a vector: a smooth field of tones and a few boxes, which its components seed."""
    rng = np.random.default_rng(zlib.crc32(np.asarray(vector, np.float32).tobytes()))
    at = np.linspace(0, 15.99, side)
    out = _sample(rng.uniform(0, 255, (18, 18)).astype(np.float32), at[None] + np.zeros((side, 1)), at[:, None] + np.zeros((1, side)))
    for _ in range(4):
        x, y, w, h = rng.integers(0, side - 12), rng.integers(0, side - 12), rng.integers(6, 20), rng.integers(6, 20)
        out[y : y + h, x : x + w] = rng.integers(0, 256)
    return np.clip(out, 0, 255).astype(np.uint8)


#: The edits of planted copies, one after another.
EDITS = ("crop to half the area", "scale to 3/4", "quarter turn", "noise", "contrast", "frame")
#: Ids of planted copies: far from their originals'.
COPY_IDS = 1 << 40


def edited(picture: np.ndarray, edit: str) -> np.ndarray:
    h, w = picture.shape
    x = picture.astype(np.float32)
    if edit == "crop to half the area":
        return picture[: round(h * 0.7072), w - round(w * 0.7072) :]
    if edit == "scale to 3/4":
        x = _resize(x, 0.75)
    elif edit == "quarter turn":
        return np.ascontiguousarray(np.rot90(picture))
    elif edit == "noise":
        x = x + np.random.default_rng(zlib.crc32(picture.tobytes())).normal(0, 8, x.shape)
    elif edit == "contrast":
        x = x * 0.6 + 50
    else:
        x = np.pad(x[8:-6, 5:-9] * 0.85 + 30, 4, constant_values=20)
    return np.clip(np.round(x), 0, 255).astype(np.uint8)


def pgm(picture: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (picture.shape[1], picture.shape[0]) + picture.tobytes()


def pictures(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", every: int = 8) -> DataFrame:
    """(image_id, data): each row's vector drawn as a PGM file, and for each id divisible by `every` an edited copy with
    the id COPY_IDS + id; the edits take turns. Null vectors give null data, null ids no copy."""

    def render(batches):
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                ids, data = [], []
                for i, e in zip(part.column("id").to_pylist(), part.column("e").to_pylist()):
                    x = None if e is None else draw(np.array([0.0 if c is None else c for c in e], np.float32))
                    ids.append(i), data.append(None if x is None else pgm(x))
                    if x is not None and i is not None and i % every == 0:
                        ids.append(COPY_IDS + i), data.append(pgm(edited(x, EDITS[i // every % len(EDITS)])))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(data, pa.binary())], names=["image_id", "data"])

    return vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("e")).mapInArrow(render, "image_id long, data binary")
