"""Images of any bytes and any pattern, and vectors of very unlike length."""

import resource
import struct
import time
import zlib

import numpy as np
import pytest

pytest.importorskip("lumenreel.llm")

from lumenreel.llm import ann, media  # noqa: E402
from lumenreel.llm.common import Scratch  # noqa: E402


def png(x, filters=(0, 1, 2, 3, 4)):
    h, w = x.shape
    rows = b"".join(bytes([filters[y % len(filters)]]) + x[y].tobytes() for y in range(h))
    part = lambda kind, data: struct.pack(">I4s", len(data), kind) + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def test_any_bytes_decode_or_give_none():
    x = np.random.default_rng(0).integers(0, 256, (9, 7), dtype=np.uint8)
    files = [b"P5 7 9 255\n" + x.tobytes(), b"P6\n# a remark\n3 7 # more\n255\n" + x.tobytes(), png(x)]
    assert all(media.decode(f) is not None for f in files)
    began, rng = time.time(), np.random.default_rng(1)
    for f in files:
        for n in range(len(f)):
            cut = media.decode(f[:n])
            assert cut is None or f[:4] == b"\x89PNG" and n >= len(f) - 16  # all values are there
        for _ in range(4000):
            bad = bytearray(f)
            for _ in range(rng.integers(1, 6)):
                bad[rng.integers(0, len(bad))] = rng.integers(0, 256)
            y = media.decode(bytes(bad))
            assert y is None or y.ndim == 2
    for f in (b"P5", b"P5 12", b"P5 -2 2 255 abcdef", b"P5 999999999 999999999 255\n", b"P5 2 2 65535 abcdefgh", b"P5 0 0 255\n", b"\x89PNG\r\n\x1a\n", b"", b"\xff\xd8\xff\xe0"):
        assert media.decode(f) is None
    huge = bytearray(png(x))
    huge[16:24] = struct.pack(">II", 1 << 30, 1 << 30)
    assert media.decode(bytes(huge)) is None
    assert time.time() - began < 60


def test_comments_and_smaller_ranges():
    x = np.arange(12, dtype=np.uint8).reshape(3, 4)
    assert (media.decode(b"P5 # w\n#h\n4 3\n#top\n255\n" + x.tobytes()) == x).all()
    assert np.allclose(media.decode(b"P5 4 3 15 " + x.tobytes()), x * 17)


@pytest.mark.parametrize("side, tile", [(240, 24), (480, 24), (480, 16)])
def test_repeated_patterns_stay_within_memory(side, tile):
    one = np.kron(np.random.default_rng(3).integers(0, 256, (tile // 8, tile // 8)), np.ones((8, 8)))
    picture = np.tile(one, (side // tile, side // tile)).astype(np.float32)
    spots, bits = media.describe(picture, media.chosen_tests())
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    image = (spots, media._packed(bits))
    assert media.agree(image, image)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500 << 10 and time.time() - began < 60


def test_blocks_of_transforms_agree_with_all_at_once(monkeypatch):
    rng = np.random.default_rng(5)
    p = np.c_[rng.uniform(0, 200, (300, 2)), rng.uniform(0, 6, 300), np.ones(300)].astype(np.float32)
    q = p.copy()
    q[:120, :2] += 17
    q[120:, :2] = rng.uniform(0, 200, (180, 2))
    whole = media.consensus(p, q)
    monkeypatch.setattr(media, "ROOM", 48 * 300 * 7)
    assert media.consensus(p, q) == whole >= 50 and media.consensus(p, q, 6) >= 6


def recall(spark, x, ids):
    rows = [(i, [float(c) for c in e]) for i, e in enumerate(x)]
    got = ann.nearest(Scratch(spark, "t"), spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    found = total = 0
    for q in ids:
        s = x @ x[q]
        s[q] = -np.inf
        best = set(np.lexsort((np.arange(len(x)), -s))[:20].tolist())
        mine = got[got.query_id == q].sort_values("rank")
        assert len(mine) == 20 and np.allclose(mine.score, s[mine.vec_id])
        found, total = found + len(best & set(mine.vec_id)), total + 20
    return found / total


@pytest.mark.parametrize("kind", ["one long", "heavy tails", "half tiny", "several huge"])
def test_norms_that_differ_widely(spark, kind):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(2000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if kind == "one long":
        x[77] *= 1e6
    elif kind == "heavy tails":
        x *= rng.pareto(0.5, 2000)[:, None] + 0.01
    elif kind == "half tiny":
        x[::2] *= 1e-200
    else:
        x[:5] *= 1e150
    assert recall(spark, x, range(0, 2000, 20)) >= 0.9


def test_products_beyond_doubles():
    x = np.array([[1e200, 1e200], [1e200, -1e200], [1.0, 2.0]])
    with np.errstate(over="ignore"):
        got = ann.products(x, np.array([1e200, 1e200]))
    assert got[0] == np.inf and got[1] == 0.0 and got[2] == 3e200
