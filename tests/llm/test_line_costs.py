"""What line dedup costs: each line of a part is hashed once, tiles without hope are left out; no link is lost by it."""

import numpy as np
import pyarrow as pa

from lumenreel.llm import lines


def edited(n):
    rng = np.random.default_rng(11)
    out = []
    for i in range(n):
        if i % 3 == 0:
            base = rng.choice(list("abcdefgh 中"), int(rng.integers(1, 200)))
        out.append("".join(c if rng.random() > 0.02 * (i % 3) else "z" for c in base))
    return out


def test_a_line_is_hashed_once_however_many_pairs_it_stands_in(monkeypatch):
    """Before: once for every pair."""
    texts, hashed, plain = edited(30), [], lines._hashed
    monkeypatch.setattr(lines, "_hashed", lambda x: hashed.extend(x) or plain(x))
    xs, ys = [x for x in texts for _ in texts], texts * len(texts)
    hope = lines.hopeful(xs, ys)
    assert sorted(hashed) == sorted(set(texts))
    cut = {x: set(lines._cut(x)) for x in texts}
    near = np.array([len(cut[x] & cut[y]) >= 0.8 * len(cut[x] | cut[y]) for x, y in zip(xs, ys)])
    assert not (near & ~hope).any() and near.sum() > len(texts) and hope.sum() < len(xs) / 2


def test_hashes_are_those_of_the_polynomial(monkeypatch):
    texts = ["", "abc", "abcdef", "abcdefg", "", *edited(40), "x" * 100, ""]
    want = []
    for t in texts:
        for i in range(len(t) - 6):
            h = 0
            for c in t[i : i + 7]:
                h = (h * 0x100000001B3 + ord(c)) % (1 << 64)
            want.append(h)
    h, n = lines._hashed(texts)
    assert (h == lines._mix(np.array(want, np.uint64))).all() and n.tolist() == [max(0, len(t) - 6) for t in texts]
    whole = lines.packed(texts), lines._maps(texts)[0]
    monkeypatch.setattr(lines, "AT_ONCE", 50)
    assert [list(x) for x in lines.packed(texts)] == [list(x) for x in whole[0]] and (lines._maps(texts)[0] == whole[1]).all()


def test_tiles_compare_lines_with_hope_only(monkeypatch):
    """The links between components are those of the whole tile (before: every line was coded)."""
    texts = edited(60)
    comp = np.arange(60) // 2 * 2  # some near lines are in one component already
    compared, plain = [], lines.tile_links
    i, j = plain(texts)
    want = {(a, b) for a, b in zip(comp[i].tolist(), comp[j].tolist()) if a != b}
    monkeypatch.setattr(lines, "tile_links", lambda x: compared.extend(x) or plain(x))
    rows = pa.RecordBatch.from_pydict({"key": [1] * 60, "near": [0] * 60, "far": [1] * 60, "comp": comp.tolist(), "line": texts})
    got = pa.Table.from_batches(list(lines._joined(iter([rows]))))
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    def classes(edges):
        root.clear()
        for a, b in edges:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        return [find(x) for x in comp.tolist()]

    assert want and classes(want) == classes(zip(got["a"].to_pylist(), got["b"].to_pylist()))
    assert 0 < len(compared) < 60
