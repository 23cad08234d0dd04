"""Language identification, importance resampling and centroid clustering against brute force and on odd rows."""

import hashlib
import math
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("lumenreel.llm")

from lumenreel.llm import centroids, langid, resampling  # noqa: E402
from lumenreel.llm.common import Scratch  # noqa: E402

LONG = " ".join(f"w{i % 977}" for i in range(60_000))
DOCS = "doc_id long, text string, lang string, score double, bucket int, rank string"


def documents(spark, rows):
    return spark.createDataFrame([(*r, 0.5, 3, "x") for r in rows], DOCS)


# --- centroids --------------------------------------------------------------------------------------------------


def brute_clusters(rows, k=16, rounds=3, dim=64):
    """Everything in Python's integers."""
    kept = [(i, [math.floor(64 * Fraction(c)) for c in e]) for i, e in rows if e is not None and len(e) == dim and all(c is not None and math.isfinite(c) for c in e)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)[:k]
    c = [x for _, x in first]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    for turn in range(rounds + 1):
        near = [min((far(x, y), j) for j, y in enumerate(c)) for _, x in kept] if c else []
        if turn < rounds:
            for j in range(len(c)):
                mine = [x for (_, x), (_, n) in zip(kept, near) if n == j]
                if mine:
                    c[j] = [sum(v) // len(mine) for v in zip(*mine)]
    return sorted(((i, n, d if d < 1 << 63 else None) for (i, _), (d, n) in zip(kept, near)), key=str), c


def vectors(seed, n, scale=1.0, dim=64):
    return [(i, [float(v) for v in e]) for i, e in enumerate(np.random.default_rng(seed).normal(0, scale, (n, dim)))]


def odd_vectors():
    rows = vectors(1, 60)
    rows += [(60, None), (61, []), (62, [1.0] * 63), (63, [1.0] * 65), (64, [float("nan")] + [0.0] * 63), (65, [float("inf")] + [0.0] * 63), (66, [None] + [0.0] * 63)]
    rows += [(None, [0.1] * 64), (3, rows[3][1]), (3, rows[4][1]), (67, [0.0] * 64), (68, [0.0] * 64)]
    return rows


@pytest.mark.parametrize("rows", [odd_vectors(), vectors(2, 9), vectors(3, 40, 1e6), vectors(4, 30) + [(99, [1e7] * 64), (100, [-3e8] * 64)], vectors(5, 30) + [(99, [1e300] * 64), (100, [1.7e308] + [0.0] * 63)]], ids=["odd rows", "few rows", "beyond 2^53", "long integers", "beyond long integers"])
def test_clusters(spark, rows):
    v = spark.createDataFrame([(i, e, 7) for i, e in rows], "vec_id long, embedding array<double>, cluster int").repartition(4)
    scratch = Scratch(spark, "t")
    placed, found = centroids.cluster(scratch, v)
    want, last = brute_clusters(rows)
    assert sorted((tuple(r) for r in placed.collect()), key=str) == want
    assert [[int(c) for c in x] for x in found.centroids] == last
    out = centroids.with_facts(scratch, placed, found).collect()
    fits = lambda d: None if None in d or sum(d) >= 1 << 63 else sum(d)
    assert {r["inertia"] for r in out} == {fits([d for _, _, d in want])}
    for r in out:
        assert r["cluster_inertia"] == fits([d for _, n, d in want if n == r["cluster"]])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, last[r["cluster"]])).encode()).hexdigest()


def test_clusters_of_nothing(spark):
    scratch = Scratch(spark, "t")
    for rows in ([], [(1, None)], [(None, [0.5] * 64)][:0]):
        v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        assert centroids.with_facts(scratch, *centroids.cluster(scratch, v)).count() == 0


def test_products_and_integers_agree():
    rng = np.random.default_rng(7)
    x, c = rng.integers(-500, 500, (300, 64)), rng.integers(-500, 500, (16, 64)).astype(object)
    c[3] = c[9]  # a tie: the smaller number
    near, far = centroids.nearest_centroid(x, c)
    d = ((x[:, None] - c[None].astype(np.int64)) ** 2).sum(2)
    assert (near == d.argmin(1)).all() and (far == d.min(1)).all() and not (near == 9).any()
    c[5] = [10**25] * 64  # one centroid too large for products
    near, _ = centroids.nearest_centroid(x, c)
    d[:, 5] = 1 << 62
    assert (near == d.argmin(1)).all()


def test_sums_come_as_one_row_a_task(spark):
    """Half of all rows alike: the tree gets one row of sums a task, whatever the rows."""
    rows = [(i, [0.25] * 64) for i in range(500)] + vectors(8, 500)
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(9)
    placed, found = centroids.cluster(Scratch(spark, "t"), v, k=4)
    assert placed.count() == 1000 and len(found.centroids) == 4


# --- resampling ---------------------------------------------------------------------------------------------------


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [zlib.crc32(f.encode()) % 10_000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def brute_resample(docs, target, share=25):
    s, t = np.zeros(10_000), np.zeros(10_000)
    for _, text in docs:
        np.add.at(s, features(text)[1], 1)
    for text in target:
        np.add.at(t, features(text)[1], 1)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + 10_000) / ((s[b] + 1) * (t.sum() + 10_000)))) for b in range(10_000)]
    rows = []
    for i, text in docs:
        n, f = features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= 20))
    good = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    most = share * len(good) // 100
    drawn = [(*r[:4], k + 1) for k, r in enumerate(good[:most])]
    return sorted(drawn + [(*r[:4], None) for r in good[most:]] + [(*r[:4], None) for r in rows if not r[4]], key=str)


def sentence(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(["Alpha", "beta7", "ñandú", "日本", "x-y", "GAMMA", "d'or", "1999"], n))


@pytest.mark.parametrize("width", [1_000_000, 3])
def test_resample(spark, monkeypatch, width):
    monkeypatch.setattr(resampling, "RANGE", width)
    rows = [(i, sentence(i, 10 + i % 40)) for i in range(120)] + [(200, None), (201, ""), (202, "?! @ ["), (203, "one"), (204, LONG), (None, sentence(5, 40)), (7, sentence(7, 50)), (205, "😀 " * 30)]
    rows += [(300, sentence(9, 60))] * 40 + [(None, sentence(9, 60))] * 5  # repeated rows, all at one score
    docs = documents(spark, [(i, t, "en") for i, t in rows]).repartition(5)
    target = ["Alpha beta7 日本", "gamma GAMMA ñandú", "", None]
    b = spark.createDataFrame([(i, t, 1) for i, t in enumerate(target)], "item_id long, text string, rank int")
    out = resampling.resample(Scratch(spark, "t"), docs, b)
    got = sorted((tuple(r) for r in out.collect()), key=str)
    assert got == brute_resample(rows, target)
    ids = {r[0] for r in got if r[4] is not None and r[0] is not None}
    assert {r["doc_id"] for r in resampling.drawn(docs, out).collect()} == ids


def test_resample_of_few_or_no_rows(spark):
    b = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    assert resampling.resample(Scratch(spark, "t"), documents(spark, []), b).count() == 0
    few = [(i, sentence(i, 30)) for i in range(3)]  # a quarter of three: none is drawn
    for target in (b, b.limit(0)):
        out = resampling.resample(Scratch(spark, "t"), documents(spark, [(*r, None) for r in few]), target).collect()
        assert sorted(map(tuple, out), key=str) == brute_resample(few, [r["text"] for r in target.collect()])


def test_gains_are_one_literal(spark, capsys):
    """The array of gains is folded when the plan is made, and scoring neither explodes nor shuffles."""
    rows = spark.range(3).select(resampling.buckets_of(resampling.words(resampling.F.lit("a b"))).alias("b"))
    rows.select(resampling.weight_of(resampling.F.col("b"), list(range(10_000))).alias("w")).explain()
    plan = capsys.readouterr().out
    assert "split(" not in plan and "Exchange" not in plan and "Generate" not in plan


# --- languages ----------------------------------------------------------------------------------------------------

SAID = {
    "en": "the house and the garden are near the river where they would like to sit with friends",
    "de": "das haus und der garten liegen nahe am fluss wo sie gerne mit freunden sitzen würden",
    "fr": "la maison et le jardin sont près de la rivière où ils aiment être assis avec des amis",
}


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, SAID[k], k) for i, k in enumerate(list(SAID) * 5)] + [(None, "the", None), (77, None, "en"), (78, "", "de"), (79, "123 456", "fr")]
    return langid.fit(Scratch(spark, "t"), documents(spark, rows).repartition(3))


def test_counts_are_those_of_the_rows(model):
    assert model.names == ["de", "en", "fr"]
    words = {k: v.split() for k, v in SAID.items()}
    for k, name in enumerate(model.names):
        own = "la" if name == "fr" else "the"
        share = words[name].count(own) / len(words[name])
        assert model.log(0, own)[k] == pytest.approx(math.log(share) if share else langid.PENALTY)
        all3 = [g for w in words[name] for g in langid.grams(w, 3)]
        assert model.log(3, "en ")[k] == pytest.approx(math.log(all3.count("en ") / len(all3)) if "en " in all3 else langid.PENALTY)


def test_words_back_off_to_the_longest_known_grams(model):
    def backed(word):
        for n in range(5, 0, -1):
            rows = [x for x in (model.log(n, g) for g in langid.grams(word, n)) if x is not None]
            if rows:
                return n, np.mean(rows, axis=0)
        return 0, None

    assert (model.word("garten") == model.log(0, "garten")).all()
    lengths = set()
    for word in ("gartenhaus", "freundinnen", "qwx", "zwx", "têtes", "xthx", "ξξ", "a" * 5000, "öß"):
        n, want = backed(word)
        lengths.add(n)
        got = model.word(word)
        assert (got is None) == (want is None) and (got is None or np.allclose(got, want))
    assert {0, 1, 5} <= lengths


def test_words_inside_tokens():
    tokens = ["don't", "\u0301a\u0301b", "x-y_z1w", "123", "日本語テキスト", "\u0301", "a\u0301\u0302"]
    points, lengths = langid._points(tokens)
    token, start, size = langid.letter_runs(points, lengths)
    got = [(t, "".join(map(chr, points[a : a + n]))) for t, a, n in zip(token.tolist(), start.tolist(), size.tolist())]
    assert got == [(i, w) for i, t in enumerate(tokens) for w in langid._LETTERS.findall(t)]
    keys = langid.word_keys(points, start, size)
    assert (keys == langid.keys_of(0, [w for _, w in got])).all() and len(set(keys.tolist())) == len({w for _, w in got})


def test_predictions(spark, model):
    rows = [(1, "The gardens of the house", None), (2, "DAS GARTENHAUS", "x"), (3, "les jardins, être!", None), (4, None, "en"), (5, "", "en"), (6, "12 ?! 34", "en"), (7, "ξξξ", "en"), (8, "the " * 50_000, "en"), (None, "der garten", None), (1, "The gardens of the house", None)]
    docs = documents(spark, rows).withColumn("lang_pred", resampling.F.lit("clash"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(Scratch(spark, "t"), docs, model).collect()}
    assert [got[i][0] for i in (1, 2, 3, 4, 5, 6, 8, None)] == ["en", "de", "fr", "und", "und", "und", "en", "de"]
    assert got[4][1] == got[6][1] == 0.0 and got[7] == ("de", pytest.approx(1 / 3)) and got[8][1] == pytest.approx(1.0)
    assert all(0 <= s <= 1 for _, s in got.values())
    assert langid.predict(Scratch(spark, "t"), documents(spark, []), model).count() == 0


def test_no_language_to_learn(spark):
    nothing = langid.fit(Scratch(spark, "t"), documents(spark, [(1, "some words", None)]))
    assert nothing.predict(pa.array(["some words", ""]))[0] == ["und", "und"]


def test_the_sample_is_a_limit_a_language(spark):
    rows = [(i, f"common only{i}", "en") for i in range(50)] + [(99, "selten selten", "de")]
    some = langid.fit(Scratch(spark, "t"), documents(spark, rows).repartition(6), sample=10)
    assert some.names == ["de", "en"] and some.log(0, "selten") is not None
    assert some.log(0, "common")[1] == pytest.approx(math.log(10 / 20))


@pytest.mark.parametrize("sample", [1, 7, 40, 399, 400, 5000])
def test_the_end_of_a_sample(spark, sample):
    rng = np.random.default_rng(sample)
    rows = [(k, int(h), int(c)) for k, n in (("a", 400), ("b", 3)) for h, c in rng.integers(-(1 << 63), 1 << 63, (n, 2))] + [("c", 5, 9)] * 50
    got = langid._ends(spark.createDataFrame(rows, "lang string, h long, c long").repartition(3), sample)
    for k in "abc":
        mine = sorted((h, c) for lang, h, c in rows if lang == k)
        assert sum(x <= got[k] for x in mine) == (min(sample, len(mine)) if k != "c" else 50)


def test_held_out_accuracy(spark):
    from lumenreel.llm import queries

    got = queries.op11_langid(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang")
    held = got.where("held_out").join(docs, "doc_id").collect()
    assert held and sum(r["lang"] == r["lang_pred"] for r in held) / len(held) >= 0.98
    assert {r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got.collect()} == {True}
