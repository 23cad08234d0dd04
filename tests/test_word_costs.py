"""What the word and line queries cost: words move once, folds take Arrow batches, ratios are spared by grams; rules keep their results."""

import re
from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import functions as F

from lumenreel.functions import text as T
from lumenreel.functions.rules import VIDEO
from lumenreel.operators import dedupe, layout, rank
from lumenreel.plans import catalogue, evidence

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_title_boxes_are_folded_in_a_stream(spark):
    """A frame of many words whose boxes never join (before: an array of blocks copied for every word)."""
    p = plan(evidence.title_blocks(spark, SF))
    assert "MapInArrow" in p
    words = spark.range(20000).select(F.lit(1).cast("long").alias("video_id"), F.lit(0).alias("frame_idx"), F.col("id").alias("pos"), F.concat(F.lit("word"), F.col("id").cast("string")).alias("text"), F.lit(90.0).alias("conf"), (F.col("id") * 100).cast("int").alias("left"), F.lit(10).alias("top"), F.lit(50).alias("width"), F.lit(20).alias("height"))
    bands = spark.createDataFrame([(1, 0, 4000000, 400)], "video_id long, frame_idx int, width int, height int")
    boxes = words.withColumns({"w": F.lit(1280), "h": F.lit(400), "score": F.lit(0.5)})
    assert layout.merged_boxes(boxes).select(F.size("blocks").alias("n")).first()["n"] == 20000
    assert layout.title_blocks(words, bands).first()["title"]["text"].startswith("word")


def test_words_are_moved_with_their_document_only(spark):
    """Lines and regions are put together where the document was cut (before: every word or line was shuffled)."""
    for df in (rank.document_rows(evidence._words(spark, SF)), rank.confident_text(evidence._words(spark, SF))):
        assert re.findall(r"Exchange hashpartitioning\((\w+?)#", plan(df)) == ["doc_id"]


def test_lines_are_cleaned_where_documents_are_dealt(spark):
    """Every task cleans lines, in however few pieces the file is read (before: the tasks that read it)."""
    df = evidence.document_lines(spark, SF)
    assert re.findall(r"Exchange hashpartitioning\((\w+?)#", plan(df)) == ["doc_id"]


def test_folds_take_bounded_arrow_batches(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    for df in (catalogue.diverse_documents(spark, SF), evidence.frame_text(spark, SF), catalogue.near_dup_lines(spark, SF)):
        p = plan(df)
        assert "MapInArrow" in p and "InPandas" not in p
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == 16 << 20


def test_grams_bound_the_ratio():
    rng = np.random.default_rng(5)
    for _ in range(300):
        a = "".join(rng.choice(list("abcdef"), int(rng.integers(3, 90))))
        b = "".join(c if rng.random() > 0.08 else rng.choice(list("abcdef")) for c in a if rng.random() > 0.05)
        r = SequenceMatcher(None, a, b).ratio()
        x, y = dedupe.grams(a), dedupe.grams(b)
        assert sum((x & y).values()) >= dedupe.grams_needed(len(a), len(b), r)


def test_the_last_kept_texts_are_a_ring():
    held = dedupe.Kept(0.9, 8, 2)
    texts = ["first line of all", "another one here", "zzzz qqqq xxxx"]
    for t in texts:
        held.add(t, dedupe.histograms([t])[0])
    assert [held.alike(t, dedupe.histograms([t])[0]) for t in texts] == [False, True, True]


def test_cheap_rules_equal_the_plain_ones(spark):
    """Guards change no result: the patterns as they were, on texts of every kind."""
    texts = ["  At 12:30 am, Spam-pm  x ", "10:5012:30", "a\u3000b\t c", "AM", "pm am", "x\u00a0y  z", "the THE \u212aelvin", "Obsidion \u4f7f \u7528 ( a ) b", "\u4e2d \u6587 , \u4e2d\uff0c", "al Al AL", "team spam", "a(b )c", "", " ", "one two  three", "_-/x:y", "12:3456", "caf\u00e9 3:45pm", "na\u00efve\u2003word"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    x = F.lower(T.strip(t))
    for p, r in ((r"(?<!\d)\d{1,2}:\d{2}(?!\d)", " "), (r"\s+", " "), (r"[^0-9a-zA-Z\x{4e00}-\x{9fff} /:_-]+", " "), (r"\b(?:am|pm)\b", " "), (r"(?U)\s+", " ")):
        x = F.regexp_replace(x, p, r)
    terms, spacing = t, t
    for p, r in VIDEO.known_terms:
        terms = F.regexp_replace(terms, "(?iU)" + p, r)
    for p, r in ((rf"(?<={T.CJK})\s+(?={T.CJK})", ""), (r"\s+([，。？！：；、）)])", "$1"), (r"([（(])\s+", "$1"), (r"\s{2,}", " ")):
        spacing = F.regexp_replace(spacing, p, r)
    one = df.select(T.title_text(t).alias("a"), T.strip(x).alias("b"), T.known_terms(t, VIDEO).alias("c"), terms.alias("d"), T.document_spacing(t).alias("e"), T.strip(spacing).alias("f"), T.collapse(t).alias("g"), T.strip(F.regexp_replace(t, r"(?U)\s+", " ")).alias("h"), T.count(t, "[a-z]").alias("i"), (F.length(t) - F.length(F.regexp_replace(t, "[a-z]", ""))).alias("j"), T.no_space(t).alias("k"), F.regexp_replace(t, r"(?U)\s+", "").alias("l"))
    for r in one.collect():
        assert r["a"] == r["b"] and r["c"] == r["d"] and r["e"] == r["f"] and r["g"] == r["h"] and r["i"] == r["j"] and r["k"] == r["l"]


def test_title_words_are_moved_with_their_document_only(spark):
    """Words are dealt with their frame's document, and so meet their band (before: each word was shuffled once more)."""
    p = plan(evidence.title_blocks(spark, SF))
    words = p[p.index("MapInArrow") :]
    words = words[: words.index("Exchange hashpartitioning")]
    assert "ShuffledHashJoin" in words and words.count("Generate posexplode") == 2


def test_title_words_equal_the_title_signal(spark):
    """Words of letters are scored by length, those of letters and spaces without arrays; both as by all rules."""
    rng = np.random.default_rng(3)
    texts = ["", " ", "a", "am", "PM", "I'm", "t.am", "x:am", "12:30pm", "ab", "abc", "abcd", "abcde", "abcdef", "a" * 80, "a" * 81, "café", "für", "naïve", "ciónco", "Kelvin", "İstanbul", "a\tb", "x y", " word ", "word.", "(word),", "team!", "中文", "中", "a1b2", "12345", "12345abc", "_-/", "x-y", "http://a.b/c", "|", "abc abc.abc", "abécdéeféghéijéklémnéop", None]
    texts += ["".join(rng.choice(list("abcmpéß.,:-1 A中"), int(rng.integers(1, 24)))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r["i"]: (r["text"], r["quality"], r["kinds"]) for r in layout._title_words(df).collect()}
    s = T.title_signal(T.title_text(F.col("text")))
    want = {r["i"]: (r["t"], r["q"], r["k"]) for r in df.select("i", T.title_text(F.col("text")).alias("t"), s["quality_score"].alias("q"), s["meaningful_token_count"].alias("k")).collect() if r["t"]}
    assert got == want and len({q for _, q, _ in got.values()}) > 8


def plain_blocks(rows, w):
    blocks = []
    for r in rows:
        c, left = blocks[-1] if blocks else None, r["left"]
        if c and left is not None and c["left"] is not None and abs(left - c["left"]) <= max(28, int(w * 0.06)) and r["top"] - (c["top"] + c["height"]) <= max(18, int(c["height"] * 0.7)):
            right, bottom = max(c["left"] + c["width"], left + r["width"]), max(c["top"] + c["height"], r["top"] + r["height"])
            c.update(text=f"{c['text']} {r['text']}", top=min(c["top"], r["top"]), left=min(c["left"], left), score=max(c["score"], r["score"]), n=c["n"] + 1)
            c.update(width=right - c["left"], height=bottom - c["top"])
        else:
            blocks.append(dict(r, n=1))
    return blocks


def test_boxes_merge_as_in_a_plain_loop(spark):
    """Frames over many small batches, with boxes in chains, at equal places and without a left edge; of single blocks only the
    best has to stay if it is asked for (before: every word went through Python's loop and had its text scored again)."""
    rng = np.random.default_rng(8)
    rows = []
    for v in range(60):
        for p in range(int(rng.integers(1, 90))):
            left = None if rng.random() < 0.03 else int(rng.integers(0, 700 if v % 2 else 200))
            rows.append(dict(video_id=v // 3, frame_idx=v % 3, w=1280 if v % 4 else 400, h=400, top=int(rng.integers(0, 900 if v % 5 else 90)), left=left, pos=p, width=int(rng.integers(1, 90)), height=int(rng.integers(1, 40)), text=f"t{p}", conf=50.0, score=float(rng.integers(0, 9)), alone=float(rng.integers(0, 5))))
    kind = "video_id long, frame_idx int, w int, h int, top int, left int, pos long, width int, height int, text string, conf double, score double, alone double"
    df = spark.createDataFrame([tuple(r.values()) for r in rows], kind)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        every = layout.merged_boxes(df.drop("alone")).collect()
        best = {(r["video_id"], r["frame_idx"]): r["blocks"] for r in layout.merged_boxes(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(every) == len(best) == 60
    shown = ["top", "left", "width", "height", "text", "score"]
    for r in every:
        key = r["video_id"], r["frame_idx"]
        mine = sorted((x for x in rows if (x["video_id"], x["frame_idx"]) == key), key=lambda x: (x["top"], -1 if x["left"] is None else x["left"], x["pos"]))
        want = plain_blocks(mine, r["w"])
        assert [[b[c] for c in shown] for b in r["blocks"]] == [[b[c] for c in shown] for b in want]
        most = max((b["alone"] for b in want if b["n"] == 1), default=None)
        first = next((b for b in want if b["n"] == 1 and b["alone"] == most), None)
        assert [b["text"] for b in best[key]] == [b["text"] for b in want if b["n"] > 1 or b is first]
