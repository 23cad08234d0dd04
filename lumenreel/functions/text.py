"""Scalar text functions as Column expressions: they stay in generated code and push nothing to Python."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenreel.functions import rules
from lumenreel.functions.rules import PLAIN, RulePack

CJK = r"[\x{4e00}-\x{9fff}]"
USEFUL = r"[0-9A-Za-z\x{4e00}-\x{9fff}]"


def count(text: Column, pattern: str) -> Column:
    """How many signs of a class a text holds (the pattern matches one sign): no array of matches is made, and signs that
    follow each other are one match."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern + "+", ""))


def kept(x: Column, keep) -> Column:
    """Rows of a value that is kept, none of one that is not. As the element of an array the value is worked out once; a filter
    after it would be pushed below and work it out again."""
    return F.explode(F.filter(F.array(x), keep))


def once(x: Column) -> Column:
    """A value that is worked out once a row, in a generator of its own, however often later columns use it."""
    return F.explode(F.array(x))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it is used; the optimizer does not inline it."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: All signs of white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Both ends without any white space (trim alone takes spaces only)."""
    return F.btrim(text, F.lit(WHITE))


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(one_space(text))


def ascii_only(text: Column) -> Column:
    """Whether a text holds printable ASCII alone: rules of all Unicode's signs can then be left out or made plain."""
    return ~text.rlike(r"[^\x20-\x7e]")


def one_space(text: Column) -> Column:
    """Each run of white space as one space. A text whose only white space is single spaces is left as it is."""
    return let(text, lambda t: F.when(ascii_only(t) & ~F.contains(t, F.lit("  ")), t).otherwise(F.regexp_replace(t, r"(?U)\s+", " ")))


def no_space(text: Column) -> Column:
    return let(text, lambda t: F.when(ascii_only(t), F.replace(t, F.lit(" "), F.lit(""))).otherwise(F.regexp_replace(t, r"(?U)\s+", "")))


def replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Rules applied one after another, whatever the case. On ASCII the classes of all Unicode's signs (but for those written
    with \\p) and of ASCII's are the same, and the latter are far cheaper."""
    if not pairs:
        return F.coalesce(text, F.lit(""))
    one = lambda t, p: F.regexp_replace(t, "(?iU)" + p[0], p[1])

    def step(t: Column, p: tuple[str, str]) -> Column:
        if not p[0].isascii() or "\\p" in p[0]:
            return one(t, p)
        return let(t, lambda x: F.when(ascii_only(x), F.regexp_replace(x, "(?i)" + p[0], p[1])).otherwise(one(x, p)))

    return reduce(step, pairs, F.coalesce(text, F.lit("")))


def known_terms(text: Column, pack: RulePack = PLAIN) -> Column:
    return replaced(text, pack.known_terms)


def common_terms(text: Column, pack: RulePack = PLAIN) -> Column:
    fixed = replaced(text, pack.misreadings)
    for name in pack.gapped_names:
        fixed = F.replace(fixed, F.lit(f"{name} 使 用"), F.lit(f"{name}使用"))
    return known_terms(fixed, pack)


def any_of(text: Column, words: list[str]) -> Column:
    """Whether a text holds one of the words."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words], F.lit(False))


def how_many_of(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(w)).cast("int") for w in words], F.lit(0))


def strip_of(text: Column, signs: str) -> Column:
    """Both ends without any of the signs."""
    return F.btrim(text, F.lit(signs))


def title_text(text: Column) -> Column:
    """Lower case, without clock times and am/pm, of letters, digits, CJK and / : _ - only."""
    return let(F.lower(strip(F.coalesce(text, F.lit("")))), _title_of_lower)


def _title_of_lower(t: Column) -> Column:
    """Patterns run only on texts that hold what they look for; most words hold nothing of it."""
    halves = lambda x: F.contains(x, F.lit("am")) | F.contains(x, F.lit("pm"))
    spaced = lambda x: F.trim(F.when(F.contains(x, F.lit("  ")), F.regexp_replace(x, " {2,}", " ")).otherwise(x))
    plain = ~t.rlike("[^0-9a-z /_-]") & ~F.contains(t, F.lit("  ")) & ~halves(t)
    timeless = F.when(F.contains(t, F.lit(":")), F.regexp_replace(t, r"(?<!\d)\d{1,2}:\d{2}(?!\d)", " ")).otherwise(t)
    known = F.regexp_replace(timeless, r"[^0-9a-zA-Z\x{4e00}-\x{9fff} /:_-]+", " ")
    rest = let(known, lambda x: F.when(halves(x), F.regexp_replace(x, r"\b(?:am|pm)\b", " ")).otherwise(x))
    return F.when(plain, t).otherwise(let(rest, spaced))


def title_tokens(normal: Column) -> Column:
    """Tokens with two CJK signs, three letters, or two letters and a digit in four signs."""
    compact = F.transform(F.filter(F.split(normal, " "), lambda t: t != ""), lambda t: F.btrim(t, F.lit("-_/:")))
    return F.filter(compact, lambda t: t.rlike(_GOOD_TOKEN) | ((F.length(t) >= 4) & t.rlike(r"[a-zA-Z][^a-zA-Z]*[a-zA-Z]") & t.rlike(r"\d")))


#: Three letters, or two CJK signs.
_GOOD_TOKEN = rf"[a-zA-Z][^a-zA-Z]*[a-zA-Z][^a-zA-Z]*[a-zA-Z]|{CJK}[^\x{{4e00}}-\x{{9fff}}]*{CJK}"


def title_signal(text: Column) -> Column:
    """normalized_text, meaningful_text, meaningful_tokens, quality_score, is_meaningful, token_count, meaningful_token_count."""
    return let(title_text(text), _signal_of_normal)


def _signal_of_normal(normal: Column) -> Column:
    tokens = F.filter(F.split(normal, " "), lambda t: t != "")
    facts = F.struct(
        tokens.alias("tokens"), title_tokens(normal).alias("good"), count(normal, CJK).alias("cjk"), count(normal, "[a-zA-Z]").alias("alpha"), count(normal, r"\d").alias("digit"),
    )
    return let(facts, lambda f: let(_title_facts(f), lambda k: _signal_of_facts(normal, f, k)))


def _title_facts(facts: Column) -> Column:
    """What the score looks at more than once, worked out once."""
    tokens, good = facts["tokens"], facts["good"]
    held = F.size(good)
    mean = F.when(held > 0, F.aggregate(good, F.lit(0), lambda a, t: a + F.length(t)) / held).otherwise(F.lit(0.0))
    short = F.size(F.filter(tokens, lambda t: F.length(F.btrim(t, F.lit("-_/:"))) <= 2))
    heavy = facts["digit"] > F.greatest(F.lit(4), facts["alpha"] + facts["cjk"])
    return F.struct(F.size(tokens).alias("n"), F.size(F.array_distinct(good)).alias("kinds"), held.alias("held"), mean.alias("mean"), short.alias("short"), heavy.alias("heavy"))


def _signal_of_facts(normal: Column, facts: Column, more: Column) -> Column:
    good, cjk, alpha = (facts[k] for k in ("good", "cjk", "alpha"))
    n, kinds, held, mean, short, heavy = (more[k] for k in ("n", "kinds", "held", "mean", "short", "heavy"))
    size = F.length(normal)
    total = _title_points((cjk >= 2) | (alpha >= 6), size, n, kinds, mean, short) + F.when(heavy, -25).otherwise(0)
    score = let(total, lambda x: _share_of_points(x, held))
    out = lambda q: F.struct(normal.alias("normalized_text"), F.array_join(good, " ").alias("meaningful_text"), good.alias("meaningful_tokens"), q.alias("quality_score"), ((q >= 0.55) & (kinds >= 1) & ~heavy).alias("is_meaningful"), n.alias("token_count"), kinds.alias("meaningful_token_count"))
    return let(score, out)


def _title_points(signs: Column, size: Column, n: Column, kinds: Column, mean: Column, short: Column) -> Column:
    """Points of a title's length and tokens; signs: whether it holds enough of them."""
    parts = [
        F.when(signs, 35).otherwise(0),
        F.when(kinds >= 2, 25).when((kinds == 1) & (mean >= 4), 12).otherwise(0),
        F.when(mean >= 4, 20).when(mean >= 3, 10).otherwise(0),
        F.when(size.between(6, 80), 15).when(size.between(4, 5) & (kinds >= 1), 5).otherwise(0),
        F.when((n <= 8) & (kinds >= 1), 5).otherwise(0),
        F.when((n >= 6) & (short / F.greatest(n, F.lit(1)) >= 0.55), -25).otherwise(0),
        F.when((n >= 8) & (kinds <= 2), -20).otherwise(0),
    ]
    return reduce(lambda a, b: a + b, parts)


def _share_of_points(total: Column, held: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.when(held == 0, 25).otherwise(100), total)) / F.lit(100.0)


#: A word of ASCII letters alone.
LETTERS = r"\A[A-Za-z]+\z"


def title_text_of(low: Column, letters: Column) -> Column:
    """`title_text` of a word that is stripped and in lower case; letters: whether it is known to hold ASCII letters alone. Any other
    without space, colon, am and pm needs one pattern."""
    halves = F.contains(low, F.lit("am")) | F.contains(low, F.lit("pm"))
    hard = F.contains(low, F.lit(":")) | F.contains(low, F.lit(" ")) | halves
    cleaned = F.trim(F.regexp_replace(low, r"[^0-9a-zA-Z\x{4e00}-\x{9fff} /:_-]+", " "))
    whole = F.when(low.isin("am", "pm"), "").otherwise(low)
    return F.when(letters, whole).when(hard, let(low, _title_of_lower)).otherwise(cleaned)


def long_tokens(plain: Column) -> Column:
    """The title tokens, of three letters or more, of a title text of letters and single spaces."""
    return F.trim(F.regexp_replace(plain, r"\b[a-z]{1,2}\b ?", ""))


def token_count(text: Column) -> Column:
    """How many tokens stand between single spaces."""
    return F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1)


def token_kinds(text: Column) -> Column:
    return F.when(text == "", 0).when(F.contains(text, F.lit(" ")), F.size(F.array_distinct(F.split(text, " ")))).otherwise(1)


def plain_quality(size: Column, n: Column, held: Column, kinds: Column, mean: Column) -> Column:
    """quality_score of `title_signal` for a title text of letters and single spaces: its length, tokens, long tokens, different
    ones of these and their mean length."""
    return _share_of_points(_title_points(size - n + 1 >= 6, size, n, kinds, mean, n - held), held)


def word_quality(size: Column) -> Column:
    """The same for a text of one token, by its length."""
    return F.when(size < 3, 0).when(size < 4, 15).when(size < 6, 42).when(size <= 80, 87).otherwise(72) / F.lit(100.0)


#: Marks that stand before or after a recognised line.
_EDGE = "| *\t·•-=_,.;:，。；："


def ocr_text(text: Column) -> Column:
    """Lines with white space collapsed and outer marks gone, if two useful signs are left."""
    ended = let(strip(F.coalesce(text, F.lit(""))), lambda t: F.when(F.contains(t, F.lit("\r")), F.regexp_replace(t, r"\r\n?", "\n")).otherwise(t))
    lines = F.split(ended, "\n")
    lines = F.transform(lines, lambda t: F.btrim(collapse(t), F.lit(_EDGE)))
    return F.array_join(F.filter(lines, lambda t: t.rlike(f"(?s){USEFUL}.*?{USEFUL}")), "\n")


def ocr_quality(text: Column, terms: list[str] = ()) -> Column:
    """How far a line of recognised text can be trusted, 0 to 1; terms are looked for as substrings."""
    t = no_space(F.coalesce(text, F.lit("")))
    return let(t, lambda t: let(_line_facts(t, terms), lambda f: _line_score(t, f)))


def _line_facts(t: Column, terms: list[str]) -> Column:
    known = any_of(F.lower(t), [x.lower() for x in terms])
    return F.struct(count(t, CJK).alias("cjk"), count(t, "[A-Za-z]").alias("alpha"), count(t, r"\d").alias("digit"), F.length(t).alias("size"), known.alias("known"))


def _line_score(t: Column, facts: Column) -> Column:
    cjk, alpha, digit, size, known = (facts[k] for k in ("cjk", "alpha", "digit", "size", "known"))
    useful = cjk + alpha + digit
    vowels = count(t, "[aeiouAEIOU]") / F.greatest(alpha, F.lit(1))
    odd_word = F.when((alpha >= 8) & (cjk == 0) & ~known, let(vowels, lambda v: (v < 0.18) | (v > 0.58))).otherwise(False)
    parts = [
        F.when(cjk >= 2, 55).otherwise(0),
        F.when(cjk >= 5, 20).otherwise(0),
        F.when(known, 35).otherwise(0),
        F.when((digit >= 2) & t.rlike(r"[0-9]{2,}-[A-Za-z\x{4e00}-\x{9fff}]"), 18).otherwise(0),
        F.when((alpha >= 4) & (size >= 6), 16).otherwise(0),
        F.when(useful / F.greatest(size, F.lit(1)) < 0.68, -25).otherwise(0),
        F.when(size - useful >= useful, -25).otherwise(0),
        F.when(odd_word, -25).otherwise(0),
        F.when((size <= 3) & (cjk == 0) & ~known, -25).otherwise(0),
    ]
    score = F.greatest(F.lit(0), F.least(F.lit(100), reduce(lambda a, b: a + b, parts))) / F.lit(100.0)
    return F.when(size == 0, F.lit(0.0)).otherwise(score)


def useful_line(text: Column, terms: list[str] = (), least: float = 0.38) -> Column:
    return let(ocr_text(text), lambda t: (t != "") & (ocr_quality(t, terms) >= least))


def document_density(lines: Column) -> Column:
    """Half for signs a line, half for long lines; 0 without lines."""
    return let(F.transform(lines, lambda t: count(t, USEFUL)), _density)


def _density(each: Column) -> Column:
    n = F.size(each)
    mean = F.aggregate(each, F.lit(0), lambda a, c: a + c) / F.greatest(n, F.lit(1))
    score = F.least(mean / 18.0, F.lit(1.0)) * 0.5 + F.least(F.size(F.filter(each, lambda c: c >= 12)) / 5.0, F.lit(1.0)) * 0.5
    return F.when(n > 0, score).otherwise(F.lit(0.0))


def document_score(lines: Column, doc_terms: list[str], ui_terms: list[str]) -> Column:
    """How much a frame's lines look like a document; the word lists are parameters."""
    text = F.array_join(lines, "\n")
    held = lambda terms: how_many_of(text, terms)
    some = lambda p: F.size(F.filter(lines, p))
    paragraphs = some(lambda t: count(t, USEFUL) >= 18)
    heads = some(lambda t: F.startswith(t, F.lit("#")) | t.rlike("^[一二三四五六七八九十]+[、.．]"))
    bullets = some(lambda t: F.startswith(t, F.lit("- ")) | t.rlike(r"^[0-9]+\."))
    up_to = lambda x, top, w: F.least(x / float(top), F.lit(1.0)) * w
    docs = held(doc_terms)
    score = up_to(count(text, CJK), 180, 0.35) + up_to(paragraphs, 6, 0.25) + up_to(heads + bullets, 5, 0.2) + up_to(docs, 3, 0.25) - up_to(held(ui_terms), 3, 0.45)
    score = score - F.when(paragraphs < 2, 0.25).otherwise(0.0) - F.when(docs <= 0, 0.38).otherwise(0.0)
    return F.when(F.size(lines) > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).otherwise(F.lit(0.0))


def document_spacing(text: Column) -> Column:
    def spaced(t: Column) -> Column:
        t = F.regexp_replace(t, rf"(?<={CJK})\s+(?={CJK})", "")
        t = F.regexp_replace(t, r"\s+([，。？！：；、）)])", "$1")
        t = F.regexp_replace(t, r"([（(])\s+", "$1")
        return F.regexp_replace(t, r"\s{2,}", " ")

    held = lambda t, *signs: any_of(t, list(signs))
    return strip(let(F.coalesce(text, F.lit("")), lambda t: F.when(ascii_only(t) & ~held(t, "  ", "(", ")"), t).otherwise(spaced(t))))


def looks_like_html(text: Column) -> Column:
    t = F.lower(strip(F.coalesce(text, F.lit(""))))
    return F.startswith(t, F.lit("<!doctype html")) | F.startswith(t, F.lit("<html"))


def has_transcript(text: Column, segments: Column) -> Column:
    """Whether a transcript says anything: a text that is no web page, or any segment."""
    t = strip(F.coalesce(text, F.lit("")))
    return ((t != "") & ~looks_like_html(t)) | (F.coalesce(segments, F.lit(0)) > 0)


def clip_note(text: Column, limit: int = 110, pack: RulePack = PLAIN) -> Column:
    cut = lambda t: F.when(F.length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, limit), "[ ，,。；;：:]+$", ""), F.lit("...")))
    return let(collapse(known_terms(text, pack)), cut)


def speech_sentences(text: Column, pack: RulePack = PLAIN) -> Column:
    """Sentences of eight signs or more: cut at line ends, and at white space after a closing mark."""
    parts = F.split(known_terms(text, pack), r"(?U)(?<=[。！？!?；;])\s+|[\r\n]+")
    return F.filter(F.transform(parts, lambda t: strip_of(F.regexp_replace(t, r"(?U)\s+", " "), " ，,。；;：:")), lambda t: F.length(t) >= 8)


def note_sentences(sentences: Column, keywords: list[str], limit: int = 8) -> Column:
    """The first sentences that hold a keyword, whatever the case; one of those that differ in white space or case only."""
    bare = lambda t: F.lower(F.regexp_replace(t, r"(?U)\s+", ""))
    held = F.filter(sentences, lambda t: any_of(F.lower(t), [k.lower() for k in keywords]))
    first = lambda x: F.filter(x["s"], lambda t, i: F.array_position(x["bare"], bare(t)) == i + 1)
    return let(F.struct(held.alias("s"), F.transform(held, bare).alias("bare")), lambda x: F.slice(first(x), 1, limit))


def chunk_title(text: Column, pack: RulePack = PLAIN) -> Column:
    titles = [F.when(reduce(lambda a, b: a & b, [any_of(text, g) for g in groups]), F.lit(title)) for groups, title in pack.chunk_titles]
    return F.coalesce(*titles, F.lit(pack.other_title))


def chunk_summary(text: Column, pack: RulePack = PLAIN) -> Column:
    """What is said of a chunk with its title; without such a title its beginning."""
    t = known_terms(text, pack)
    title = chunk_title(t, pack)
    known = [F.when(title == k, F.lit(v)) for k, v in pack.chunk_summaries.items()]
    return F.coalesce(*known, clip_note(t, 130, pack))


def speech_points(text: Column, pack: RulePack = PLAIN) -> Column:
    """points, methods, tools and cases: arrays of what the words of a whole talk stand for, in order of the rules."""
    none = F.array().cast("array<string>")
    of = lambda kind: [F.when(any_of(text, words), F.lit(point)) for k, words, point in pack.speech_points if k == kind]
    return F.struct(*[(F.array_compact(F.array(*of(k))) if of(k) else none).alias(k) for k in ("points", "methods", "tools", "cases")])


# --- lines of documents --------------------------------------------------------------------------------------


def document_line(text: Column, pack: RulePack = PLAIN) -> Column:
    """Whether a recognised line belongs to a document: not refused, four useful signs, good enough."""
    refused = lambda t: reduce(lambda a, b: a | b, [t.rlike(p) for p in pack.refused_lines], F.lit(False))
    good = lambda t: (t != "") & ~refused(t) & (count(t, USEFUL) >= 4) & (ocr_quality(t, pack.useful_terms) >= 0.36)
    return let(ocr_text(common_terms(text, pack)), good)


def markdown_line(text: Column, pack: RulePack = PLAIN) -> Column:
    """A document's line as Markdown: an item, a numbered item, a heading, or as it is."""
    t = collapse(known_terms(common_terms(ocr_text(text), pack), pack))
    t = replaced(t, pack.line_repairs)
    closed = lambda t: F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"(?U)\s+([，。？！：；、])", "$1"), r"(?U)([（(])\s+", "$1"), r"(?U)\s+([）)])", "$1")
    t = let(t, lambda t: F.when(ascii_only(t) & ~F.contains(t, F.lit("(")) & ~F.contains(t, F.lit(")")), t).otherwise(closed(t)))
    return let(t, lambda t: _as_markdown(t, pack))


def _as_markdown(t: Column, pack: RulePack) -> Column:
    part = lambda p, i: F.regexp_extract(t, p, i)
    item, numbered, chapter = r"(?U)^[•·\-*]\s*(.+)", r"(?U)^(\d+)[.、]\s*(.+)", r"(?U)^[一二三四五六七八九十]+[、.．]\s*"
    short = (F.length(t) <= 34) & (F.endswith(t, F.lit("：")) | F.endswith(t, F.lit(":")) | (t.rlike("(?i)" + pack.heading_end) if pack.heading_end else F.lit(False)))
    title = strip(F.regexp_replace(t, chapter, ""))
    return (
        F.when(t.rlike(item), F.concat(F.lit("- "), strip(part(item, 1))))
        .when(t.rlike(numbered), F.concat(part(numbered, 1), F.lit(". "), strip(part(numbered, 2))))
        .when(t.rlike(chapter), F.when(title != "", F.concat(F.lit("## "), title)).otherwise(""))
        .when(t.rlike("^第[一二三四五六七八九十0-9]+层[:：]"), F.concat(F.lit("### "), t))
        .when(short, F.concat(F.lit("### "), F.regexp_replace(t, "[:：]+$", "")))
        .otherwise(t)
    )


def document_candidate(lines: Column, score: Column, least: float = 0.48, pack: RulePack = PLAIN) -> Column:
    """Whether a frame's lines are a document: score and density high enough, few short lines, few controls."""
    few = F.size(F.filter(lines, lambda t: count(t, USEFUL) < 8))
    held = how_many_of(F.lower(F.array_join(lines, "\n")), [w.lower() for w in pack.frame_control_terms])
    good = lambda d: (score >= least) & (d >= 0.34) & (few < F.greatest(F.lit(5.0), F.size(lines) * 0.7)) & ~((held >= 3) & (d < 0.55))
    return F.coalesce((F.size(lines) > 0) & let(document_density(lines), good), F.lit(False))


def document_fragment(line: Column, pack: RulePack = PLAIN) -> Column:
    """A document's line, spaced and repaired; broken fragments become empty."""
    broken = lambda t: reduce(lambda a, b: a | b, [t.rlike("(?iU)" + p) for p in pack.broken_fragments], F.lit(False))
    return let(document_spacing(line), lambda t: F.when(broken(t), "").otherwise(document_spacing(replaced(t, pack.fragment_repairs))))


def document_polish(markdown: Column, pack: RulePack = PLAIN) -> Column:
    """A document's Markdown, repaired, with an empty line before each heading and never two."""
    t = reduce(lambda t, p: F.regexp_replace(t, "(?imU)" + p[0], p[1]), pack.document_repairs, F.coalesce(markdown, F.lit("")))
    t = F.regexp_replace(t, "([^\n])\n## ", "$1\n\n## ")
    return strip(F.regexp_replace(t, "\n{3,}", "\n\n"))


# --- navigation and languages --------------------------------------------------------------------------------


def nav_label(text: Column, readings: list[tuple[str, str]] = rules.NAV_READINGS) -> Column:
    """The label that a reading stands for: the first rule whose sign run is held decides; else the reading itself."""
    t = F.replace(title_text(text), F.lit(" "), F.lit(""))
    return let(t, lambda t: F.coalesce(*[F.when(F.contains(t, F.lit(k)), F.lit(v)) for k, v in readings], t))


def ocr_languages(available: Column, wanted: str = "chi_sim+eng") -> Column:
    """Wanted languages that are available, in the order wanted; else eng if that is; else as wanted."""
    usable = F.array_intersect(F.array(*[F.lit(x) for x in wanted.split("+") if x]), available)
    return F.when(F.size(usable) > 0, F.array_join(usable, "+")).when(F.array_contains(available, "eng"), "eng").otherwise(wanted)


def timestamp_label(seconds: Column) -> Column:
    """MM:SS, or HH:MM:SS from an hour on; seconds rounded half to even, never below 0."""
    s = F.greatest(F.lit(0), F.rint(F.coalesce(seconds, F.lit(0.0)))).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    h, m, r = F.floor(s / 3600), F.pmod(F.floor(s / 60), F.lit(60)), F.pmod(s, F.lit(60))
    short = F.concat(two(m), F.lit(":"), two(r))
    full = F.concat(F.when(h < 100, two(h)).otherwise(h.cast("string")), F.lit(":"), short)
    return F.when(h > 0, full).otherwise(short)


# --- sources -------------------------------------------------------------------------------------------------


def first_url(text: Column) -> Column:
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"https?://[^\s，。！？；、）)>\]\"']+", 0)
    return F.regexp_replace(found, r"[.,;:!?，。！？；、]+$", "")


def is_url(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"^[\x00-\x20]*(?i:https?)://[^/?#]+")


def source_input(text: Column) -> Column:
    url = first_url(text)
    return F.when(is_url(text), text).when(url != "", url).otherwise(text)


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)


def page_video_url(url: Column) -> Column:
    """The canonical address of a video shown over a feed page; any other address as it is."""
    modal = F.regexp_extract(url, r"[?&]modal_id=\s*([^&#\s]+)", 1)
    feed = F.endswith(url_host(url), F.lit("douyin.com")) & (F.regexp_replace(url_path(url), "/+$", "") == "/jingxuan")
    return F.when(feed & (modal != ""), F.concat(F.lit("https://www.douyin.com/video/"), modal)).otherwise(url)


def media_suffix(url: Column, content_type: Column) -> Column:
    suffix = F.lower(F.regexp_extract(url_path(url), r"[^/.](\.[^./]+)$", 1))
    kind = F.lower(strip(F.split(F.coalesce(content_type, F.lit("")), ";")[0]))
    types = F.create_map(*[F.lit(x) for kv in rules.MEDIA_TYPES.items() for x in kv])
    return F.when(suffix.isin(rules.SUFFIXES), suffix).otherwise(F.coalesce(F.element_at(types, kind), F.lit(".mp4")))


def short_url(url: Column, hosts: list[str] = rules.SHORT_HOSTS) -> Column:
    """Whether an address is a shortened one that a fetcher must follow."""
    return reduce(lambda a, b: a | b, [F.endswith(url_host(url), F.lit(h)) for h in hosts])


def direct_media(content_type: Column) -> Column:
    """Whether an answer of this type can be a media file: not a web page."""
    return ~F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("text/html"))


def cookie_browsers(choice: Column, auto: Column) -> Column:
    """Browsers to take cookies from, in order: the one chosen, all of them, or none (an empty name)."""
    every = F.array(*map(F.lit, rules.BROWSERS))
    c = F.coalesce(choice, F.lit(""))
    return F.when((F.lower(c) == "auto") | ((c == "") & F.coalesce(auto, F.lit(False))), every).otherwise(F.array(c))


def download_help(source: Column, url: Column, error: Column) -> Column:
    """Tips after a failed download, a line each."""
    low, host = F.lower(F.coalesce(error, F.lit(""))), url_host(F.coalesce(F.nullif(url, F.lit("")), source))
    tips = [F.when(url != source, F.concat(F.lit(rules.REWRITTEN_TIP), url)), F.when(any_of(host, rules.SHORT_VIDEO_SITES), rules.SITE_TIP)]
    tips += [F.when(F.contains(low, F.lit(w)), F.lit(tip)) for w, tip in rules.ERROR_TIPS]
    found = F.array_compact(F.array(*tips))
    line = lambda t: F.concat(F.lit("- "), t)
    return F.array_join(F.transform(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(rules.OTHER_TIP))), line), "\n")


def recommended_path(key: Column, sdk: Column, decoder: Column, prober: Column, vision: Column, speech: Column) -> Column:
    """The way of analysis that the tools at hand allow."""
    return (
        F.when(key & sdk & decoder & prober, "openai-hybrid")
        .when(key & sdk, "native-openai-or-hybrid")
        .when(decoder & (vision | speech), "timeline-pipeline")
        .when(decoder, "transcript-and-frame-pipeline-with-external-tools")
        .otherwise("dependency-blocked")
    )
