"""Frame layout: differences, steady navigation, and the change filter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenreel.functions import rules
from lumenreel.functions import text as T


def pixel_diff(a: Column, b: Column) -> Column:
    """Mean difference of the common front, as a share of 255; values are cut to whole numbers first."""
    n = F.least(F.size(a), F.size(b))
    cut = lambda x: F.slice(x, 1, F.greatest(n, F.lit(1)))
    gaps = F.zip_with(cut(a), cut(b), lambda x, y: F.abs(x.cast("int") - y.cast("int")))
    return F.when(n > 0, F.aggregate(gaps, F.lit(0).cast("long"), lambda s, g: s + g) / (n * 255.0)).otherwise(F.lit(0.0))


def difference(a: Column, b: Column) -> Column:
    """All differences of two signatures and their weighted sum."""
    grid, edge = pixel_diff(a["grid"], b["grid"]), pixel_diff(a["edge_grid"], b["edge_grid"])
    light, strength = F.abs(a["brightness_mean"] - b["brightness_mean"]), F.abs(a["edge_strength"] - b["edge_strength"])
    total = grid * 0.5 + edge * 0.3 + light * 0.1 + strength * 0.1
    return F.struct(grid.alias("grid_diff"), edge.alias("edge_diff"), pixel_diff(a["row_profile"], b["row_profile"]).alias("row_profile_diff"), pixel_diff(a["col_profile"], b["col_profile"]).alias("col_profile_diff"), light.alias("brightness_diff"), strength.alias("edge_strength_diff"), total.alias("combined_score"))


def transition_like(s: Column) -> Column:
    return (s["dark_ratio"] >= 0.92) | ((s["brightness_mean"] <= 0.08) & (s["edge_strength"] <= 0.035)) | ((s["bright_ratio"] >= 0.97) & (s["edge_strength"] <= 0.02))


def steady_nav(frames: DataFrame, video: str = "video_id", order: str = "ts") -> DataFrame:
    """frames (nav_present, active_index, confidence) with context_index: the frame's own active label if sure
    enough, else that of one of two frames before or after that is surer, else -1. One window sort."""
    w = Window.partitionBy(video).orderBy(order)
    usable = F.col("nav_present") & (F.col("active_index") >= 0)
    sure = lambda c: F.when(usable & (F.col("confidence") >= c), F.col("active_index"))
    marked = frames.withColumns({"__own": sure(0.55), "__before": sure(0.75), "__after": sure(0.85)})
    tries = [F.col("__own"), *(F.lag("__before", k).over(w) for k in (1, 2)), *(F.lead("__after", k).over(w) for k in (1, 2)), F.lit(-1)]
    return marked.withColumn("context_index", F.coalesce(*tries)).drop("__own", "__before", "__after")


def template_like(d: Column, edge_gap: Column, limits: dict = rules.SAME_CHAPTER) -> Column:
    """Whether a difference is one inside a template: small in all, in its profiles and its edges, but local."""
    structure = F.greatest(d["row_profile_diff"], d["col_profile_diff"])
    local = F.greatest(F.lit(0.0), d["grid_diff"] - structure)
    return (d["combined_score"] <= limits["combined"]) & (structure <= limits["structure"]) & (edge_gap <= limits["edge"]) & (local >= limits["localized"])


def nav_matches(present_a: Column, index_a: Column, present_b: Column, index_b: Column) -> Column:
    """Whether two frames stand under one navigation label."""
    return F.coalesce(present_a & present_b & (index_a >= 0) & (index_b >= 0) & (index_a == index_b), F.lit(False))


def titles_match(clear_a: Column, block_a: Column, clear_b: Column, block_b: Column, difference: Column) -> Column:
    """Whether two frames have one title: a small difference where both are clear blocks, else that neither is clear."""
    return F.when(clear_a & block_a & clear_b & block_b, difference < 0.18).otherwise(~clear_a & ~clear_b)


def thresholds(layout: float = rules.LAYOUT_THRESHOLD) -> dict[str, float]:
    """From which difference on a title, a navigation label or a presenter counts."""
    return {"title": max(layout - 0.045, layout * 0.72), "nav": max(layout - 0.04, layout * 0.7), "presenter": max(layout - 0.05, layout * 0.68)}


def _gap(a: np.ndarray, b: np.ndarray) -> float:
    n = min(len(a), len(b))
    return float(np.abs(a[:n] - b[:n]).sum()) / (n * 255.0) if n else 0.0


def _verdict(last, row, title_gap: float, on: dict) -> tuple:
    """(keep_reason, differences) of a frame against the last one kept; rules in order, the first that holds decides."""
    theta, support = on["layout"], on["support"]
    grid, edge, across, down = (_gap(last[k], row[k]) for k in ("grid", "edge_grid", "row_profile", "col_profile"))
    structure = max(across, down)
    light, strength = abs(last["brightness_mean"] - row["brightness_mean"]), abs(last["edge_strength"] - row["edge_strength"])
    score = 0.5 * grid + 0.3 * edge + 0.1 * light + 0.1 * strength
    strong = score >= theta
    title_near, nav_near, face_near = (score >= support[k] for k in ("title", "nav", "presenter"))
    titles = last["title_meaningful"] and row["title_meaningful"] and last["title_block_like"] and row["title_block_like"]
    navs = last["nav_present"] and row["nav_present"]
    by_title = on["title"] and not strong and title_near and titles and title_gap >= on["title_gap"]
    by_nav = on["nav"] and not strong and nav_near and navs and min(last["active_index"], row["active_index"]) >= 0 and last["active_index"] != row["active_index"] and min(last["nav_confidence"], row["nav_confidence"]) >= 0.55
    face = on["presenter"] and row["presenter_like"] and row["presenter_confidence"] >= 0.7 and not by_nav and not by_title and (face_near or strong)
    same = rules.SAME_CHAPTER
    same_title = title_gap < 0.18 if titles else not last["title_meaningful"] and not row["title_meaningful"]
    twin = (
        abs(row["ts"] - last["ts"]) <= same["gap"] and last["context_index"] >= 0 and last["context_index"] == row["context_index"] and same_title
        and score <= same["combined"] and structure <= same["structure"] and strength <= same["edge"] and max(0.0, grid - structure) >= same["localized"]
        and not row["transition_like"] and not row["presenter_like"]
    )
    reasons = [
        (row["transition_like"], "dropped-transition-like"),
        (on["dedupe"] and strong and twin and not by_nav and not by_title, "dropped-same-chapter-near-duplicate"),
        (face, "dropped-presenter-shot"),
        (strong, "kept-layout-strong"),
        (by_title, "kept-layout-borderline-title-gated"),
        (by_nav, "kept-layout-borderline-nav-gated"),
        (on["title"] and title_near and not titles, "dropped-title-low-quality"),
        (on["nav"] and nav_near and navs, "dropped-nav-unchanged"),
        (on["title"] and title_near, "dropped-title-unchanged"),
        (True, "dropped-layout-weak"),
    ]
    return next(r for hit, r in reasons if hit), (grid, edge, across, down, light, strength, score)


_READ = ["ts", "grid", "edge_grid", "row_profile", "col_profile", "brightness_mean", "edge_strength", "transition_like", "title_meaningful", "title_block_like", "title_tokens", "title_meaning", "nav_present", "active_index", "nav_confidence", "context_index", "presenter_like", "presenter_confidence"]
_DIFFS = ["grid_diff", "edge_diff", "row_profile_diff", "col_profile_diff", "brightness_diff", "edge_strength_diff", "combined_score"]


_ARRAYS = ("grid", "edge_grid", "row_profile", "col_profile")


def rules_on(layout: float, title_gap: float, title: bool, nav: bool, presenter: bool, dedupe: bool) -> dict:
    return {"layout": layout, "support": thresholds(layout), "title_gap": title_gap, "title": title, "nav": nav, "presenter": presenter, "dedupe": dedupe}


def frame_of(values) -> dict:
    """A frame from the values of its columns in the order of _READ; its arrays as whole numbers."""
    row = dict(zip(_READ, values))
    for k in _ARRAYS:
        row[k] = np.asarray(row[k], float).astype(np.int64)
    return row


def judged(last: dict, row: dict, on: dict) -> tuple:
    """(keep_reason, kept, title_difference, differences) of a frame against the one kept last."""
    from lumenreel.operators.dedupe import title_difference

    gap = title_difference(_Titles(last), _Titles(row)) if on["title"] and last["title_meaningful"] and row["title_meaningful"] else 0.0
    reason, diffs = _verdict(last, row, gap, on)
    return reason, reason.startswith("kept"), gap, *diffs


def change_filter(frames: DataFrame, video: str = "video_id", layout: float = rules.LAYOUT_THRESHOLD, title_gap: float = rules.TITLE_THRESHOLD, title: bool = False, nav: bool = False, presenter: bool = False, dedupe: bool = False) -> DataFrame:
    """(video, ts, last_ts, keep_reason, kept, title_difference and the parts of the difference): each frame against the
    last one kept, whose time is last_ts.

    The first and last frame stay; a video of at most two frames stays whole. What does not depend on the
    frame kept last (signals, steady navigation, transitions, which frame is the last) comes as columns made
    before. The fold streams over partitions sorted by video and time; its state is one frame.
    """
    on = rules_on(layout, title_gap, title, nav, presenter, dedupe)
    final = F.lead("ts").over(Window.partitionBy(video).orderBy("ts")).isNull()
    ready = frames.select(video, *_READ).withColumn("__final", final).repartition(video).sortWithinPartitions(video, "ts")

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last = None, None
        for pdf in parts:
            out = []
            for values in zip(*(pdf[c] for c in (video, "__final", *_READ))):
                row, end = frame_of(values[2:]), values[1]
                if last is None or values[0] != now:
                    now, last, end = values[0], None, True
                if end:
                    out.append((now, row["ts"], last and last["ts"], "kept-anchor", True, 0.0, *[0.0] * 7))
                else:
                    out.append((now, row["ts"], last["ts"], *judged(last, row, on)))
                if out[-1][4]:
                    last = row
            yield pd.DataFrame(out, columns=[video, "ts", "last_ts", "keep_reason", "kept", "title_difference", *_DIFFS])

    kind = frames.schema[video].dataType.simpleString()
    return ready.mapInPandas(fold, f"{video} {kind}, ts double, last_ts double, keep_reason string, kept boolean, title_difference double, " + ", ".join(f"{c} double" for c in _DIFFS))


class _Titles:
    def __init__(self, row: dict):
        self.title_tokens, self.title_meaning = row["title_tokens"], row["title_meaning"]


#: Signals of a frame that a diagnostic repeats, and of the frame kept last.
_SHOWN = ["title_text", "title_meaning", "title_quality", "title_meaningful", "title_block_like", "left_ratio", "top_ratio", "width_ratio", "height_ratio", "nav_present", "detected_labels", "active_label", "active_index", "nav_confidence", "context_label", "context_index", "context_confidence", "presenter_like", "presenter_confidence", "skin_ratio", "center_dark_ratio", "full_dark_ratio", "transition_like", "edge_strength"]
_SHOWN_BEFORE = ["title_text", "title_meaning", "title_quality", "title_meaningful", "title_block_like", "active_label", "active_index", "nav_confidence", "context_label", "context_index", "context_confidence"]


def diagnostics(frames: DataFrame, verdicts: DataFrame, video: str = "video_id", layout: float = rules.LAYOUT_THRESHOLD, title_gap: float = rules.TITLE_THRESHOLD, title: bool = False, nav: bool = False, dedupe: bool = False) -> DataFrame:
    """A wide row for each frame that was compared: differences, signals of the frame and (previous_) of the one kept last,
    and why it was kept or not. Signals that frames lack are left out. Two equi-joins by (video, ts)."""
    have = [c for c in _SHOWN if c in frames.columns]
    before = [c for c in _SHOWN_BEFORE if c in frames.columns]
    own = frames.select(video, "ts", *have)
    old = frames.select(video, F.col("ts").alias("last_ts"), *[F.col(c).alias(f"previous_{c}") for c in before], *[F.col(c).alias(f"__{c}") for c in ("nav_present", "edge_strength")])
    d = verdicts.where("keep_reason != 'kept-anchor'").join(own, [video, "ts"]).join(old, [video, "last_ts"])
    near = thresholds(layout)
    score, strong = F.col("combined_score"), F.col("combined_score") >= layout
    clear = F.col("title_meaningful") & F.col("title_block_like") & F.col("previous_title_meaningful") & F.col("previous_title_block_like")
    both = F.col("nav_present") & F.col("__nav_present")
    by_title = F.lit(title) & ~strong & (score >= near["title"]) & clear & (F.col("title_difference") >= title_gap)
    sure = (F.col("nav_confidence") >= 0.55) & (F.col("previous_nav_confidence") >= 0.55)
    by_nav = F.lit(nav) & ~strong & (score >= near["nav"]) & both & (F.col("active_index") >= 0) & (F.col("previous_active_index") >= 0) & (F.col("active_index") != F.col("previous_active_index")) & sure
    edge_gap = F.abs(F.col("edge_strength") - F.col("__edge_strength"))
    structure = F.greatest("row_profile_diff", "col_profile_diff")
    time_gap = F.abs(F.col("ts") - F.col("last_ts"))
    same_nav = nav_matches(F.lit(True), F.col("previous_context_index"), F.lit(True), F.col("context_index"))
    same_title = titles_match(F.col("previous_title_meaningful"), F.col("previous_title_block_like"), F.col("title_meaningful"), F.col("title_block_like"), F.col("title_difference"))
    template = template_like(F.struct("row_profile_diff", "col_profile_diff", "grid_diff", "combined_score"), edge_gap)
    twin = F.lit(dedupe) & strong & (time_gap <= rules.SAME_CHAPTER["gap"]) & same_nav & same_title & template & ~F.col("transition_like") & ~F.col("presenter_like")
    out = d.withColumns({
        "layout_strong": strong, "layout_borderline": score >= near["title"], "title_supports_change": by_title, "nav_supports_change": by_nav, "same_chapter_duplicate": twin,
        "time_gap": F.round(time_gap, 4), "same_nav_context": same_nav, "same_title_context": same_title, "structure_diff": F.round(structure, 4),
        "localized_delta": F.round(F.greatest(F.lit(0.0), F.col("grid_diff") - structure), 4), "edge_profile_gap": F.round(edge_gap, 4), "same_template": template,
    })
    return out.drop("__nav_present", "__edge_strength", "edge_strength").withColumns({c: F.round(c, 4) for c in ("title_difference", *_DIFFS)})


# --- signals from recognised words ---------------------------------------------------------------------------

EMPTY_TITLE = "struct<text:string,left_ratio:double,top_ratio:double,width_ratio:double,height_ratio:double,title_block_like:boolean,candidate_score:double>"


def empty_title() -> Column:
    """No title block: its left and top lie at the far ends."""
    return F.struct(F.lit("").alias("text"), F.lit(1.0).alias("left_ratio"), F.lit(1.0).alias("top_ratio"), F.lit(0.0).alias("width_ratio"), F.lit(0.0).alias("height_ratio"), F.lit(False).alias("title_block_like"), F.lit(0.0).alias("candidate_score"))


def empty_nav() -> Column:
    none = F.array().cast("array<string>")
    return F.struct(none.alias("labels"), none.alias("detected_labels"), F.lit(-1).alias("active_index"), F.lit("").alias("active_label"), F.lit(0.0).alias("confidence"), F.lit(False).alias("nav_present"))


def empty_presenter() -> Column:
    return F.struct(F.lit(False).alias("presenter_like"), *[F.lit(0.0).alias(c) for c in ("skin_ratio", "center_dark_ratio", "full_dark_ratio", "upper_dark_ratio", "center_brightness", "confidence")])


def presenter_signal(skin: Column, center_dark: Column, full_dark: Column, upper_dark: Column, brightness: Column) -> Column:
    """Whether a frame shows a presenter, from shares of its pixels."""
    like = (skin >= 0.18) & (center_dark >= 0.35) & (full_dark >= 0.55) & (upper_dark >= 0.55) & (brightness <= 120)
    sure = F.when(like, F.least(F.lit(1.0), 0.45 + skin * 1.2 + center_dark * 0.35 + full_dark * 0.2)).otherwise(0.0)
    named = {"skin_ratio": skin, "center_dark_ratio": center_dark, "full_dark_ratio": full_dark, "upper_dark_ratio": upper_dark}
    return F.struct(like.alias("presenter_like"), *[F.round(v, 4).alias(k) for k, v in named.items()], F.round(brightness, 2).alias("center_brightness"), F.round(sure, 4).alias("confidence"))


def nav_signals(words: DataFrame, bands: DataFrame, labels: list[str] = rules.NAV_LABELS, centers: list[float] = rules.NAV_CENTERS, readings: list[tuple[str, str]] = rules.NAV_READINGS, video: str = "video_id") -> DataFrame:
    """(video, frame_idx, nav) of bands (width, brightness, segment_means), one a frame: which labels the band's words (pos,
    text, conf, left, width) show, and the active one, whose segment is darkest. Three labels make a navigation; a dark
    band has none. Of several readings of a label the one that is sure and near its place counts, the first of equal ones."""
    at = F.create_map(*[F.lit(x) for kv in zip(labels, centers) for x in kv])
    hits = words.where("conf >= 0").withColumn("label", T.nav_label(F.col("text"), readings)).where(F.col("label").isin(labels) & (T.strip(F.coalesce("text", F.lit(""))) != ""))
    hits = hits.join(bands.select(video, "frame_idx", F.col("width").alias("__wide")), [video, "frame_idx"])
    middle = (F.col("left") + F.col("width") / 2) / F.greatest("__wide", F.lit(1))
    score = F.col("conf") - F.abs(middle - F.element_at(at, F.col("label"))) * 220
    best = hits.groupBy(video, "frame_idx", "label").agg(F.max_by(score, F.struct(score, -F.col("pos"))).alias("score"))
    seen = best.groupBy(video, "frame_idx").agg(F.collect_set("label").alias("seen"))
    every = F.array(*map(F.lit, labels))
    found = F.array_intersect(every, F.coalesce("seen", F.array().cast("array<string>")))
    means = F.col("segment_means")
    dark = F.array_position(means, F.array_min(means)).cast("int")
    sure = F.round(F.least(F.lit(1.0), 0.45 + (F.array_max(means) - F.array_min(means)) / 90.0), 4)
    full = F.struct(every.alias("labels"), found.alias("detected_labels"), (dark - 1).alias("active_index"), F.element_at(every, dark).alias("active_label"), sure.alias("confidence"), F.lit(True).alias("nav_present"))
    few = F.struct(found.alias("labels"), found.alias("detected_labels"), F.lit(-1).alias("active_index"), F.lit("").alias("active_label"), F.lit(0.0).alias("confidence"), F.lit(False).alias("nav_present"))
    rows = bands.join(seen, [video, "frame_idx"], "left")
    return rows.select(video, "frame_idx", F.when(F.col("brightness") < 45, empty_nav()).when(F.size(found) >= 3, full).otherwise(few).alias("nav"))


_BOX = ["top", "left", "width", "height", "text", "conf", "score"]
_BOXES = pa.list_(pa.struct([*[(c, pa.int32()) for c in _BOX[:4]], ("text", pa.string()), ("conf", pa.float64()), ("score", pa.float64())]))


def merged_boxes(boxes: DataFrame, video: str = "video_id") -> DataFrame:
    """(video, frame_idx, w, h, blocks): boxes (w, h, pos and _BOX) of each frame in order, those that stand below each other at
    one left edge put together. If boxes have alone, their worth as a block of one, only the best of a frame's blocks of one
    stays, the first of equal ones, with all blocks of several.

    A fold over partitions sorted by frame and place; it holds the boxes of the frame at hand."""
    order = [video, "frame_idx", "w", "h", "top", "left", "pos"]
    sized = boxes.withColumns({c: F.col(c).cast("int") for c in _BOX[:4]})
    alone = ["alone"] if "alone" in boxes.columns else []
    dealt = sized.select(*order, "width", "height", "text", "conf", "score", *alone).repartition(video, "frame_idx").sortWithinPartitions(*order)
    kind = boxes.schema[video].dataType.simpleString()
    kinds = ", ".join(f"{c} {t}" for c, t in [("frame_idx", "int"), ("w", "int"), ("h", "int")])
    spec = ", ".join(f"{c}:{t}" for c, t in zip(_BOX, ["int"] * 4 + ["string", "double", "double"]))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            if not b.num_rows:
                continue
            before = held[-1].slice(held[-1].num_rows - 1) if held else b.slice(0, 0)
            starts = np.flatnonzero(_frame_starts(pa.Table.from_batches([before, b]))[before.num_rows :])
            if held and not len(starts):
                held.append(b)
                continue
            held.append(b.slice(0, starts[-1]))
            if sum(x.num_rows for x in held):
                yield _blocks_of_frames(pa.Table.from_batches(held), video)
            held = [b.slice(starts[-1])]
        if held:
            yield _blocks_of_frames(pa.Table.from_batches(held), video)

    typed = dealt.withColumns({c: F.col(c).cast("int") for c in ("frame_idx", "w", "h")}).drop("pos")
    return typed.mapInArrow(fold, f"{video} {kind}, {kinds}, blocks array<struct<{spec}>>")


def _frame_starts(t: pa.Table) -> np.ndarray:
    """Which rows begin a frame: their first four columns differ from those of the row before."""
    new = np.ones(t.num_rows, bool)
    if t.num_rows > 1:
        new[1:] = False
        for c in t.columns[:4]:
            a, b = c.slice(0, t.num_rows - 1), c.slice(1)
            new[1:] |= pc.fill_null(pc.not_equal(a, b), False).to_numpy() | (pc.is_null(a).to_numpy() != pc.is_null(b).to_numpy())
    return new


def _blocks_of_frames(t: pa.Table, video: str) -> pa.RecordBatch:
    """Whole frames with their blocks. A box too far right of the one before begins a block, whatever that one belongs to; one
    after a box that begins a block is compared with that box; only what is left is walked box by box."""
    t = t.combine_chunks()
    first = _frame_starts(t)
    left, top, height, wide = (t[c].cast(pa.float64()).to_numpy() for c in ("left", "top", "height", "w"))
    near = np.maximum(28, np.trunc(wide * 0.06))
    begins = first.copy()
    begins[1:] |= ~(left[1:] <= left[:-1] + near[1:])
    for _ in range(2):
        i = np.flatnonzero(~begins)
        i = i[begins[i - 1]]
        joins = (np.abs(left[i] - left[i - 1]) <= near[i]) & (top[i] - (top[i - 1] + height[i - 1]) <= np.maximum(18, np.trunc(height[i - 1] * 0.7)))
        begins[i[~joins]] = True
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], t.num_rows)
    single, many = ends - starts == 1, []
    lone = [starts[single]]
    runs = list(zip(starts[~single].tolist(), ends[~single].tolist()))
    if runs:
        rows = np.flatnonzero(np.repeat(~single, ends - starts))
        boxes = zip(rows.tolist(), near[rows].tolist(), *(t[c].take(pa.array(rows)).to_pylist() for c in _BOX))
        for s, e in runs:
            at, _, *c = next(boxes)
            c[4] = [c[4]]
            for _ in range(e - s - 1):
                row, reach, y, x, width, high, text, conf, score = next(boxes)
                if x is not None and c[1] is not None and abs(x - c[1]) <= reach and y - (c[0] + c[3]) <= max(18, int(c[3] * 0.7)):
                    right, bottom = max(c[1] + c[2], x + width), max(c[0] + c[3], y + high)
                    c[0], c[1] = min(c[0], y), min(c[1], x)
                    c[2], c[3], c[5], c[6] = right - c[1], bottom - c[0], max(c[5], conf), max(c[6], score)
                    c[4].append(text)
                    continue
                many.append((at, c))
                at, c = row, [y, x, width, high, [text], conf, score]
            many.append((at, c))
        lone.append(np.array([at for at, c in many if len(c[4]) == 1], np.int64))
        many = [(at, c) for at, c in many if len(c[4]) > 1]
    lone, frame = np.sort(np.concatenate(lone)), np.cumsum(first) - 1
    if "alone" in t.column_names and len(lone):
        worth, of = t["alone"].to_numpy()[lone], frame[lone]
        heads = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        most = np.repeat(np.maximum.reduceat(worth, heads), np.diff(np.append(heads, len(of))))
        best = np.flatnonzero(worth == most)
        lone = lone[best[np.append(True, of[best][1:] != of[best][:-1])]]
    at = np.concatenate([lone, np.array([a for a, _ in many], np.int64)])
    place = np.argsort(at, kind="stable")
    cols = list(zip(*[c for _, c in many])) or [[]] * len(_BOX)
    cols[4] = [" ".join(x) for x in cols[4]]
    fields = [pa.concat_arrays([_one(t[f.name].take(pa.array(lone)).cast(f.type)), pa.array(x, f.type)]).take(pa.array(place)) for x, f in zip(cols, _BOXES.value_type)]
    fields[4] = pc.utf8_trim(fields[4], " ")
    offsets = np.append(0, np.cumsum(np.bincount(frame[at], minlength=int(first.sum()))))
    blocks = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(_BOXES.value_type)))
    names = [video, "frame_idx", "w", "h"]
    return pa.RecordBatch.from_arrays([*[_one(t[c].take(pa.array(np.flatnonzero(first)))) for c in names], blocks], names=[*names, "blocks"])


def _one(x: pa.ChunkedArray) -> pa.Array:
    x = x.combine_chunks()
    return pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x


def _title_words(words: DataFrame) -> DataFrame:
    """words with their title text, those that have one, and its quality and kinds (meaningful tokens) as `T.title_signal` has
    them. Steps are columns of their own, so that each is worked out once and in generated code; only a text with signs other
    than letters and spaces goes through all rules."""
    raw, text, size = F.col("text"), F.col("text"), F.length("text")
    rows = words.withColumn("__letters", F.coalesce(raw.rlike(T.LETTERS), F.lit(False)))
    rows = rows.withColumn("__low", F.when(F.col("__letters"), F.lower(raw)).otherwise(F.lower(T.strip(F.coalesce(raw, F.lit(""))))))
    rows = rows.withColumn("text", T.title_text_of(F.col("__low"), F.col("__letters"))).drop("__low").withColumn("text", T.once(text)).where(text != "")
    rows = rows.withColumn("__kind", F.when(F.col("__letters"), 1).when(~text.rlike("^[a-z ]+$"), 3).when(F.contains(text, F.lit(" ")), 2).otherwise(1))
    one, several = F.col("__kind") == 1, F.col("__kind") == 2
    rows = rows.withColumns({"__ruled": F.when(F.col("__kind") == 3, T.title_signal(text)), "__long": F.when(several, T.long_tokens(text))})
    rows = rows.withColumns({"__n": F.when(several, T.token_count(text)), "__held": F.when(several, T.token_count(F.col("__long"))), "__kinds": F.when(several, T.token_kinds(F.col("__long")))})
    rows = rows.withColumn("__mean", F.when(F.col("__held") > 0, (F.length("__long") - F.col("__held") + 1) / F.col("__held")).otherwise(F.lit(0.0)))
    quality = T.plain_quality(size, *[F.col(c) for c in ("__n", "__held", "__kinds", "__mean")])
    rows = rows.withColumns({
        "quality": F.when(one, T.word_quality(size)).when(several, quality).otherwise(F.col("__ruled.quality_score")),
        "kinds": F.when(one, (size >= 3).cast("int")).when(several, F.col("__kinds")).otherwise(F.col("__ruled.meaningful_token_count")),
    })
    return rows.drop("__letters", "__kind", "__ruled", "__long", "__n", "__held", "__kinds", "__mean")


def title_blocks(words: DataFrame, bands: DataFrame, video: str = "video_id") -> DataFrame:
    """(video, frame_idx, title) of bands (width, height), one a frame: the best block among the words of the title band.

    Words are scored by their text and place, put together to blocks, and blocks scored again; the first of the
    best ones counts, if it is good enough. A word that stays alone has its score as a block at once, so that only the best of
    these is looked at again. Words dealt by (video, frame_idx) are not moved."""
    said = words.where("conf >= 0 and width > 0 and height > 0")
    rows = said.join(bands.select(video, "frame_idx", F.col("width").alias("w"), F.col("height").alias("h")).hint("shuffle_hash"), [video, "frame_idx"]).where(F.col("top") <= (F.col("h") * 0.72).cast("int"))
    rows = _title_words(rows)
    wide, high = F.greatest("w", F.lit(1)), F.greatest("h", F.lit(1))
    rows = rows.withColumns({"wr": F.col("width") / wide, "hr": F.col("height") / high, "lr": F.col("left") / wide, "rr": (F.col("left") + F.col("width")) / wide, "tr": F.col("top") / high})
    c = {k: F.col(k) for k in ("wr", "hr", "lr", "rr", "tr")}
    bonus = (
        F.when(c["tr"] <= 0.26, 0.2).when(c["tr"] <= 0.4, 0.08).otherwise(0.0) + F.when(c["lr"] <= 0.22, 0.12).when(c["lr"] <= 0.4, 0.05).otherwise(0.0)
        - F.when((c["rr"] >= 0.9) & (c["wr"] <= 0.22), 0.18).otherwise(0.0) - F.when(c["wr"] >= 0.55, 0.12).otherwise(0.0)
        - F.when((F.col("kinds") <= 1) & (c["hr"] <= 0.03), 0.15).otherwise(0.0) - F.when(F.col("conf") < 25, 0.1).otherwise(0.0)
    )

    def block_score(score: Column, quality: Column, kinds: Column, wr: Column, hr: Column, lr: Column, tr: Column) -> Column:
        return (
            score + quality * 0.7 + F.least(hr * 1.8, F.lit(0.35)) + F.when(tr <= 0.18, 0.18).when(tr <= 0.3, 0.08).otherwise(0.0)
            + F.when(lr <= 0.18, 0.12).otherwise(0.0) - F.when(wr >= 0.6, 0.2).otherwise(0.0) + F.when(kinds >= 2, 0.08).otherwise(0.0)
        )

    rows = rows.withColumn("score", F.col("quality") + bonus + c["hr"] * 1.2)
    # blocks are of whole pixels
    whole = [F.col(k).cast("int") / of for k, of in (("width", wide), ("height", high), ("left", wide), ("top", high))]
    rows = rows.withColumn("alone", block_score(F.col("score"), F.col("quality"), F.col("kinds"), *whole))
    frames = merged_boxes(rows, video)

    def best(b: Column, place: Column, s: Column) -> Column:
        wr, hr, lr, tr = b["width"] / wide, b["height"] / high, b["left"] / wide, b["top"] / high
        score = block_score(b["score"], s["quality_score"], s["meaningful_token_count"], wr, hr, lr, tr)
        like = (tr <= 0.3) & (lr <= 0.3) & (wr <= 0.42) & (hr >= 0.045)
        title = F.struct(s["normalized_text"].alias("text"), lr.alias("left_ratio"), tr.alias("top_ratio"), wr.alias("width_ratio"), hr.alias("height_ratio"), like.alias("title_block_like"), score.alias("candidate_score"))
        return F.struct(score.alias("score"), (-place).alias("place"), title.alias("title"))

    rated = F.transform("blocks", lambda b, i: T.let(T.title_signal(b["text"]), lambda s: best(b, i, s)))
    best_of = frames.select(video, "frame_idx", F.array_max(rated)["title"].alias("title"))
    found = bands.select(video, "frame_idx").join(best_of, [video, "frame_idx"], "left")
    return found.select(video, "frame_idx", F.when(F.col("title.candidate_score") >= 0.38, F.col("title")).otherwise(empty_title().cast(EMPTY_TITLE)).alias("title"))


def regions(frames: DataFrame, parts: list[tuple] = rules.REGIONS) -> DataFrame:
    """frames (width, height) with a row for each region that text is read from: region_no, region and the box in pixels."""
    cut = lambda size, share: (F.col(size) * share).cast("int")
    each = [F.struct(F.lit(i).alias("region_no"), F.lit(n).alias("region"), cut("width", l).alias("left"), cut("height", t).alias("top"), cut("width", r).alias("right"), cut("height", b).alias("bottom")) for i, (n, l, t, r, b) in enumerate(parts)]
    return frames.withColumn("__r", F.explode(F.array(*each))).select("*", "__r.*").drop("__r")


def difference_score(a: Column, b: Column) -> Column:
    return difference(a, b)["combined_score"]


def signature_columns(grid: Column) -> dict[str, Column]:
    """A 24 x 14 grid's profiles and scalars, for landed grids whose image is gone."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    rows = F.transform(F.sequence(F.lit(0), F.lit(13)), lambda r: total(F.slice(grid, r * 24 + 1, 24)) / 24)
    cols = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda c: total(F.filter(grid, lambda x, i: i % 24 == c)) / 14)
    mean = total(grid) / F.greatest(F.size(grid), F.lit(1)) / 255.0
    share = lambda p: F.size(F.filter(grid, p)) / F.greatest(F.size(grid), F.lit(1))
    return {"row_profile": rows, "col_profile": cols, "brightness_mean": mean, "dark_ratio": share(lambda x: x < 20), "bright_ratio": share(lambda x: x >= 236)}
