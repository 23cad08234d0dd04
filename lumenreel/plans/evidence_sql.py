"""DuckDB SQL for the queries of `evidence`."""

from __future__ import annotations

from lumenreel.functions import rules
from lumenreel.operators import report, speech
from lumenreel.plans.tables import EVENTS, LINES, MOST, SAMPLE, SEGMENTS
from lumenreel.sources import landing

_CJK, _USEFUL = r"[\x{4e00}-\x{9fff}]", r"[0-9A-Za-z\x{4e00}-\x{9fff}]"
_NL = "chr(10)"


def _n(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def _word(t: str, word: str, to: str) -> str:
    """A word replaced whatever its case. \\b of this dialect knows ASCII only, so a mark is put on both sides of each sign
    that is no letter or digit; a word then stands between marks of its own."""
    marked = rf"chr(1) || regexp_replace({t}, '([^\pL\pN_])', chr(1) || '\1' || chr(1), 'g') || chr(1)"
    return f"replace(regexp_replace({marked}, chr(1) || '{word}' || chr(1), chr(1) || '{to}' || chr(1), 'gi'), chr(1), '')"


def _known(t: str) -> str:
    return f"regexp_replace({_word(f"coalesce({t}, '')", 'the', 'THE')}, 'que', 'QUE', 'gi')"


def _common(t: str) -> str:
    return _known(_word(_word(f"coalesce({t}, '')", "der", "DER"), "on", "ON"))


def _clip(t: str, n: int) -> str:
    t = rf"trim(regexp_replace({_known(t)}, '\s+', ' ', 'g'))"
    return f"CASE WHEN length({t}) <= {n} THEN {t} ELSE regexp_replace(substr({t}, 1, {n}), '[ ，,。；;：:]+$', '') || '...' END"


def _title(t: str) -> str:
    return f"CASE WHEN contains({t}, 'THE') AND contains({t}, 'and') THEN 'English talk' WHEN contains({t}, 'QUE') THEN 'Spoken in Spanish' ELSE 'Other talk' END"


def _summary(t: str) -> str:
    return f"CASE WHEN contains({_known(t)}, 'THE') AND contains({_known(t)}, 'and') THEN 'A talk in English.' ELSE {_clip(t, 130)} END"


def _label(x: str) -> str:
    s = f"greatest(0, round_even({x}, 0))::BIGINT"
    return f"CASE WHEN {s} >= 3600 THEN printf('%02d:%02d:%02d', {s} // 3600, {s} // 60 % 60, {s} % 60) ELSE printf('%02d:%02d', {s} // 60, {s} % 60) END"


def _ocr(t: str) -> str:
    cut = rf"regexp_replace(trim(regexp_replace({t}, '\s+', ' ', 'g')), '^[| *\t·•\-=_,.;:，。；：]+|[| *\t·•\-=_,.;:，。；：]+$', '', 'g')"
    return f"CASE WHEN {_n(cut, _USEFUL)} >= 2 THEN {cut} ELSE '' END"


def _spaced(t: str) -> str:
    t = rf"regexp_replace(regexp_replace(coalesce({t}, ''), '\s+([，。？！：；、）)])', '\1', 'g'), '([（(])\s+', '\1', 'g')"
    return rf"trim(regexp_replace({t}, '\s{{2,}}', ' ', 'g'))"


def _word_end(t: str) -> str:
    """tion at the end of a word; one pass, as what is put there ends in a full stop."""
    return rf"regexp_replace({t}, 'tion($|[^\pL\pN_])', 'TION.\1', 'gi')"


def _fragment(t: str) -> str:
    s = _spaced(t)
    return rf"CASE WHEN regexp_matches({s}, '(?i)^r') THEN '' ELSE " + _spaced(_word_end(s)) + " END"


def _ms(x: str) -> str:
    return f"round_even({x} * 1000, 0) / 1000"


def _quality(t: str) -> str:
    """Of a column t without white space; PROSE's terms."""
    cjk, alpha, digit, size = _n(t, _CJK), _n(t, "[A-Za-z]"), _n(t, "[0-9]"), f"length({t})"
    useful = f"({cjk} + {alpha} + {digit})"
    known = f"(contains(lower({t}), 'the') OR contains(lower({t}), 'que'))"
    vowels = f"({_n(t, '[aeiouAEIOU]')} / greatest({alpha}, 1))"
    total = (
        f"CASE WHEN {cjk} >= 2 THEN 55 ELSE 0 END + CASE WHEN {cjk} >= 5 THEN 20 ELSE 0 END + CASE WHEN {known} THEN 35 ELSE 0 END + CASE WHEN regexp_matches({t}, '[0-9]{{2,}}-[A-Za-z]') THEN 18 ELSE 0 END"
        f" + CASE WHEN {alpha} >= 4 AND {size} >= 6 THEN 16 ELSE 0 END - CASE WHEN {useful} / greatest({size}, 1) < 0.68::DOUBLE THEN 25 ELSE 0 END - CASE WHEN {size} - {useful} >= {useful} THEN 25 ELSE 0 END"
        f" - CASE WHEN {alpha} >= 8 AND {cjk} = 0 AND NOT {known} AND ({vowels} < 0.18::DOUBLE OR {vowels} > 0.58::DOUBLE) THEN 25 ELSE 0 END - CASE WHEN {size} <= 3 AND {cjk} = 0 AND NOT {known} THEN 25 ELSE 0 END"
    )
    return f"CASE WHEN {size} = 0 THEN 0 ELSE greatest(0, least(100, {total})) / 100 END"


_EPSILON = "CASE WHEN d <= 0 THEN 0.001 ELSE least(greatest(0.5, d * 0.05::DOUBLE), greatest(d / 2, 0.001)) END"


def _filled(start: str) -> str:
    """CTE `done` (video_id, d, n, se, times): gaps filled from the rows of `start` (video_id, d, n, se, have, pool)."""
    return f"""
fill AS (
  SELECT video_id, d, n, se, pool, list_sort(list_distinct(list_transform(have, lambda x: {_ms("x")}))) AS have, FALSE AS stop, 0 AS it FROM {start}
  UNION ALL
  SELECT video_id, d, n, se, pool, CASE WHEN bad THEN have ELSE list_sort(list_append(have, pick)) END, bad, it + 1 FROM (
    SELECT *, w IS NULL OR len(list_filter(have, lambda t: abs(pick - t) <= 0.001)) > 0 AS bad FROM (
      SELECT *, round_even(least(greatest(coalesce(near, (w.l + w.r) / 2), 0), se) * 1000, 0) / 1000 AS pick FROM (
        SELECT *, (list_sort(list_transform(list_filter(pool, lambda t: t >= w.l AND t <= w.r), lambda t: {{'far': abs(t - (w.l + w.r) / 2), 't': t}})))[1].t AS near FROM (
          SELECT *, (list_reverse_sort(list_filter(list_transform(range(1, len(stops)), lambda i: {{'gap': stops[i + 1] - stops[i], 'early': -stops[i], 'l': stops[i], 'r': stops[i + 1]}}), lambda g: g.gap > 0.001)))[1] AS w FROM (
            SELECT *, list_sort(list_distinct(list_transform(list_concat([0.0::DOUBLE], have, [se::DOUBLE]), lambda x: {_ms("x")}))) AS stops FROM fill WHERE NOT stop AND len(have) < n
  )))))
), done AS (
  SELECT video_id, any_value(d) AS d, any_value(n) AS n, any_value(se) AS se, arg_max(have, it)[1:any_value(n)] AS times FROM fill GROUP BY 1
)"""


_CHUNKS = f"""
k AS (
  SELECT video_id, seg_idx, start, end_, speaker, trim({_known("text")}) AS text FROM s
), l AS (
  SELECT video_id, list({{'start': start, 'end': end_, 'text': text}} ORDER BY seg_idx) AS segs FROM k WHERE text <> '' GROUP BY 1
), ch AS (
  SELECT video_id, list_reduce(list_transform(segs, lambda x: [x]), lambda a, x: CASE WHEN length(a[-1].text) >= 420 THEN list_concat(a, x)
    ELSE list_concat(a[:-2], [{{'start': a[-1].start, 'end': x[1]."end", 'text': a[-1].text || ' ' || x[1].text}}]) END) AS c FROM l
)"""
_SPEAKERS = f"""
sp0 AS (
  SELECT video_id, trim(speaker) AS speaker, count(*) AS n, arg_min(start, seg_idx) AS start, max(end_) AS "end", string_agg(text, ' ' ORDER BY seg_idx) AS joined FROM k WHERE trim(coalesce(speaker, '')) <> '' AND text <> '' GROUP BY 1, 2
), sp AS (
  SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY n DESC, speaker)::INT AS rank, {_summary("joined")} AS summary, {_clip("joined", 220)} AS excerpt FROM sp0
)"""

_WORDS = f"""{LINES}, wl AS (
  SELECT doc_id, unnest(range(len(lines)))::INT AS line_num, unnest(lines) AS line FROM d
), wa AS (
  SELECT doc_id, line_num, unnest(range(len(string_split(line, ' '))))::INT AS spot, unnest(string_split(line, ' ')) AS text FROM wl
), w AS (
  SELECT doc_id AS video_id, 'r' || (line_num % 2) AS region, line_num::BIGINT * 4294967296 + spot AS pos, trim(text) AS text, ((line_num::BIGINT * 31 + spot) * 37 + doc_id) % 100 AS conf, spot * 40 AS "left", line_num * 22 + spot % 3 AS top, line_num % 2 AS par_num, line_num
  FROM wa WHERE trim(text) <> ''
)"""

_EVIDENCE = f"""{SEGMENTS}, f AS (
  SELECT video_id, seg_idx AS idx, start + 9 AS ts FROM s WHERE seg_idx % 3 = 0
), j AS (
  SELECT f.video_id, f.idx, f.ts, list({{'seg_idx': s.seg_idx, 'start': s.start, 'end': s.end_, 'speaker': s.speaker, 'text': trim(s.text)}} ORDER BY s.seg_idx) FILTER (s.seg_idx IS NOT NULL) AS near
  FROM f LEFT JOIN s ON s.video_id = f.video_id AND (abs((s.start + s.end_) / 2 - f.ts) <= 2 OR f.ts BETWEEN s.start AND s.end_) GROUP BY 1, 2, 3
), al AS (
  SELECT video_id, list({{'idx': idx, 'ts': ts, 'near': near}} ORDER BY idx) AS frames FROM j GROUP BY 1
), ev AS (
  SELECT s.video_id, list({{'start': start, 'end': end_, 'speaker': speaker, 'text': trim(text)}} ORDER BY seg_idx) AS segs, max(end_) + 1 AS d,
    coalesce(list({{'ts': start, 'text': trim(text)}} ORDER BY start) FILTER (speaker = 'assistant'), []) AS said, any_value(al.frames) AS frames
  FROM s LEFT JOIN al ON al.video_id = s.video_id GROUP BY 1
)"""
_SEG_LINE = "trim('[' || printf('%.2f', x.start) || '-' || printf('%.2f', x.\"end\") || 's]' || CASE WHEN coalesce(x.speaker, '') <> '' THEN ' ' || x.speaker || ':' ELSE '' END || ' ' || x.text)"


def _representative(most: int) -> str:
    """The segments that stand for a transcript: all, every n-th, or head, even middle and tail."""
    n, side = "len(segs)", min(8, most // 4)
    middle = most - 2 * side
    step = f"greatest(1, {n} // {most})"
    spots = f"list_transform(range({middle}), lambda j: round_even(j * ({n} - {2 * side + 1}) / {max(1, middle - 1)}, 0))"
    keep = f"(i - 1) % {step} = 0 AND (i - 1) // {step} < {most}" if most <= 6 else f"i <= {side} OR i > {n} - {side} OR {middle} >= {n} - {2 * side} OR list_contains({spots}, (i - 1 - {side})::DOUBLE)"
    return f"CASE WHEN {n} <= {most} THEN segs ELSE list_filter(segs, lambda x, i: {keep}) END"


def _transcript(most: int) -> str:
    note = "'[coverage note] Transcript has ' || len(segs) || ' segments from ' || printf('%.2f', segs[1].start) || 's to ' || printf('%.2f', segs[-1].\"end\") || 's; representative segments above are sampled across the whole video.'"
    return f"array_to_string(list_concat(list_transform({_representative(most)}, lambda x: {_SEG_LINE}), CASE WHEN len(segs) > {most} THEN [{note}] ELSE [] END), {_NL})"


def _prompt(final: bool) -> str:
    q = lambda x: "'" + x.replace("'", "''") + "'"
    audio = f"CASE WHEN video_id % 2 = 0 THEN {q(report.WITH_AUDIO)} ELSE {q(report.WITHOUT_AUDIO)} END"
    frames = f"array_to_string(list_transform(frames, lambda x: '- frame ' || x.idx || ': approximately ' || printf('%.2f', x.ts) || 's'), {_NL})"
    heads = [q(h) for h in report.ASKED_HEADINGS]
    parts = [
        q("Understand this video from representative frames" + (" and batch summaries." if final else ".")), "'Video duration: approximately ' || printf('%.2f', d) || ' seconds.'", q("What happens?"), "''", audio, "''", q("Transcript evidence:"), "transcript", "''",
        q("OCR evidence:"), "read", "''", q("Transcript coverage note:"), q(report.COVERAGE_NOTE), "''", q("All sampled frame timestamps:" if final else "Frame timestamps:"), frames, "''",
    ]
    if final:
        parts += [q("Batch-level visual summaries:"), "'Batch 1 (0.00s-' || printf('%.2f', d) || 's, ' || len(frames) || ' frames):'", q("said"), "''"]
        end = "Important: section headings must be Chinese. Synthesize across the whole video. Ground claims in transcript, OCR, frames, and batch summaries only."
    else:
        end = "Important: section headings must be Chinese. Ground claims in the transcript, OCR, and sampled frames only."
    return f" || {_NL} || ".join([*parts, *heads, "''", q(end)])


_BATCH = f" || {_NL} || ".join([
    "'Analyze batch 1 of 2 for this video.'", "'Video duration: approximately ' || printf('%.2f', d) || ' seconds.'", "'This batch covers approximately ' || printf('%.2f', frames[1].ts) || 's to ' || printf('%.2f', frames[-1].ts) || 's.'", "'What happens?'", "''",
    f"CASE WHEN video_id % 2 = 0 THEN '{report.WITH_AUDIO}' ELSE '{report.WITHOUT_AUDIO}' END", "''", "'Transcript evidence:'", "transcript", "''", "'OCR evidence for this batch:'", "CASE WHEN read = '' THEN 'No OCR text available in this batch.' ELSE read END", "''",
    "'Frame timestamps in this batch:'", f"array_to_string(list_transform(frames, lambda x: '- frame ' || x.idx || ': approximately ' || printf('%.2f', x.ts) || 's'), {_NL})", "''", *[f"'{h}'" for h in report.ASKED_OF_BATCH], "''",
    "'Important: ground claims in the transcript, OCR, and sampled frames only.'",
])

_TIPS = ", ".join(f"CASE WHEN err = '{w}' THEN '- {tip}' END" for w, tip in rules.ERROR_TIPS)
_HEADS = report.ASKED_HEADINGS[1:]

ORACLES: dict[str, str] = {
    "source_resolution": r"""
WITH p AS (
  SELECT page_id, url, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN 'see ' || url || ', then' WHEN 2 THEN 'https://www.douyin.com/jingxuan?from=x&modal_id=' || page_id WHEN 3 THEN 'look: https://vm.tiktok.com/Z' || page_id || '.' ELSE 'no address here' END AS raw FROM pages
), r AS (
  SELECT *, CASE page_id % 5 WHEN 1 THEN url WHEN 3 THEN 'https://vm.tiktok.com/Z' || page_id ELSE raw END AS resolved FROM p
), h AS (
  SELECT *, lower(regexp_extract(resolved, '^[a-zA-Z]+://([^/?#]*)', 1)) AS host, lower(regexp_extract(regexp_extract(resolved, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '[^/.](\.[^./]+)$', 1)) AS ext FROM r
)
SELECT page_id, page_id % 5 IN (0, 2) AS is_url, resolved, host, CASE WHEN page_id % 5 = 2 THEN 'https://www.douyin.com/video/' || page_id ELSE resolved END AS page_url, page_id % 5 = 3 AS is_short,
  CASE WHEN ext IN ('.mp4', '.mov', '.mkv', '.webm', '.m4v', '.avi') THEN ext ELSE '.webm' END AS suffix FROM h""",
    "source_help": f"""
WITH p AS (
  SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN 'https://www.tiktok.com/v/' || page_id ELSE url END AS u, [{", ".join(f"'{w}'" for w, _ in rules.ERROR_TIPS)}, 'unknown'][page_id % 7 + 1] AS err FROM pages
), t AS (
  SELECT *, list_filter([CASE WHEN u <> url THEN '- {rules.REWRITTEN_TIP}' || u END, CASE WHEN page_id % 3 = 0 THEN '- {rules.SITE_TIP}' END, {_TIPS}], lambda x: x IS NOT NULL) AS tips FROM p
)
SELECT page_id, CASE WHEN len(tips) = 0 THEN '- {rules.OTHER_TIP}' ELSE array_to_string(tips, {_NL}) END AS help, page_id % 4 <> 0 AS direct,
  CASE WHEN page_id % 5 = 0 THEN 'chrome,edge,firefox' WHEN page_id % 3 = 0 THEN 'brave' WHEN page_id % 2 = 0 THEN 'chrome,edge,firefox' ELSE '' END AS browsers,
  CASE WHEN page_id % 2 = 0 AND page_id % 3 = 0 AND page_id % 5 = 0 THEN 'openai-hybrid' WHEN page_id % 6 = 0 THEN 'native-openai-or-hybrid' WHEN page_id % 5 = 0 AND (page_id % 7 = 0 OR page_id % 11 = 0) THEN 'timeline-pipeline'
    WHEN page_id % 5 = 0 THEN 'transcript-and-frame-pipeline-with-external-tools' ELSE 'dependency-blocked' END AS path,
  '{{"video_path":"' || url || '","video_exists":' || (page_id % 2 = 0)::VARCHAR || ',"transcript_path":' || CASE WHEN page_id % 3 = 0 THEN '"t.srt"' ELSE 'null' END || ',"transcript_exists":' || (page_id % 6 = 0)::VARCHAR
    || ',"question":"' || CASE WHEN page_id % 2 = 0 THEN '{landing.QUESTION}' ELSE 'why?' END || '","mode":"' || CASE WHEN page_id % 5 = 0 THEN 'native' ELSE 'auto' END || '","required_output":[{",".join(f'"{x}"' for x in landing.REQUIRED_OUTPUT)}]}}' AS brief
FROM t""",
    "cookie_jar": "SELECT user_id AS video_id, event_type AS name, max(event_id)::VARCHAR AS value FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0 GROUP BY 1, 2",
    "resolved_sources": """
SELECT user_id AS video_id, coalesce('/v/' || min(event_id) FILTER (event_type = 'purchase'), '') AS path, coalesce(string_agg('E' || event_id, '|' ORDER BY event_id) FILTER (event_type <> 'purchase'), '') AS errors FROM events GROUP BY 1""",
    "chosen_devices": """
WITH d AS (SELECT user_id AS video_id, event_id, event_type || ' ' || (event_id % 10) AS name FROM events WHERE event_id % 3 = 0 AND event_type <> 'error')
SELECT video_id, arg_min(name, (CASE WHEN name LIKE 'purchase%' THEN 0 WHEN regexp_matches(name, 'click [0-4]') THEN 1 WHEN name LIKE 'view%' THEN 2 ELSE 3 END, event_id)) AS name FROM d GROUP BY 1""",
    "chosen_models": """
WITH k AS (SELECT user_id AS video_id, event_id, event_type, CASE WHEN event_id % 53 = 0 THEN 'path' WHEN event_id % 41 = 0 THEN 'folder' ELSE 'snapshot' END AS kind FROM events WHERE event_type IN ('view', 'click'))
SELECT video_id, coalesce(min('/m/' || event_id) FILTER (kind = 'path'), min('/m/' || event_id) FILTER (kind = 'folder'), '/m/' || max(event_id) FILTER (kind = 'snapshot' AND event_type = 'view' AND event_id % 10 = 0), 'small') AS model FROM k GROUP BY 1""",
    "scene_logs": f"""
WITH {EVENTS}, l AS (
  SELECT video_id, list_sort(list_distinct(list(round_even(ts * 1000, 0) / 1000))) AS ts FROM e GROUP BY 1
), k AS (
  SELECT video_id, list_reduce(list_transform(ts, lambda x: [x]), lambda a, x: CASE WHEN x[1] - a[-1] >= 7200.0 THEN list_concat(a, x) ELSE a END) AS t FROM l
)
SELECT video_id, unnest(range(len(t)))::INT AS pos, unnest(t) AS ts FROM k""",
    "filled_timeline": f"""
WITH RECURSIVE {EVENTS}, x AS (
  SELECT video_id, ts FROM e WHERE event_type = 'error'
), v0 AS (
  SELECT video_id, max(ts) AS d, CASE WHEN max(ts) <= 0 THEN 1 ELSE greatest(1, least({MOST}, ceil(max(ts) / {SAMPLE}))) END::INT AS n, list_sort(list_distinct(list({_ms("ts")}))) AS pool FROM x GROUP BY 1
), v AS (
  SELECT *, greatest(d - {_EPSILON}, 0) AS se, d <= 0 OR n <= 1 AS single FROM v0
), w0 AS (
  SELECT *, unnest(range(CASE WHEN single THEN 1 ELSE n END))::INT AS idx FROM v
), w1 AS (
  SELECT *, CASE WHEN single THEN 0 ELSE idx * (d / n) END AS a, CASE WHEN single THEN greatest(d, 0) ELSE least(CASE WHEN idx = n - 1 THEN d ELSE (idx + 1) * (d / n) END, se) END AS b FROM w0
), w AS (
  SELECT *, {_ms("a")} AS w_start, {_ms("greatest(b, a)")} AS w_end, {_ms("CASE WHEN single THEN 0 ELSE greatest(least(a + (b - a) / 2, se), 0) END")} AS center FROM w1
), p AS (
  SELECT w.video_id, w.idx, any_value(w.d) AS d, any_value(w.n) AS n, any_value(w.se) AS se, any_value(w.pool) AS pool,
    coalesce((min({{'far': abs(x.ts - w.center), 'ts': x.ts}}) FILTER (x.ts IS NOT NULL)).ts, any_value(w.center)) AS pick
  FROM w LEFT JOIN x ON x.video_id = w.video_id AND (x.ts BETWEEN w_start AND w_end OR (w.idx = w.n - 1 AND x.ts BETWEEN w_start AND w.d)) GROUP BY 1, 2
), g AS (
  SELECT video_id, any_value(d) AS d, any_value(n) AS n, any_value(se) AS se, any_value(pool) AS pool, list(pick) AS have FROM p GROUP BY 1
), {_filled("g")}, t AS (
  SELECT video_id, n, CASE WHEN d <= 0 THEN [0.0::DOUBLE] ELSE list_sort(list_distinct(list_transform(list_concat([0.0::DOUBLE], times, [se::DOUBLE]), lambda x: {_ms("x")}))) END AS times FROM done
)
SELECT video_id, n AS budget, unnest(range(len(times)))::INT AS pos, unnest(times) AS ts FROM t""",
    "video_timeline": f"""
WITH RECURSIVE {EVENTS}, x AS (
  SELECT video_id, ts FROM e WHERE event_type = 'error' AND video_id % 3 > 0
), l AS (
  SELECT video_id, coalesce(CASE WHEN video_id % 10 = 0 THEN 0 WHEN video_id % 11 = 0 THEN NULL WHEN video_id % 7 = 0 THEN floor(max(ts)) / 2 ELSE floor(max(ts)) + 40000 * (video_id % 3) END, 0)::DOUBLE AS d FROM e GROUP BY 1
), q AS (
  SELECT video_id, list_sort(list_distinct(list({_ms("ts")}))) AS pool FROM x GROUP BY 1
), v0 AS (
  SELECT video_id, d, CASE WHEN d <= 0 THEN 1 ELSE greatest(1, least({MOST}, ceil(d / {SAMPLE}))) END::INT AS n, coalesce(pool, []::DOUBLE[]) AS pool FROM l LEFT JOIN q USING (video_id)
), v AS (
  SELECT *, greatest(d - {_EPSILON}, 0) AS se, d <= 0 OR n <= 1 AS single FROM v0
), w0 AS (
  SELECT *, unnest(range(CASE WHEN single THEN 1 ELSE n END))::INT AS idx FROM v
), w1 AS (
  SELECT *, CASE WHEN single THEN 0 ELSE idx * (d / n) END AS a, CASE WHEN single THEN greatest(d, 0) ELSE least(CASE WHEN idx = n - 1 THEN d ELSE (idx + 1) * (d / n) END, se) END AS b FROM w0
), w AS (
  SELECT *, {_ms("a")} AS w_start, {_ms("greatest(b, a)")} AS w_end, {_ms("CASE WHEN single THEN 0 ELSE greatest(least(a + (b - a) / 2, se), 0) END")} AS center FROM w1
), p AS (
  SELECT w.video_id, w.idx, any_value(w.d) AS d, any_value(w.n) AS n, any_value(w.se) AS se, any_value(w.pool) AS pool,
    coalesce((min({{'far': abs(x.ts - w.center), 'ts': x.ts}}) FILTER (x.ts IS NOT NULL)).ts, any_value(w.center)) AS pick
  FROM w LEFT JOIN x ON x.video_id = w.video_id AND (x.ts BETWEEN w_start AND w_end OR (w.idx = w.n - 1 AND x.ts BETWEEN w_start AND w.d)) GROUP BY 1, 2
), g AS (
  SELECT video_id, any_value(d) AS d, any_value(n) AS n, any_value(se) AS se, any_value(pool) AS pool, list(pick) AS have FROM p GROUP BY 1
), {_filled("g")}, t AS (
  SELECT video_id, d, n, CASE WHEN d <= 0 THEN [0.0::DOUBLE] ELSE list_sort(list_distinct(list_transform(list_concat([0.0::DOUBLE], times, [se::DOUBLE]), lambda x: {_ms("x")}))) END AS times FROM done
)
SELECT video_id, d AS duration, n AS budget, unnest(range(len(times)))::INT AS pos, unnest(times) AS ts FROM t""",
    "uniform_timeline": f"""
WITH RECURSIVE {EVENTS}, v0 AS (
  SELECT video_id, max(ts) / 1000 AS d FROM e GROUP BY 1
), v1 AS (
  SELECT *, CASE WHEN d <= 0 THEN 1 ELSE greatest(1, least(9, ceil(d / 60))) END::INT AS n, greatest(d - {_EPSILON}, 0) AS se FROM v0
), g AS (
  SELECT video_id, d, n, se, []::DOUBLE[] AS pool, CASE WHEN n <= 1 THEN [0.0::DOUBLE] ELSE list_transform(range(n), lambda i: {_ms("greatest(least(i * (d / n) + (least(CASE WHEN i = n - 1 THEN d ELSE (i + 1) * (d / n) END, se) - i * (d / n)) / 2, se), 0)")}) END AS have FROM v1
), {_filled("g")}
SELECT video_id, 'segment-coverage-uniform-sampling (frame_budget=' || CASE WHEN floor(d) <= 0 THEN 1 ELSE greatest(1, least(9, ceil(floor(d) / 60))) END::INT || ', actual_frames=' || len(times) || ', duration=' || printf('%.2f', floor(d)) || 's, sample_seconds=60.00)' AS label,
  unnest(range(len(times)))::INT AS pos, unnest(times) AS ts FROM done""",
    "all_changes_timeline": f"""
WITH {EVENTS}, l AS (
  SELECT video_id, max(ts) AS d, list_sort(list_distinct(list({_ms("ts")}))) AS ts FROM e GROUP BY 1
), k AS (
  SELECT video_id, d, greatest(d - {_EPSILON}, 0)::DOUBLE AS se, list_reduce(list_transform(ts, lambda x: [x]), lambda a, x: CASE WHEN x[1] - a[-1] >= 14400.0 THEN list_concat(a, x) ELSE a END) AS kept FROM l
), t AS (
  SELECT video_id, d, se, CASE WHEN d <= 0 THEN [0.0::DOUBLE] ELSE list_sort(list_distinct(list_transform(list_concat([0.0::DOUBLE], kept, [se]), lambda x: {_ms("x")}))) END AS times FROM k
), i AS (
  SELECT *, list_filter(times, lambda x: x <> 0 AND x <> {_ms("se")}) AS inside FROM t
)
SELECT video_id, 'all-detected-changes-layout-filtered (actual_frames=' || len(times) || ', duration=' || printf('%.2f', floor(d)) || 's)' AS label, len(inside)::INT AS n_inner,
  coalesce(list_sum(list_transform(inside, lambda x: round_even(x * 1000, 0)::BIGINT)), 0)::BIGINT AS checksum, list_sum(list_transform(times, lambda x: round_even(x * 1000, 0)::BIGINT))::BIGINT AS all_checksum FROM i""",
    "spaced_segments": """
WITH s AS (
  SELECT user_id AS video_id, event_id AS seg_idx, event_type || (event_id % 5) AS text, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events
), k AS (
  SELECT *, row_number() OVER (PARTITION BY video_id, text ORDER BY seg_idx) AS again FROM s
  WHERE n <= 24 OR i < 6 OR i >= n - 6 OR n - 12 <= 12 OR list_contains(list_transform(range(12), lambda j: round_even(j * (n - 13) / 11, 0)), (i - 6)::DOUBLE)
)
SELECT video_id, seg_idx, text FROM k WHERE n <= 24 OR again = 1""",
    "speech_chunks": f"""
WITH {SEGMENTS}, l AS (
  SELECT video_id, list({{'start': start, 'end': end_, 'text': trim(text)}} ORDER BY seg_idx) AS segs FROM s GROUP BY 1
), ch AS (
  SELECT video_id, list_reduce(list_transform(segs, lambda x: [x]), lambda a, x: CASE WHEN length(a[-1].text) >= 420 THEN list_concat(a, x)
    ELSE list_concat(a[:-2], [{{'start': a[-1].start, 'end': x[1]."end", 'text': a[-1].text || ' ' || x[1].text}}]) END) AS c FROM l
), u AS (SELECT video_id, unnest(range(len(c)))::INT AS chunk_idx, unnest(c) AS c FROM ch)
SELECT video_id, chunk_idx, c.start AS start, c."end" AS "end", c.text AS text, '口播片段' AS title FROM u""",
    "speaker_summary": f"""
WITH {SEGMENTS}, k AS (SELECT video_id, seg_idx, start, end_, speaker, trim({_known("text")}) AS text FROM s), {_SPEAKERS}
SELECT video_id, rank, speaker, n AS segment_count, start, "end", joined, summary, excerpt FROM sp""",
    "speech_markdown": f"""
WITH {SEGMENTS}, {_CHUNKS}, {_SPEAKERS}, c AS (
  SELECT video_id, count(*) AS n, arg_min(start, seg_idx) AS a, arg_max(end_, seg_idx) AS b FROM s GROUP BY 1
), q AS (
  SELECT video_id, count(*) AS people, string_agg('- ' || speaker || '（' || {_label("start")} || ' - ' || {_label('"end"')} || '，' || n || ' 段）: ' || summary, {_NL} ORDER BY rank) AS about,
    string_agg('- ' || speaker || '：' || summary || '（' || {_label("start")} || ' - ' || {_label('"end"')} || '，' || n || ' 段）' || {_NL} || '摘录：' || excerpt, {_NL} ORDER BY rank) AS told FROM sp GROUP BY 1
), r AS (
  SELECT c.*, ch.c AS chunks, q.people, q.about, q.told, array_to_string(list_transform(ch.c, lambda x: x.text), {_NL}) AS whole FROM c JOIN ch USING (video_id) LEFT JOIN q USING (video_id)
), g AS (
  SELECT *, '/v/' || video_id || '.mp4' AS path, list_transform(chunks, lambda x: {_summary("x.text")}) AS sums FROM r
)
SELECT video_id, 'literal' AS mode, n AS segment_count,
  '# 博主口播转写' || {_NL} || {_NL} || '- 来源视频: `' || path || '`' || {_NL} || '- 转写片段数: `' || n || '`' || {_NL} || '- 覆盖时间: `' || {_label("a")} || '` - `' || {_label("b")} || '`' || {_NL} || {_NL} || '## 按时间整理'
  || CASE WHEN people >= 2 THEN {_NL} || {_NL} || '## 说话人概览' || {_NL} || about ELSE '' END
  || array_to_string(list_transform(chunks, lambda x: {_NL} || {_NL} || '### ' || {_label("x.start")} || ' - ' || {_label('x."end"')} || {_NL} || x.text), '') AS markdown FROM g
UNION ALL
SELECT video_id, 'knowledge', n,
  '# 博主口播整理为知识 Markdown' || {_NL} || {_NL} || '- 来源视频: `' || path || '`' || {_NL} || '- 转写来源: `' || CASE WHEN video_id % 2 = 0 THEN 'local' ELSE 'unknown' END || '`' || {_NL} || '- 转写片段数: `' || n || '`' || {_NL}
  || '- 覆盖时间: `' || {_label("a")} || '` - `' || {_label("b")} || '`' || {_NL} || '- 说明: 以下知识标题为自动生成，用于整理口播内容；不是视频画面中的原始标题。' || {_NL} || {_NL} || '## 核心观点（生成整理）' || {_NL}
  || CASE WHEN contains(whole, 'THE') OR contains(whole, 'les') THEN '- It has articles.' ELSE array_to_string(list_transform(sums[1:3], lambda x: '- ' || x), {_NL}) END
  || {_NL} || {_NL} || '## 方法 / 流程（生成整理）' || CASE WHEN contains(whole, 'QUE') THEN {_NL} || '- It asks.' ELSE array_to_string(list_transform(sums[2:4], lambda x: {_NL} || '- ' || x), '') END
  || {_NL} || {_NL} || '## 工具与系统组件（生成整理）' || {_NL} || CASE WHEN contains(whole, 'ing') THEN '- It goes on.' ELSE '- 未识别到稳定的工具或系统组件表述。' END
  || {_NL} || {_NL} || '## 案例与应用场景（生成整理）' || {_NL} || CASE WHEN contains(whole, 'zzz') THEN '- It sleeps.' ELSE '- 未识别到稳定的案例或应用场景表述。' END
  || CASE WHEN people >= 2 THEN {_NL} || {_NL} || '## 说话人分工（基于转写标签）' || {_NL} || told ELSE '' END || {_NL} || {_NL} || '## 原始口播摘录（带时间戳）'
  || array_to_string(list_transform(chunks, lambda x: {_NL} || {_NL} || '### ' || {_label("x.start")} || ' - ' || {_label('x."end"')} || ' ' || {_title("x.text")} || {_NL} || {_NL} || '**整理摘要:** ' || {_summary("x.text")} || {_NL} || {_NL} || '**原文摘录:** ' || x.text), '') FROM g
UNION ALL
SELECT -1, unnest(['literal', 'knowledge']), 0, '{speech.NOT_TRANSCRIBED.replace(chr(10), "' || chr(10) || '")}'""",
    "speech_sentences": rf"""
WITH m AS (
  SELECT doc_id, regexp_replace({_known("regexp_replace(coalesce(text, ''), '\\. ', '! ', 'g')")}, '([。！？!?；;])\s+', '\1' || chr(10), 'g') AS t FROM documents
), s AS (
  SELECT doc_id, list_filter(list_transform(regexp_split_to_array(t, '[\r\n]+'), lambda x: regexp_replace(regexp_replace(x, '\s+', ' ', 'g'), '^[ ，,。；;：:]+|[ ，,。；;：:]+$', '', 'g')), lambda x: length(x) >= 8) AS s FROM m
), h AS (
  SELECT *, list_filter(s, lambda x: contains(lower(x), 'the') OR contains(lower(x), 'que') OR contains(lower(x), 'der')) AS held FROM s
), b AS (
  SELECT *, list_transform(held, lambda x: lower(regexp_replace(x, '\s+', '', 'g'))) AS bare FROM h
)
SELECT doc_id, len(s)::INT AS n_sentences, array_to_string(s, chr(10)) AS sentences, array_to_string(list_filter(held, lambda x, i: list_position(bare, bare[i]) = i)[1:5], chr(10)) AS notes FROM b""",
    "term_repairs": f"""
SELECT conv_id AS video_id, turn::INT AS seg_idx, {_common("text")} AS repaired, {_known("text")} AS known, {_clip("text", 40)} AS clipped, {_title("text")} AS title, {_spaced("text")} AS spaced,
  trim(coalesce(text, '')) <> '' AND NOT regexp_matches(lower(text), '^\\s*(<!doctype html|<html)') AS has_transcript FROM conversations""",
    "confident_text": f"""
WITH {_WORDS}, l AS (
  SELECT video_id, region, par_num, line_num, string_agg(text, ' ' ORDER BY pos) AS line FROM w WHERE conf >= 28 GROUP BY ALL
), c AS (SELECT video_id, region, par_num, line_num, {_ocr("line")} AS line FROM l)
SELECT video_id, region, string_agg(line, {_NL} ORDER BY par_num, line_num) AS text FROM c WHERE line <> '' GROUP BY 1, 2""",
    "document_rows": f"""
WITH {_WORDS} SELECT video_id, round_even((top + 8) / 18, 0)::INT AS row, string_agg(text, ' ' ORDER BY "left", pos) AS line FROM w WHERE conf >= 18 GROUP BY 1, 2""",
    "document_lines": rf"""
WITH {LINES}, l AS (
  SELECT doc_id, unnest(range(len(lines)))::INT AS line_no, unnest(lines) AS raw FROM d
), o AS (
  SELECT *, {_ocr(_common("raw"))} AS t, {_ocr("raw")} AS u FROM l
), q AS (
  SELECT *, regexp_replace(t, '\s+', '', 'g') AS bare, trim(regexp_replace({_known(_common("u"))}, '\s+', ' ', 'g')) AS m0 FROM o
), m AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace({_word("m0", "an", "AN")}, '\s+([，。？！：；、])', '\1', 'g'), '([（(])\s+', '\1', 'g'), '\s+([）)])', '\1', 'g') AS m FROM q
)
SELECT doc_id, line_no, t <> '' AND NOT regexp_matches(t, '(ouair|estio)') AND {_n("t", _USEFUL)} >= 4 AND {_quality("bare")} >= 0.36 AS is_document,
  CASE WHEN regexp_matches(m, '^[•·\-*]\s*(.+)') THEN '- ' || trim(regexp_extract(m, '^[•·\-*]\s*(.+)', 1)) WHEN regexp_matches(m, '^(\d+)[.、]\s*(.+)') THEN regexp_extract(m, '^(\d+)[.、]\s*(.+)', 1) || '. ' || trim(regexp_extract(m, '^(\d+)[.、]\s*(.+)', 2))
    WHEN length(m) <= 34 AND (m LIKE '%：' OR m LIKE '%:' OR regexp_matches(m, '(?i)(ing|tion)$')) THEN '### ' || regexp_replace(m, '[:：]+$', '') ELSE m END AS markdown,
  {_fragment("raw")} AS fragment FROM m""",
    "document_candidates": f"""
WITH {LINES}, c AS (
  SELECT doc_id, lines, array_to_string(lines, chr(10)) AS text, list_transform(lines, lambda t: {_n("t", _USEFUL)}) AS n,
    len(list_filter(lines, lambda t: {_n("t", _USEFUL)} >= 18)) AS para, len(list_filter(lines, lambda t: starts_with(t, '#') OR regexp_matches(t, '^[一二三四五六七八九十]+[、.．]'))) + len(list_filter(lines, lambda t: starts_with(t, '- ') OR regexp_matches(t, '^[0-9]+\\.'))) AS marked FROM d
), k AS (
  SELECT *, contains(text, 'the')::INT + contains(text, 'que')::INT + contains(text, 'der')::INT + contains(text, 'les')::INT AS docs, contains(text, 'is on')::INT + contains(text, 'por la')::INT AS ui, {_n("text", _CJK)} AS cjk,
    contains(lower(text), 'is on')::INT + contains(lower(text), 'por la')::INT + contains(lower(text), 'de la')::INT AS held, len(list_filter(n, lambda x: x < 8)) AS few,
    CASE WHEN len(n) > 0 THEN least(list_sum(n) / greatest(len(n), 1) / 18.0::DOUBLE, 1.0::DOUBLE) * 0.5::DOUBLE + least(len(list_filter(n, lambda x: x >= 12)) / 5.0::DOUBLE, 1.0::DOUBLE) * 0.5::DOUBLE ELSE 0 END AS density FROM c
), z AS (
  SELECT *, CASE WHEN len(lines) = 0 THEN 0 ELSE greatest(0, least(1, least(cjk / 180.0::DOUBLE, 1) * 0.35::DOUBLE + least(para / 6.0::DOUBLE, 1) * 0.25::DOUBLE + least(marked / 5.0::DOUBLE, 1) * 0.2::DOUBLE + least(docs / 3.0::DOUBLE, 1) * 0.25::DOUBLE - least(ui / 3.0::DOUBLE, 1) * 0.45::DOUBLE
    - CASE WHEN para < 2 THEN 0.25 ELSE 0 END::DOUBLE - CASE WHEN docs <= 0 THEN 0.38 ELSE 0 END::DOUBLE)) END::DOUBLE AS score FROM k
)
SELECT doc_id, round(score, 6) AS score, len(lines) > 0 AND score >= 0.1::DOUBLE AND density >= 0.34::DOUBLE AND few < greatest(5, len(lines) * 0.7::DOUBLE) AND NOT (held >= 3 AND density < 0.55::DOUBLE) AS is_candidate FROM z""",
    "structured_document": f"""
WITH f AS (
  SELECT conv_id AS video_id, turn AS pos, {_fragment("CASE WHEN conv_id % 9 = 0 THEN substr(text, 1, 5) ELSE text END")} AS line FROM conversations
), k AS (
  SELECT *, CASE WHEN contains(line, ' les ') THEN 'source' WHEN contains(line, ' THE ') OR contains(line, ' the ') THEN 'review' WHEN contains(line, ' que ') OR contains(line, ' der ') THEN 'rules' END AS b FROM f WHERE {_n("line", _USEFUL)} >= 6
), p AS (
  SELECT *, coalesce(last_value(b IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'source') AS part FROM k
), t AS (
  SELECT *, CASE WHEN part = 'review' THEN CASE WHEN line LIKE '%：' THEN '### ' || rtrim(line, '：') WHEN regexp_matches(line, '(ing|tion)') THEN '- ' || line ELSE line END
    WHEN part = 'rules' THEN CASE WHEN contains(line, 'para') THEN '- `' || line || '`' WHEN regexp_matches(line, '^(el|de|die)') THEN '- ' || line ELSE line END ELSE line END AS shown FROM p
)
SELECT video_id, trim('{report.DOCUMENT_TITLE}' || coalesce({_NL} || {_NL} || '## Review' || {_NL} || {_NL} || string_agg(shown, {_NL} || {_NL} ORDER BY pos) FILTER (part = 'review'), '')
  || coalesce({_NL} || {_NL} || '## Source' || {_NL} || {_NL} || string_agg(shown, {_NL} || {_NL} ORDER BY pos) FILTER (part = 'source'), '')
  || coalesce({_NL} || {_NL} || '## Rules' || {_NL} || {_NL} || string_agg(shown, {_NL} || {_NL} ORDER BY pos) FILTER (part = 'rules'), '')) AS markdown FROM (SELECT DISTINCT video_id FROM f) LEFT JOIN t USING (video_id) GROUP BY 1""",
    "literal_document": f"""
WITH {LINES}, f AS (
  SELECT doc_id, list_filter(list_transform(lines, lambda x: {_fragment("x")}), lambda x: x <> '') AS lines FROM d
)
SELECT doc_id % 20 AS video_id, '{report.LITERAL_HEAD.replace(chr(10), "' || chr(10) || '")}' || {_NL} || string_agg('## 画面 @ ' || printf('%.2f', doc_id::DOUBLE) || 's' || CASE WHEN len(lines) > 0 THEN {_NL} || {_NL} || array_to_string(lines, {_NL} || {_NL}) ELSE '' END, {_NL} || {_NL} ORDER BY doc_id) AS markdown FROM f GROUP BY 1""",
    "report_sections": f"""
WITH g AS (
  SELECT conv_id AS video_id, arg_min(text, turn) AS a, arg_max(text, turn) AS b, max(turn) * 4.0::DOUBLE + 3 AS e FROM conversations GROUP BY 1
), u AS (
  SELECT *, list_filter(list_transform(string_split({_known("'ocr is doing it' || chr(10) || chr(10) || b || chr(10) || 'der einen les' || chr(10)")}, chr(10)), lambda x: trim(x)),
    lambda x: x <> '' AND NOT (contains(lower(x), 'ocr') AND (contains(x, 'ing') OR contains(x, 'tion'))) AND NOT (e >= 40 AND contains(x, 'der') AND (contains(x, 'les') OR contains(x, 'en')))) AS kept FROM g
)
SELECT video_id, trim({_known("a")}) AS summary, {_known("'1. open the file' || chr(10) || '2. save it' || chr(10) || '  ' || rtrim(b)")} AS timeline, trim({_known("b")}) AS key_spoken_points, '' AS key_visual_events, trim({_known("a")}) AS visible_text,
  CASE WHEN len(kept) = 0 THEN '{rules.NO_UNCERTAINTY}' ELSE array_to_string(kept, chr(10)) END AS uncertainties FROM u""",
    "local_report": f"""
WITH {_EVIDENCE}, t AS (
  SELECT *, {_transcript(6)} AS transcript FROM ev
), p AS (
  SELECT *, 'Local fallback summary for the question: What happens? Video duration is approximately ' || printf('%.2f', d) || ' seconds. This report was generated from local transcript extraction, OCR, and sampled frames because the final Responses API synthesis step was unavailable.' AS summary,
    CASE WHEN frames IS NULL THEN 'No representative frames were sampled.' ELSE array_to_string(list_transform(frames, lambda x: '- ' || printf('%.2f', x.ts) || 's: sampled representative frame'), {_NL}) END AS timeline,
    'The video appears to be a screen recording with UI/state changes across the sampled frames. Use the timeline and OCR snippets together to inspect what changed on screen over time.' AS visual,
    CASE WHEN len(said) = 0 THEN 'No OCR text available.' ELSE array_to_string(list_transform(list_transform(said[1:12], lambda x: {{'ts': x.ts, 't': trim(regexp_replace(x.text, '\\s+', ' ', 'g'))}}), lambda x: '- ' || printf('%.2f', x.ts) || 's: ' || CASE WHEN length(x.t) > 140 THEN substr(x.t, 1, 137) || '...' ELSE x.t END), {_NL}) END AS visible,
    CASE WHEN video_id % 6 = 0 THEN 'Responses synthesis was unavailable: no key Remote transcription failed and local fallback was used: no sound' WHEN video_id % 2 = 0 THEN 'Responses synthesis was unavailable: no key'
      WHEN video_id % 3 = 0 THEN 'Remote transcription failed and local fallback was used: no sound' ELSE 'This fallback report is based on local transcript extraction, OCR, and sampled frames.' END AS doubt FROM t
)
SELECT video_id, {f" || {_NL} || {_NL} || ".join(f"'{h}' || {_NL} || {c}" for h, c in zip(_HEADS, ("summary", "timeline", "transcript", "visual", "visible", "doubt")))} AS output,
  '{report.REPORT_TITLE}' || {_NL} || {_NL} || '- 视频: `/v/' || video_id || '.mp4`' || {_NL} || '- 模型: `none`' || {_NL} || '- 时长: `' || printf('%.2f', d) || 's`' || {_NL} || '- 使用音频: `' || CASE WHEN video_id % 2 = 0 THEN 'True' ELSE 'False' END || '`' || {_NL} || {_NL}
  || {f" || {_NL} || {_NL} || ".join(f"'{h}' || {_NL} || {c}" for h, c in zip(report.REPORT_HEADINGS, ("summary", "timeline", "transcript", "visual", "visible", "doubt")))} || {_NL} || {_NL} || '{report.ALIGNMENT_HEADING}'
  || coalesce(array_to_string(list_transform(frames, lambda f: CASE WHEN f.near IS NULL THEN {_NL} || '- 帧 ' || f.idx || ' @ ' || printf('%.2f', f.ts) || 's: 附近没有转写片段'
    ELSE array_to_string(list_transform(f.near, lambda x: {_NL} || '- 帧 ' || f.idx || ' @ ' || printf('%.2f', f.ts) || 's: [' || printf('%.2f', x.start) || '-' || printf('%.2f', x."end") || 's] ' || CASE WHEN coalesce(x.speaker, '') <> '' THEN x.speaker || ': ' ELSE '' END || x.text), '') END), ''), '') AS markdown FROM p""",
    "prompts": f"""
WITH {_EVIDENCE}, t AS (
  SELECT *, {_transcript(80)} AS transcript, array_to_string(list_transform(said, lambda x: '[' || printf('%.2f', x.ts) || 's] ' || x.text), {_NL}) AS read FROM ev WHERE frames IS NOT NULL
)
SELECT video_id, {_prompt(False)} AS prompt, {_prompt(True)} AS final_prompt, {_BATCH} AS batch_prompt FROM t""",
    "long_transcripts": f"""
WITH g AS (
  SELECT role AS video_id, list({{'start': (conv_id * 10 + turn)::DOUBLE, 'end': conv_id * 10 + turn + 0.5::DOUBLE, 'speaker': NULL::VARCHAR, 'text': trim(text)}} ORDER BY conv_id * 10 + turn) AS segs
  FROM conversations WHERE trim(coalesce(text, '')) <> '' GROUP BY 1
)
SELECT video_id, {_transcript(5)} AS few, {_transcript(24)} AS some, {_transcript(80)} AS many FROM g""",
    "front_matter": f"""
WITH p AS (
  SELECT page_id AS i, url, CASE WHEN page_id % 3 = 0 THEN 'speech_note' ELSE 'video_report' END AS kind FROM pages
)
SELECT i AS page_id, CASE WHEN i % 6 = 0 THEN chr(65279) || '---' || {_NL} || 'x: 1' || {_NL} || '---' || {_NL} ELSE '---' || {_NL} || 'title: "' || CASE WHEN i % 3 = 0 THEN 'Speech Note' ELSE 'Video Report' END || '"' || {_NL} || 'source: "' || url || '"' || {_NL}
  || 'video_path: "/videos/My \\"clip\\" ' || i || CASE WHEN i % 2 = 0 THEN '.tar.mp4' ELSE '' END || '"' || {_NL} || 'created: "2026-01-01T00:00:00+0000"' || {_NL} || 'aliases:' || {_NL} || '  - "' || replace(kind, '_', ' ') || '"' || {_NL}
  || '  - "My \\"clip\\" ' || i || CASE WHEN i % 2 = 0 THEN '.tar' ELSE '' END || '"' || {_NL} || 'tags:' || {_NL} || '  - video-understanding' || {_NL} || '  - ' || replace(kind, '_', '-') || {_NL}
  || CASE WHEN i % 3 = 0 THEN '  - speech' || {_NL} ELSE '' END || CASE WHEN i % 5 = 0 THEN '  - document' || {_NL} ELSE '' END || CASE WHEN i % 2 = 0 THEN '  - ocr' || {_NL} ELSE '' END || CASE WHEN i % 4 = 0 THEN '  - web-video' || {_NL} ELSE '' END
  || CASE WHEN i % 7 = 0 THEN '  - change-sampling' || {_NL} ELSE '' END || '---' || {_NL} || '# Note' END AS markdown, chr(65279) || CASE WHEN i % 2 = 0 THEN 'nothing said' ELSE 'text' END AS file FROM p""",
    "keyframe_files": f"""
WITH {EVENTS}, f AS (
  SELECT video_id, event_id, event_id % 1200 AS idx, floor(ts) + (event_id % 4) * 0.25::DOUBLE AS ts, event_type, row_number() OVER (PARTITION BY video_id ORDER BY event_id) AS r FROM e
), n AS (
  SELECT *, event_type || '/frame-' || printf('%03d', idx) || '-' || printf('%.2f', ts) || 's.jpg' AS name, CASE WHEN event_id % 2 = 0 THEN '保留原因：kept-layout-strong' END AS reason, CASE WHEN event_id % 3 = 0 THEN 'OCR：a word of ' || event_type END AS read FROM f WHERE r <= 3
), b AS (
  SELECT video_id, string_agg('### ' || {_label("ts")} || {_NL} || {_NL} || CASE WHEN reason IS NULL AND read IS NULL THEN '' ELSE '- ' || concat_ws(' | ', reason, read) || {_NL} || {_NL} END
    || '![Frame ' || idx || ' @ ' || printf('%.2f', ts) || 's](' || CASE WHEN video_id % 2 = 0 THEN '../' ELSE '/out/' END || name || ')', {_NL} || {_NL} ORDER BY event_id) AS part FROM n GROUP BY 1
)
SELECT video_id, CASE WHEN video_id % 7 = 0 THEN '# R' || {_NL} || {_NL} || '## 关键截图' || {_NL} WHEN video_id % 9 = 0 THEN '# R ' || {_NL} ELSE '# R' || {_NL} || {_NL} || '## 关键截图' || {_NL} || {_NL} || part || {_NL} END AS markdown FROM b""",
    "keyframe_facts": f"""
WITH {EVENTS}, q AS (SELECT *, floor(ts / 900) * 0.25::DOUBLE AS t FROM e), f AS (SELECT video_id, event_id AS idx, t FROM q WHERE event_type = 'view')
SELECT f.video_id, f.idx, CASE WHEN f.idx % 3 > 0 THEN f.idx % 5 ELSE 0 END::INT AS n_segments, coalesce('click' || min(c.event_id) FILTER (c.event_type = 'click'), '') AS ocr_text, coalesce('error' || min(c.event_id) FILTER (c.event_type = 'error'), '') AS keep_reason
FROM f LEFT JOIN q c ON c.video_id = f.video_id AND abs(c.t - f.t) <= 0.3::DOUBLE GROUP BY 1, 2""",
    "frame_flags": """
WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: abs(v::DOUBLE)) AS x FROM embeddings),
p AS (SELECT *, x[5] * 2 >= 0.18::DOUBLE AND x[6] * 4 >= 0.35::DOUBLE AND x[7] * 5 >= 0.55::DOUBLE AND x[8] * 5 >= 0.55::DOUBLE AND x[9] * 400 <= 120 AS face FROM x)
SELECT vec_id, x[1] * 3 >= 0.92::DOUBLE OR (x[2] <= 0.08::DOUBLE AND x[3] / 4 <= 0.035::DOUBLE) OR (x[4] * 3 >= 0.97::DOUBLE AND x[3] / 4 <= 0.02::DOUBLE) AS transition_like, face AS presenter_like,
  CASE WHEN face THEN round(least(1.0::DOUBLE, 0.45::DOUBLE + x[5] * 2 * 1.2::DOUBLE + x[6] * 4 * 0.35::DOUBLE + x[7] * 5 * 0.2::DOUBLE), 4) ELSE 0 END AS confidence FROM p""",
    "nav_signals": """
WITH w AS (
  SELECT user_id AS video_id, (event_id % 8)::INT AS k, event_id, event_type AS label, value % 97 - 3 AS conf, (event_id % 900 + 30) / 1000 AS middle FROM events
), h AS (
  SELECT *, conf - abs(middle - CASE label WHEN 'view' THEN 0.1 WHEN 'click' THEN 0.35 WHEN 'purchase' THEN 0.6 ELSE 0.85 END::DOUBLE) * 220 AS score FROM w WHERE conf >= 0 AND label IN ('view', 'click', 'purchase', 'error')
), g AS (
  SELECT w.video_id, w.k, list_filter(['view', 'click', 'purchase', 'error'], lambda x: list_contains(coalesce(any_value(h.seen), []), x)) AS found FROM (SELECT DISTINCT video_id, k FROM w) w LEFT JOIN (SELECT video_id, k, list(DISTINCT label) AS seen FROM h GROUP BY 1, 2) h ON h.video_id = w.video_id AND h.k = w.k GROUP BY 1, 2
), m AS (
  SELECT *, [(k * 1) % 7 * 10 + 1, (k * 2) % 7 * 10 + 2, (k * 3) % 7 * 10 + 3, (k * 5) % 7 * 10 + 5] AS means, 40 + k * 2 < 45 AS dark FROM g
), z AS (SELECT *, NOT dark AND len(found) >= 3 AS present, list_position(means, list_min(means)) AS spot FROM m)
SELECT video_id, k AS frame_idx, CASE WHEN dark THEN '' WHEN present THEN 'view,click,purchase,error' ELSE array_to_string(found, ',') END AS labels, CASE WHEN dark THEN '' ELSE array_to_string(found, ',') END AS detected,
  CASE WHEN present THEN spot - 1 ELSE -1 END::INT AS active_index, CASE WHEN present THEN ['view', 'click', 'purchase', 'error'][spot] ELSE '' END AS active_label,
  CASE WHEN present THEN round(least(1.0::DOUBLE, 0.45::DOUBLE + (list_max(means) - list_min(means)) / 90.0::DOUBLE), 4) ELSE 0 END::DOUBLE AS confidence, present AS nav_present FROM z""",
    "region_boxes": f"""
WITH f AS (SELECT event_id, event_id % 1900 + 20 AS w, event_id % 1000 + 20 AS h FROM events WHERE event_type = 'purchase'),
r(region_no, region, l, t, r, b) AS (VALUES {", ".join(f"({i}, '{n}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for i, (n, a, b, c, d) in enumerate(rules.REGIONS))})
SELECT event_id, region_no::INT AS region_no, region, trunc(w * l)::INT AS "left", trunc(h * t)::INT AS top, trunc(w * r)::INT AS "right", trunc(h * b)::INT AS bottom FROM f CROSS JOIN r""",
    "ocr_languages": """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND (doc_id % 2 = 0 OR lang = 'eng') THEN 'chi_sim+eng' WHEN doc_id % 3 = 0 THEN 'chi_sim' WHEN doc_id % 2 = 0 THEN 'eng' ELSE 'chi_sim+eng' END AS languages, 'openclaw浣跨敤' AS label FROM documents""",
}
