"""DuckDB SQL with the same rows as the queries over the derived detections."""

from __future__ import annotations

from ..functions.labels import LABELS, UNKNOWN
from ..sources.detections import detections_sql
from .queries import ENDINGS, MAX_PAGES

_F = "CAST({} AS FLOAT)".format
_NAMES = "[" + ", ".join(f"'{n}'" for n, _ in LABELS) + "]"
_CLASS = "CASE WHEN class_value < 0 THEN 0 ELSE CAST(trunc(class_value) AS BIGINT) END"
_LABEL = f"coalesce({_NAMES}[({_CLASS}) + 1], '{UNKNOWN[0]}')"
_COLOR = "CASE label " + " ".join(f"WHEN '{n}' THEN '{c}'" for n, c in LABELS) + f" ELSE '{UNKNOWN[1]}' END"


def _clamped(v: str, high: str) -> str:
    return f"least(greatest({v}, {_F(0)}), {_F(high)})"


_BOX = (
    f"{_clamped('x1', 'width')} AS x, {_clamped('y1', 'height')} AS y, "
    f"greatest({_clamped('x2', 'width')} - {_clamped('x1', 'width')}, {_F(0)}) AS w, greatest({_clamped('y2', 'height')} - {_clamped('y1', 'height')}, {_F(0)}) AS h"
)
_DET = f"det AS ({detections_sql()})"
_DEC = f"{_DET}, dec AS (SELECT page_id, row_index, {_LABEL} AS label, score, {_BOX}, CAST(order_value AS BIGINT) AS ord, width, height FROM det WHERE NOT (score < {_F(0.2)}))"


def _inter(a: str, b: str) -> str:
    side = lambda p, d: f"greatest(least({a}.{p} + {a}.{d}, {b}.{p} + {b}.{d}) - greatest({a}.{p}, {b}.{p}), {_F(0)})"
    return f"({side('x', 'w')} * {side('y', 'h')})"


def _min_area(a: str, b: str) -> str:
    return f"least({a}.w * {a}.h, {b}.w * {b}.h)"


def _union(a: str, b: str) -> str:
    return f"({a}.w * {a}.h + {b}.w * {b}.h - {_inter(a, b)})"


def _iou(a: str, b: str) -> str:
    return f"(CASE WHEN {_union(a, b)} <= 0 THEN {_F(0)} ELSE {_inter(a, b)} / {_union(a, b)} END)"


def _score(a: str, b: str) -> str:
    return f"greatest({_iou(a, b)}, CASE WHEN {_min_area(a, b)} <= 0 THEN {_F(0)} ELSE {_inter(a, b)} / {_min_area(a, b)} END)"


def _relabelled(nms: float) -> str:
    return f"""rel AS (
  SELECT d.* REPLACE (CASE WHEN d.label = 'Text' AND EXISTS (SELECT 1 FROM dec r WHERE r.page_id = d.page_id AND r.label = 'Reference' AND {_score('r', 'd')} > {_F(nms)})
    THEN 'ReferenceContent' ELSE d.label END AS label) FROM dec d)"""


def _kept(source: str, nms: float, cross: float) -> str:
    """Greedy suppression: a recursion over ranks that carries the kept blocks of each page."""
    return f"""ranked AS (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, row_index) AS rk FROM {source}
), bl AS (
  SELECT page_id, rk, struct_pack(row_index := row_index, label := label, score := score, x := x, y := y, w := w, h := h, ord := ord) AS s FROM ranked
), steps AS (
  SELECT page_id, rk, [s] AS kept FROM bl WHERE rk = 1
  UNION ALL
  SELECT b.page_id, b.rk, CASE WHEN len(list_filter(t.kept, lambda k: CASE WHEN k.label = b.s.label THEN {_score('k', 'b.s')} > {_F(nms)} ELSE {_iou('k', 'b.s')} > {_F(cross)} END)) > 0
    THEN t.kept ELSE list_append(t.kept, b.s) END
  FROM steps t JOIN bl b ON b.page_id = t.page_id AND b.rk = t.rk + 1
), last AS (SELECT page_id, arg_max(kept, rk) AS kept FROM steps GROUP BY page_id),
kept AS (SELECT page_id, unnest(kept) AS s, CAST(generate_subscripts(kept, 1) - 1 AS BIGINT) AS pos FROM last)"""


def _suppressed(source: str, extra: str, nms: float, cross: float) -> str:
    return f"WITH RECURSIVE {_DEC}{extra}, {_kept(source, nms, cross)} SELECT page_id, pos, s.row_index AS row_index, s.label AS label, s.score AS score FROM kept"


_FINAL = f"WITH RECURSIVE {_DEC}, {_relabelled(0.5)}, {_kept('rel', 0.5, 0.9)}"
_LAYOUT = f"""{_FINAL} SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY coalesce(s.ord, 9223372036854775807), s.score DESC, s.row_index) - 1 AS BIGINT) AS pos,
  s.row_index AS row_index, s.label AS label, s.score AS score, s.x AS x, s.y AS y, s.w AS w, s.h AS h, s.ord AS ord FROM kept"""
_PAIRS = f"WITH {_DEC} SELECT a.page_id AS page_id, a.row_index AS left_row, b.row_index AS right_row, {{}} FROM dec a JOIN dec b ON a.page_id = b.page_id AND a.row_index < b.row_index"
_INDEXED = "indexed AS (SELECT user_id AS doc_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS page_index FROM events)"
_NAMED = f"named AS (SELECT page_id, 'file' || page_id || ({list(ENDINGS)})[page_id % 6 + 1] AS name FROM pages)"
_RANK = "CASE WHEN ord IS NOT NULL THEN CAST(dense_rank() OVER (PARTITION BY page_id, ord IS NULL ORDER BY ord) - 1 AS BIGINT) END"


def _unit(n: int) -> str:
    return f"CAST((event_id % {n} - 1) / 4 AS FLOAT)"


def _bad(v: str) -> str:
    return f"({v} < 0 OR {v} > 1)"


_TAG = "greatest(18, CAST(floor(width / 45 + 0.5) AS BIGINT))"
_SHADE = "list_sum(list_transform(string_split(url, ''), lambda c: ascii(c))) % 256"
_SHADE_SCORE = f"round(0.5 + CAST({_SHADE} AS DOUBLE) / 255 / 2, 3)"

ORACLES = {
    "page_layout": _LAYOUT,
    "score_filter": f"WITH {_DEC} SELECT page_id, row_index, score FROM dec",
    "label_decode": f"WITH {_DET} SELECT page_id, row_index, class_value, {_LABEL} AS label FROM det",
    "label_color": f"WITH {_DET}, l AS (SELECT page_id, row_index, {_LABEL} AS label FROM det) SELECT *, {_COLOR} AS color FROM l",
    "label_parse": f"""WITH {_DET}, l AS (SELECT page_id, row_index, {_LABEL} AS label FROM det),
  n AS (SELECT page_id, row_index, CASE row_index % 3 WHEN 0 THEN label WHEN 1 THEN lower(label) ELSE label || 's' END AS name FROM l)
  SELECT *, CASE WHEN name = '{UNKNOWN[0]}' OR list_contains({_NAMES}, name) THEN name END AS parsed FROM n""",
    "order_decode": f"WITH {_DET} SELECT page_id, row_index, CAST(trunc(order_value) AS BIGINT) AS ord FROM det",
    "box_clamp": f"WITH {_DET} SELECT page_id, row_index, {_BOX} FROM det",
    "overlap_metrics": _PAIRS.format(f"{_inter('a', 'b')} AS intersection, {_min_area('a', 'b')} AS min_area, {_union('a', 'b')} AS union_area"),
    "iou_pairs": f"SELECT * FROM ({_PAIRS.format(_iou('a', 'b') + ' AS iou')}) WHERE iou > 0",
    "overlap_pairs": f"SELECT * FROM ({_PAIRS.format(_score('a', 'b') + ' AS overlap')}) WHERE overlap > {_F(0.5)}",
    "relabel_reference": f"WITH {_DEC}, {_relabelled(0.5)} SELECT page_id, row_index, label FROM rel",
    "nms_same_label": _suppressed("dec", "", 0.5, 1.0),
    "nms_cross_label": _suppressed("dec", "", 1.0, 0.9),
    "suppress": _suppressed("rel", f", {_relabelled(0.5)}", 0.5, 0.9),
    "reading_order": f"""WITH {_DEC} SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY coalesce(ord, 9223372036854775807), score DESC, row_index) - 1 AS BIGINT) AS pos,
  row_index, score, ord FROM dec""",
    "unnest_rows": f"""WITH {_DET} SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY row_index) - 1 AS BIGINT) AS row_index,
  class_value, score, x1, y1, x2, y2, order_value FROM det""",
    "batch_split": f"""WITH {_DET}, p AS (SELECT *, CASE WHEN order_value IS NULL THEN 6 ELSE 7 END AS columns, page_id // 4 AS batch_id FROM det)
  SELECT batch_id, CAST(dense_rank() OVER (PARTITION BY columns, batch_id ORDER BY page_id) - 1 AS BIGINT) AS image_index, width, height, columns,
  CAST(row_number() OVER (PARTITION BY page_id ORDER BY row_index) - 1 AS BIGINT) AS row_index, class_value, score, x1, y1, x2, y2, order_value FROM p""",
    "batch_assign": f"WITH {_INDEXED} SELECT doc_id, page_index, page_index // 4 AS batch, page_index % 4 AS slot FROM indexed",
    "page_limit": f"WITH {_INDEXED} SELECT doc_id, event_id, page_index FROM indexed WHERE page_index < {MAX_PAGES}",
    "validate_rows": f"""SELECT event_id, CASE WHEN event_id % 9 < 6 THEN 'fetch rows must contain at least 6 columns'
  WHEN (event_id % 9 * 3 + event_id // 9 % 2) % (event_id % 9) <> 0 THEN 'fetch row value count must be divisible by columns'
  WHEN {_bad(_unit(7))} THEN 'threshold must be between 0 and 1' WHEN {_bad(_unit(11))} THEN 'nms_iou_threshold must be between 0 and 1'
  WHEN {_bad(_unit(13))} THEN 'cross_label_iou_threshold must be between 0 and 1' END AS verdict FROM events""",
    "row_counts_valid": "SELECT event_id, CASE WHEN event_id % 7 < 0 OR event_id % 5 - 1 < 0 THEN 'model output contains an invalid row count' END AS verdict FROM events",
    "run_totals": f"""{_FINAL}, r AS (SELECT page_id % 10 AS run_id, count(*) AS rows, count(DISTINCT page_id) AS pages FROM det GROUP BY 1),
  b AS (SELECT page_id % 10 AS run_id, count(*) AS total_blocks FROM kept GROUP BY 1)
  SELECT run_id, pages, coalesce(total_blocks, 0) AS total_blocks, rows FROM r LEFT JOIN b USING (run_id)""",
    "order_rank": f"WITH {_DEC} SELECT page_id, row_index, ord, {_RANK} AS rank FROM dec",
    "display_label": f"""WITH {_DEC}, k AS (SELECT *, {_RANK} AS rank FROM dec)
  SELECT page_id, row_index, coalesce(rank || ' · ', '') || label || ' ' || printf('%.3f', CAST(CAST(score AS VARCHAR) AS DOUBLE)) AS display FROM k""",
    "draw_plan": f"""WITH {_DEC} SELECT page_id, row_index, greatest(2, CAST(floor(width / 500 + 0.5) AS BIGINT)) AS line_width, greatest(12, CAST(floor(width / 60 + 0.5) AS BIGINT)) AS font_px,
  {_TAG} AS tag_height, greatest(0, CAST(y AS DOUBLE) - {_TAG}) AS tag_y, CAST(x AS DOUBLE) + 4 AS text_x, greatest(0, CAST(y AS DOUBLE) - {_TAG}) + 2 AS text_y, 0.12::DOUBLE AS fill_alpha FROM dec""",
    "progress": """WITH e AS (SELECT event_id, event_id % 120 - 10 AS done, user_id % 100 AS total FROM events)
  SELECT event_id, done, total, CASE WHEN total <= 0 THEN 0 ELSE CAST(floor(least(greatest(done, 0), total) / total * 100 + 0.5) AS BIGINT) END AS percent FROM e""",
    "elapsed": "WITH e AS (SELECT event_id, event_id * 37 % 100000 AS ms FROM events) SELECT event_id, ms, ((ms + 50) // 1000) || '.' || ((ms + 50) // 100 % 10) || 's' AS elapsed FROM e",
    "page_caption": f"{_FINAL} SELECT page_id, 'page-' || page_id || ' · ' || count(*) || ' blocks' AS caption FROM kept GROUP BY page_id",
    "page_source": f"WITH {_INDEXED} SELECT doc_id, page_index, 'doc-' || doc_id || '.pdf#page=' || (page_index + 1) AS source FROM indexed",
    "json_roundtrip": f"""WITH l AS ({_LAYOUT}), {_DET}, p AS (SELECT DISTINCT page_id, width, height FROM det)
  SELECT page_id, width, height, pos, label, score, x, y, w, h, ord FROM l JOIN p USING (page_id)""",
    "page_json": f"""WITH l AS ({_LAYOUT}), {_DET}, p AS (SELECT DISTINCT page_id, width, height FROM det),
  b AS (SELECT page_id, string_agg('{{"label":"' || label || '","score":' || CAST(score AS VARCHAR) || ',"bbox":{{"x":' || CAST(x AS VARCHAR) || ',"y":' || CAST(y AS VARCHAR) || ',"width":' || CAST(w AS VARCHAR)
    || ',"height":' || CAST(h AS VARCHAR) || '}},"order":' || coalesce(CAST(ord AS VARCHAR), 'null') || '}}', ',' ORDER BY pos) AS blocks FROM l GROUP BY page_id)
  SELECT page_id, '{{"width":' || width || ',"height":' || height || ',"blocks":[' || blocks || ']}}' AS json FROM b JOIN p USING (page_id)""",
    "im_shape": f"WITH {_DET} SELECT DISTINCT page_id, {_F(60)} AS target_h, {_F(80)} AS target_w FROM det",
    "scale_factor": f"WITH {_DET} SELECT DISTINCT page_id, {_F(60)} / {_F('height // 100')} AS scale_h, {_F(80)} / {_F('width // 100')} AS scale_w FROM det",
    "is_pdf": f"WITH {_NAMED} SELECT page_id, name, regexp_matches(lower(name), '[^/]\\.pdf$') AS is_pdf FROM named",
    "file_kind": f"""WITH {_NAMED} SELECT page_id, name, CASE WHEN page_id % 5 = 0 OR regexp_matches(lower(name), '\\.(png|jpe?g|webp)$') THEN 'image'
  WHEN page_id % 7 = 0 OR lower(name) LIKE '%.pdf' THEN 'pdf' END AS kind FROM named""",
    "load_pages": f"SELECT url AS path, unnest(range(least(strlen(url), {MAX_PAGES}))) AS page_index, 8 AS width, 6 AS height FROM pages",
    "detect_pages": f"SELECT url AS path, 2::BIGINT AS n_blocks, 'Table,Text' AS labels, {_SHADE_SCORE} AS score FROM pages",
    "png_pages": f"SELECT url AS path, 8 AS width, 6 AS height, CAST({_SHADE} AS BIGINT) AS shade FROM pages",
    "image_form": "SELECT 0 AS page_index, CAST(page_id % 5 + 1 AS INT) AS width, 2 AS height, regexp_extract(url, '[^/]*$') AS source FROM pages",
    "image_json": f"SELECT url AS path, CAST(page_id % 5 + 1 AS INT) AS width, 2 AS height, 2::BIGINT AS n_blocks, {_SHADE_SCORE} AS score FROM pages",
    "image_json_batch": "SELECT page_id // 4 AS batch_id, string_agg(CAST(page_id % 5 + 1 AS VARCHAR), ',' ORDER BY page_id) AS widths FROM pages GROUP BY 1",
}
