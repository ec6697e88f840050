"""Queries of the layout operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetgraph.functions.rx import matches  # noqa: F401
from sheetgraph.operators import layout as o
from sheetgraph.plans.folds import ASSEMBLE, ASSEMBLED, PADS, PIN_EP, final_figures
from sheetgraph.plans.registry import query


def _q(p: str) -> str:
    return p.replace("'", "''")


_KIND = " ".join(f"WHEN regexp_matches(title, '{_q(p)}') THEN '{n}'" for n, p in o.FIGURE_KINDS)
_TYPE = " ".join(f"WHEN regexp_matches(upper(token), '{p}') THEN '{n}'" for n, p in o.TYPE_NAMES)
_X = lambda p, k: f"regexp_extract(text, '{_q(p)}', {k})"
V = {
    "items": "SELECT doc_id, page, line_no * 1000 + token_no AS item_no, str, CAST(60 + 40 * token_no AS DOUBLE) AS x, y - (token_no % 3) AS y, CAST(6 * "
        "length(str) AS DOUBLE) AS w, CAST(CASE WHEN token_no % 7 = 0 THEN 0 WHEN token_no % 5 = 0 THEN -9 ELSE 9 END AS DOUBLE) AS h FROM tokens",
    "region": "SELECT doc_id, page, line_no, text, CASE WHEN regexp_matches(text, '\\bPIN\\b|\\bNAME\\b') AND regexp_matches(text, '(?i)I/O|TYPE') THEN "
        "'head' ELSE 'row' END AS part FROM (SELECT *, last_value(ev IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED "
        f"PRECEDING AND 1 PRECEDING) AS st FROM (SELECT *, CASE WHEN regexp_matches(text, '(?i){_q(o.STOP)}') THEN 0 WHEN regexp_matches(text, "
        f"'(?i){_q(o.HEAD)}') OR (regexp_matches(text, '\\bPIN\\b') AND regexp_matches(text, '(?i)\\b(DESCRIPTION|FUNCTION)\\b')) THEN 1 END AS ev "
        "FROM lines)) WHERE st = 1 AND ev IS DISTINCT FROM 0",
    "two": f"SELECT *, {_X(o.ROW_TWO, 1)} AS name, {_X(o.ROW_TWO, 4)} AS token, {_X(o.ROW_TWO, 5)} AS rest FROM region WHERE part = 'row' AND "
        f"regexp_matches(text, '{_q(o.ROW_TWO)}')",
    "one": f"SELECT *, regexp_matches(text, '{_q(o.ROW_NAME_FIRST)}') AS nf FROM region WHERE part = 'row' AND NOT regexp_matches(text, "
        f"'{_q(o.ROW_TWO)}') AND (regexp_matches(text, '{_q(o.ROW_NAME_FIRST)}') OR regexp_matches(text, '{_q(o.ROW_NUMBER_FIRST)}'))",
    "found": f"SELECT doc_id, line_no, 'A' AS \"set\", {_X(o.ROW_TWO, 2)} AS number, name, token, rest FROM two UNION ALL SELECT doc_id, line_no, 'B', "
        f"{_X(o.ROW_TWO, 3)}, name, token, rest FROM two UNION ALL SELECT doc_id, line_no, 'A', CASE WHEN nf THEN {_X(o.ROW_NAME_FIRST, 2)} ELSE "
        f"{_X(o.ROW_NUMBER_FIRST, 1)} END, CASE WHEN nf THEN {_X(o.ROW_NAME_FIRST, 1)} ELSE {_X(o.ROW_NUMBER_FIRST, 2)} END, CASE WHEN nf THEN "
        f"{_X(o.ROW_NAME_FIRST, 3)} ELSE {_X(o.ROW_NUMBER_FIRST, 3)} END, CASE WHEN nf THEN {_X(o.ROW_NAME_FIRST, 4)} ELSE {_X(o.ROW_NUMBER_FIRST, 4)} "
        "END FROM one",
    "prows": f"SELECT doc_id, line_no, \"set\", number, name, CASE WHEN regexp_matches(name, '(?i){_q(o.POWER_PIN)}') THEN 'power_in' ELSE CASE {_TYPE} "
        "ELSE 'unspecified' END END AS type, substr(trim(rest), 1, 160) AS description FROM found",
    "pfirst": "SELECT * FROM prows QUALIFY row_number() OVER (PARTITION BY doc_id, \"set\", number ORDER BY line_no) = 1",
    "titled": f"SELECT *, regexp_matches(text, '(?i){_q(o.FIGURE)}') AS caption, trim(CASE WHEN regexp_matches(text, '(?i){_q(o.FIGURE)}') THEN "
        f"regexp_extract(text, '(?i){_q(o.FIGURE)}', 2) ELSE text END) AS title FROM lines",
    "kinded": f"SELECT *, CASE {_KIND} END AS k FROM titled",
    "figs": "SELECT doc_id, page, line_no, y, title, caption, k AS kind FROM kinded WHERE k IS NOT NULL AND CASE WHEN caption THEN NOT "
        f"regexp_matches(title, '{_q(o.CURVE)}') ELSE length(text) < 60 AND NOT regexp_matches(text, '{_q(o.POINTER)}') AND k <> 'pin_configuration' "
        f"AND (k <> 'application' OR regexp_matches(text, '{_q(o.BARE_APPLICATION)}')) END",
    "relpages": f"SELECT doc_id, page FROM lines GROUP BY 1, 2 HAVING page = 1 OR bool_or(regexp_matches(text, '{_q(o.PIN_PAGE)}') OR (regexp_matches(text, "
        f"'\\bPIN\\b') AND regexp_matches(text, '(?i)\\bDESCRIPTION\\b')) OR regexp_matches(text, '{_q(o.MECHANICAL_PAGE)}')) UNION SELECT doc_id, "
        "page FROM figs",
    "rfig": "SELECT doc_id, line_no AS fig_no, CASE WHEN line_no % 5 = 0 THEN NULL ELSE 'application' END AS kind, CAST((doc_id * 7 + line_no) % 130 - 10 "
        "AS DOUBLE) / 100.0 AS x0, CAST((doc_id * 11 + line_no * 3) % 100 AS DOUBLE) / 100.0 AS y0, CAST((doc_id * 13 + line_no * 5) % 120 AS DOUBLE) "
        "/ 100.0 AS x1, CAST((doc_id * 11 + line_no * 3 + line_no % 3) % 100 AS DOUBLE) / 100.0 AS y1 FROM lines",
}


def _items(t):
    return t.tokens.selectExpr("doc_id", "page", "line_no * 1000 + token_no AS item_no", "str", "CAST(60 + 40 * token_no AS DOUBLE) AS x", "y - (token_no % 3) AS y", "CAST(6 * length(str) AS DOUBLE) AS w", "CAST(CASE WHEN token_no % 7 = 0 THEN 0 WHEN token_no % 5 = 0 THEN -9 ELSE 9 END AS DOUBLE) AS h")


def _rfig(t):
    return t.lines.selectExpr(
        "doc_id", "line_no AS fig_no", "CASE WHEN line_no % 5 = 0 THEN NULL ELSE 'application' END AS kind", "CAST((doc_id * 7 + line_no) % 130 - 10 AS DOUBLE) / 100.0D AS x0", "CAST((doc_id * 11 + line_no * 3) % 100 AS DOUBLE) / 100.0D AS y0",
        "CAST((doc_id * 13 + line_no * 5) % 120 AS DOUBLE) / 100.0D AS x1", "CAST((doc_id * 11 + line_no * 3 + line_no % 3) % 100 AS DOUBLE) / 100.0D AS y1",
    )


query("load_items", "SELECT doc_id, page, item_no, str, x, y, x + w AS x1, coalesce(nullif(abs(h), 0), 8.0) AS h FROM items WHERE page <= 3 AND trim(str) <> ''", V)(lambda t: o.load_items(_items(t), 3))
query("normalize_parser", "SELECT doc_id, CAST(greatest(1, floor(coalesce(CASE WHEN line_no % 9 = 0 THEN NULL ELSE line_no / 4.0 - 2 END, 1.0) + 0.5)) AS BIGINT) AS "
    "page, text AS str, coalesce(CASE WHEN line_no % 4 = 0 THEN NULL ELSE 60.0 END, 0.0)::DOUBLE AS x, y FROM lines")(
    lambda t: o.normalize_parser(t.lines.selectExpr("doc_id", "CASE WHEN line_no % 9 = 0 THEN NULL ELSE line_no / 4.0D - 2 END AS page", "text AS str", "CASE WHEN line_no % 4 = 0 THEN NULL ELSE 60.0D END AS x", "y"))
)
query("assemble_lines", ASSEMBLE, V | ASSEMBLED)(lambda t: o.assemble_lines(o.load_items(_items(t))))
query("clean_line_text", r"SELECT doc_id, line_no, trim(regexp_replace(text, '\s{3,}', '  ', 'g'), ' ') AS text FROM lines")(lambda t: t.lines.select("doc_id", "line_no", o.clean_line_text(F.col("text")).alias("text")))
query("sparse_pages", "SELECT doc_id, count(*) AS n_lines, count(*) <= 20 AS needs_ocr FROM lines GROUP BY 1")(lambda t: o.sparse_pages(t.lines))
query(
    "ocr_merge",
    "SELECT *, status IN ('failed', 'pending_no_worker') AS must_keep FROM (SELECT coalesce(a.doc_id, w.doc_id) AS doc_id, coalesce(a.page, w.page) AS page, coalesce(a.n, 0) AS n_lines,"
    " CASE WHEN w.page IS NULL THEN 'not_needed' WHEN a.m > 0 THEN 'done' WHEN w.page % 2 = 0 THEN 'failed' ELSE 'pending_no_worker' END AS status"
    " FROM (SELECT doc_id, page, count(*) AS n, count(*) FILTER (line_no % 5 = 0) AS m FROM lines GROUP BY 1, 2) a"
    " FULL JOIN (SELECT DISTINCT doc_id, page + 1 AS page FROM lines WHERE doc_id % 2 = 0) w ON a.doc_id = w.doc_id AND a.page = w.page)",
)(lambda t: o.ocr_merge(t.lines.where("line_no % 5 <> 0"), t.lines.where("line_no % 5 = 0"), t.lines.where("doc_id % 2 = 0").selectExpr("doc_id", "page + 1 AS page", "(page + 1) % 2 = 0 AS failed")))
_UP = (
    "CASE WHEN (doc_id + line_no) % 9 = 0 THEN 'ADM8829, ADM8828' WHEN (doc_id + line_no) % 7 = 0 THEN 'A precise low power switch for ' || "
        "line_no::VARCHAR || ' channels'"
    " WHEN (doc_id + line_no) % 31 = 0 THEN 'made by onsemi and NXP' WHEN (doc_id + line_no) % 29 = 0 THEN 'Texas Instruments' ELSE text END"
)
_LINK = "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'https://parts.example/lit/ds' || CAST(doc_id AS VARCHAR(20)) || 'x.PDF' WHEN 1 THEN 'https://parts.example/a.pdf' WHEN 2 THEN 'https://parts.example/' END AS url FROM documents"
query(
    "part_info",
    f"""SELECT l.doc_id, coalesce(nullif(upper(regexp_extract(k.url, '(?i)([A-Za-z][A-Za-z0-9\\-]{{4,}})\\.pdf', 1)), ''), m, '') AS mpn, coalesce(ti, '') AS title, regexp_extract(whole, '{o.VENDORS}', 1) AS manufacturer FROM (
      SELECT doc_id, arg_min(m, line_no) FILTER (m IS NOT NULL) AS m, arg_min(ti, line_no) FILTER (ti IS NOT NULL) AS ti, string_agg(text, ' ' ORDER BY line_no) AS whole FROM (
        SELECT *, CASE WHEN y > 792 * 0.55 AND regexp_matches(text, '{_q(o.PART_LINE)}') THEN regexp_extract(text, '^[^\\s,]+', 0) END AS m,
          CASE WHEN y > 792 * 0.55 AND length(text) > 25 AND length(text) < 160 AND regexp_matches(text, '{_q(o.CATEGORY)}') THEN text END AS ti
        FROM (SELECT doc_id, page, line_no, y, {_UP} AS text FROM lines) WHERE page = 1) GROUP BY 1) l LEFT JOIN links k ON k.doc_id = l.doc_id""",
    {"links": _LINK},
)(lambda t: o.part_info(t.lines.withColumn("text", F.expr(_UP.replace("::VARCHAR", ""))), t.documents.selectExpr("doc_id", _LINK.removeprefix("SELECT doc_id, ").removesuffix(" FROM documents"))))
query("pin_region", "SELECT * FROM region", V)(lambda t: o.pin_region(t.lines))
query("pin_rows", "SELECT * FROM prows", V)(lambda t: o.pin_rows(o.pin_region(t.lines)))
query("pin_column_labels", f"SELECT doc_id, arg_max(trim(regexp_extract(text, '(?i){_q(o.COLUMNS)}', 1)), line_no) AS label_a, arg_max(trim(regexp_extract(text, "
    f"'(?i){_q(o.COLUMNS)}', 2)), line_no) AS label_b FROM region WHERE part = 'head' AND regexp_matches(text, '(?i){_q(o.COLUMNS)}') GROUP BY 1", V)(lambda t: o.pin_column_labels(o.pin_region(t.lines)))
query("pin_first_wins", "SELECT * FROM pfirst", V)(lambda t: o.pin_first_wins(o.pin_rows(o.pin_region(t.lines))))
query("pin_ep_rows", PIN_EP, V | PADS)(lambda t: o.pin_ep_rows(o.pin_region(t.lines), o.pin_first_wins(o.pin_rows(o.pin_region(t.lines)))))
query("pin_confidence", 'SELECT doc_id, "set", n, CASE WHEN top > 0 THEN numbered / top ELSE 0 END AS coverage, CASE WHEN n >= 4 AND top >= 6 AND numbered / top >= '
    '0.8 AND low = 1 THEN \'high\' ELSE \'low\' END AS confidence FROM (SELECT doc_id, "set", count(*) AS n, count(try_cast(number AS INT)) AS '
    'numbered, max(try_cast(number AS INT)) AS top, min(try_cast(number AS INT)) AS low FROM pfirst GROUP BY 1, 2)', V)(
    lambda t: o.pin_confidence(o.pin_first_wins(o.pin_rows(o.pin_region(t.lines))))
)
query("pin_order", 'SELECT doc_id, "set", number, row_number() OVER (PARTITION BY doc_id, "set" ORDER BY try_cast(number AS INT) IS NULL, try_cast(number AS '
    'INT), regexp_extract(number, \'^(\\D*)\', 1), try_cast(regexp_extract(number, \'^\\D*(\\d+)\', 1) AS INT), number) AS place FROM pfirst', V)(lambda t: o.pin_order(o.pin_first_wins(o.pin_rows(o.pin_region(t.lines)))))
query("assign_pinsets", "SELECT package_id, CASE WHEN type LIKE 'SOIC%' OR type = 'PDIP' THEN 1 WHEN type IN ('DSBGA', 'VQFN') THEN 2 ELSE 0 END AS set_no FROM "
    "packages")(
    lambda t: o.assign_pinsets(t.packages, t.spark.createDataFrame([(0, "D, PW"), (1, "SOIC, PDIP"), (2, "DSBGA VQFN/SOIC")], "set_no int, label string"))
)
query("figure_candidates", "SELECT * FROM figs", V)(lambda t: o.figure_candidates(t.lines))
_LONG = "length(text) > 60 OR regexp_matches(text, '^\\d+(\\.\\d+)*\\s+[A-Z]')"
_BEFORE = "OVER (PARTITION BY doc_id, page ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_REGION = f"""
SELECT l.doc_id, l.page, l.line_no, 1 - CASE WHEN f.caption THEN CASE WHEN above - l.y <= 396 THEN above - 10.8 ELSE up END
    WHEN l.y < 435.6 THEN CASE WHEN above_long - l.y <= 396 THEN least(up, above_long - 10.8) ELSE up END ELSE l.y - 3.6 END / 792 AS y0,
  least(0.98, 1 - CASE WHEN f.caption OR l.y < 435.6 THEN l.y - 14.4 WHEN l.y - below_long <= 396 THEN below_long + 5.4 ELSE greatest(47.52, l.y - 356.4) END / 792) AS y1
FROM (SELECT *, least(744.48, y + 356.4) AS up, last_value(CASE WHEN {_LONG} OR regexp_matches(text, '(?i)^Figure\\s+\\d+') THEN y END IGNORE NULLS) {_BEFORE} AS above,
    last_value(CASE WHEN {_LONG} THEN y END IGNORE NULLS) {_BEFORE} AS above_long,
    first_value(CASE WHEN {_LONG} THEN y END IGNORE NULLS) OVER (PARTITION BY doc_id, page ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS below_long FROM lines) l
JOIN figs f ON f.doc_id = l.doc_id AND f.line_no = l.line_no
"""
query("figure_region", _REGION, V)(lambda t: o.figure_region(t.lines))
_FINAL, _FINAL_VIEWS = final_figures(_REGION)
query("figure_finalize", _FINAL, V | _FINAL_VIEWS)(lambda t: o.figure_finalize(o.figure_region(t.lines).join(o.figure_candidates(t.lines).select("doc_id", "line_no", "kind"), ["doc_id", "line_no"])))
query("figure_sanitize", "SELECT doc_id, fig_no, coalesce(kind, 'other') AS kind, a AS x0, b AS y0, CASE WHEN c - a < 0.01 THEN least(1.0, a + 0.05) ELSE c END AS x1, "
    "CASE WHEN d - b < 0.01 THEN least(1.0, b + 0.05) ELSE d END AS y1 FROM (SELECT doc_id, fig_no, kind, least(p, r) AS a, least(q, s) AS b, "
    "greatest(p, r) AS c, greatest(q, s) AS d FROM (SELECT doc_id, fig_no, kind, least(1.0, greatest(0.0, x0)) AS p, least(1.0, greatest(0.0, "
    "y0)) AS q, least(1.0, greatest(0.0, x1)) AS r, least(1.0, greatest(0.0, y1)) AS s FROM rfig)) QUALIFY row_number() OVER (PARTITION BY doc_id "
    "ORDER BY fig_no) <= 12", V)(
    lambda t: o.figure_sanitize(_rfig(t))
)
query("relevant_pages", "SELECT * FROM relpages", V)(lambda t: o.relevant_pages(t.lines, o.figure_candidates(t.lines)))
# Pages of every fourth document wait for recognition, in every 16th all of them; in every third nothing is relevant
_OCR = "doc_id % 4 = 1 AND (page % 3 = 2 OR doc_id % 16 = 5)"
query(
    "page_strategy",
    "SELECT doc_id, page, strategy || CASE WHEN n_keep > 0 AND n_picked > 0 THEN '+ocr_must_keep' ELSE '' END AS strategy, n_sent > 0 AND n_sent < n * 0.7 AS sliced FROM ("
    "SELECT *, count(*) FILTER (picked OR (keep AND n_picked > 0)) OVER d AS n_sent, picked OR (keep AND n_picked > 0) AS sent FROM (SELECT *, count(*) FILTER (picked) OVER d AS n_picked FROM ("
    "SELECT *, CASE strategy WHEN 'parser_relevant_pages' THEN rel WHEN 'keyword_pages' THEN (page = 1 OR key) AND k <= 20 WHEN 'first_plus_text_tail' THEN page = 1 OR (txt AND t <= 8) ELSE FALSE END AS picked FROM ("
    "SELECT *, CASE WHEN count(*) FILTER (rel) OVER d > 0 THEN 'parser_relevant_pages' WHEN count(*) FILTER (key) OVER d > 0 THEN 'keyword_pages' WHEN count(*) FILTER (txt) OVER d > 0 THEN 'first_plus_text_tail'"
    " WHEN count(*) FILTER (ocr) OVER d > 0 THEN 'scanned_no_ocr_worker' ELSE 'none' END AS strategy, count(*) OVER d AS n, count(*) FILTER (keep) OVER d AS n_keep,"
    " count(*) FILTER (page = 1 OR key) OVER (PARTITION BY doc_id ORDER BY page) AS k, count(*) FILTER (txt) OVER (PARTITION BY doc_id ORDER BY page DESC) AS t FROM ("
    f"SELECT doc_id, page, {_OCR} AS ocr, {_OCR} AND doc_id % 8 = 1 AS keep, bool_or(trim(text) <> '') AND NOT ({_OCR}) AS txt, bool_or(regexp_matches(text, '{_q(o.KEY_PAGE)}')) AND NOT ({_OCR}) AS key,"
    " doc_id % 3 <> 0 AND EXISTS (SELECT 1 FROM figs f WHERE f.doc_id = l.doc_id AND f.page = l.page) AS rel FROM lines l GROUP BY doc_id, page) WINDOW d AS (PARTITION BY doc_id)))"
    " WINDOW d AS (PARTITION BY doc_id)) WINDOW d AS (PARTITION BY doc_id)) WHERE sent OR NOT (n_sent > 0 AND n_sent < n * 0.7)",
    V,
)(lambda t: o.page_strategy(t.lines, o.figure_candidates(t.lines).where("doc_id % 3 <> 0"), t.lines.where(_OCR).selectExpr("doc_id", "page", "doc_id % 8 = 1 AS must_keep").distinct()))
query("remap_pages", "SELECT f.doc_id, f.line_no, m.p AS page FROM figs f JOIN (SELECT doc_id, page AS p, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS "
    "s FROM relpages WHERE page <> 1) m ON m.doc_id = f.doc_id AND m.s = f.page", V)(
    lambda t: o.remap_pages(o.figure_candidates(t.lines), o.relevant_pages(t.lines, o.figure_candidates(t.lines)).where("page <> 1").selectExpr("doc_id", "page AS original", "row_number() OVER (PARTITION BY doc_id ORDER BY page) AS sliced"))
)
_GRAMS = lambda s: f"list_distinct(list_transform(range(1, length({s})), lambda i: substr({s}, i, 2)))"
_PLAIN = lambda c: f"regexp_replace(lower(translate(coalesce({c}, ''), '" + o.FULL_WIDTH + "', '" + o.HALF_WIDTH.replace("'", "''") + "')), '" + o.NO_WORD.replace("'", "''") + "', '', 'g')"
query(
    "caption_match",
    "SELECT doc_id, page, title, max(score) AS score, arg_max(line_no, score * 1000000 - line_no) AS line_no FROM (SELECT *, CASE WHEN a = b THEN 1.0::DOUBLE "
    "WHEN length(a) >= 4 AND length(b) >= 4 AND (contains(a, b) OR contains(b, a)) THEN 0.92::DOUBLE ELSE 2.0 * len(list_intersect(ag, bg)) / (len(ag) + len(bg)) END AS score "
    f"FROM (SELECT DISTINCT doc_id, page, title, {_PLAIN('title')} AS a, {_GRAMS(_PLAIN('title'))} AS ag FROM figs) t "
    f"JOIN (SELECT doc_id, page, line_no, {_PLAIN('text')} AS b, {_GRAMS(_PLAIN('text'))} AS bg FROM lines) USING (doc_id, page) "
    "WHERE length(a) >= 3 AND length(b) >= 3) WHERE score >= 0.58 GROUP BY 1, 2, 3",
    V,
)(lambda t: o.caption_match(o.figure_candidates(t.lines).select("doc_id", "page", "title").distinct(), t.lines))
query("page_chrome", "SELECT doc_id, page, min(y) FILTER (y > 728.64) AS header_y, max(y) FILTER (y < 63.36) AS footer_y FROM lines GROUP BY 1, 2")(lambda t: o.page_chrome(t.lines))
