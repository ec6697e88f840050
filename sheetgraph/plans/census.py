"""Queries of the census operators."""

from __future__ import annotations

from sheetgraph.operators import census as o
from sheetgraph.plans.registry import query

_P = {k: getattr(o, k).replace("'", "''") for k in ("REF_BODY", "POWER", "PROTOCOL", "GENERIC_PIN", "VALUE_UNIT", "ALWAYS", "MPN_LIKE")}
_PART = f"regexp_matches({{0}}, '[A-Za-z]') AND regexp_matches({{0}}, '[0-9]') AND length({{0}}) BETWEEN 4 AND 40 AND NOT regexp_matches({{0}}, '(?i)^{_P['REF_BODY']}$') AND NOT regexp_matches({{0}}, '(?i){_P['POWER']}') AND NOT regexp_matches({{0}}, '(?i){_P['PROTOCOL']}') AND NOT regexp_matches({{0}}, '(?i){_P['GENERIC_PIN']}') AND NOT regexp_matches({{0}}, '{_P['VALUE_UNIT']}')"
V = {
    "toks": "SELECT doc_id, unnest(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda t: t <> '')) AS token FROM lines",
    "refs": f"SELECT DISTINCT doc_id, upper(r) AS ref FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)\\b{_P['REF_BODY']}\\b')) AS r FROM lines)",
    "labels": f"SELECT doc_id, upper(t) AS label, count(*) AS n FROM (SELECT doc_id, translate(token, ',:;()[]{{}}', '') AS t FROM toks) WHERE "
        f"regexp_matches(t, '(?i){_P['POWER']}') OR regexp_matches(t, '(?i){_P['PROTOCOL']}') GROUP BY 1, 2",
    "sheet": "SELECT design_id, ref_no % 2 + 1 AS page, ref_no * 2 AS item_no, ref AS text, CAST(ref_no % 8 * 120 AS DOUBLE) AS x, CAST(floor(ref_no / 8) "
        "* 110 AS DOUBLE) AS y, CAST(6 * length(ref) AS DOUBLE) AS w FROM comps UNION ALL SELECT design_id, ref_no % 2 + 1, ref_no * 2 + 1, value, "
        "CAST(ref_no % 8 * 120 + 4 AS DOUBLE), CAST(floor(ref_no / 8) * 110 - 30 + design_id % 7 * 9 AS DOUBLE), CAST(6 * length(value) AS DOUBLE) "
        "FROM comps",
}


def _sheet(t):
    ref = t.comps.selectExpr("design_id", "ref_no % 2 + 1 AS page", "ref_no * 2 AS item_no", "ref AS text", "CAST(ref_no % 8 * 120 AS DOUBLE) AS x", "CAST(floor(ref_no / 8) * 110 AS DOUBLE) AS y", "CAST(6 * length(ref) AS DOUBLE) AS w")
    return ref.union(t.comps.selectExpr("design_id", "ref_no % 2 + 1", "ref_no * 2 + 1", "value", "CAST(ref_no % 8 * 120 + 4 AS DOUBLE)", "CAST(floor(ref_no / 8) * 110 - 30 + design_id % 7 * 9 AS DOUBLE)", "CAST(6 * length(value) AS DOUBLE)"))


# Items of a page that its lines don't show, such as text beside a drawing
_ITEM = "CASE (doc_id + line_no) % 5 WHEN 0 THEN ' u' || CAST(line_no AS VARCHAR(9)) || ' ' WHEN 1 THEN 'see R7' WHEN 2 THEN 'XQ' || CAST(line_no AS VARCHAR(9)) ELSE 'tp' || CAST(doc_id % 50 AS VARCHAR(9)) END"
query(
    "census_refs",
    f"SELECT * FROM refs UNION SELECT doc_id, upper(trim(x)) FROM (SELECT doc_id, {_ITEM} AS x FROM lines) WHERE regexp_matches(trim(x), '(?i)^{_P['REF_BODY']}$')",
    V,
)(lambda t: o.census_refs(t.lines, t.lines.selectExpr("doc_id", f"{_ITEM} AS text")))
query("census_prefix_counts", "SELECT doc_id, regexp_extract(ref, '^([A-Z]+)[0-9]', 1) AS prefix, count(*) AS n FROM refs GROUP BY 1, 2", V)(lambda t: o.census_prefix_counts(o.census_refs(t.lines)))
query("census_labels", "SELECT * FROM labels", V)(lambda t: o.census_labels(t.lines))
query("census_gate_labels", f"SELECT doc_id, label FROM labels WHERE n >= 2 OR regexp_matches(label, '{_P['ALWAYS']}')", V)(lambda t: o.census_gate_labels(o.census_labels(t.lines)))
query("part_token_filter", f"SELECT doc_id, token, count(*) AS n FROM toks WHERE {_PART.format('token')} GROUP BY 1, 2", V)(lambda t: o.part_token_filter(t.lines))
query(
    "part_hints",
    f"""SELECT design_id, ref, arg_max(value, confidence) AS value, max(confidence) AS confidence FROM (
      SELECT design_id, page, ref, arg_min(text, score * 1000000 + item_no) AS value, greatest(0.55, least(0.95, 0.95 - min(score) / 140)) AS confidence FROM (
        SELECT r.design_id, r.page, upper(r.text) AS ref, p.text, p.item_no, abs(p.x + p.w / 2 - r.x - r.w / 2) AS dx, p.y - r.y AS dy,
          abs((p.x + p.w / 2) - (r.x + r.w / 2)) * 1.2::DOUBLE + abs(p.y - r.y) * 0.55::DOUBLE - CASE WHEN p.y < r.y THEN 7 ELSE 0 END - CASE WHEN regexp_matches(p.text, '(?i){_P['MPN_LIKE']}') THEN 4 ELSE 0 END AS score
        FROM sheet r JOIN sheet p ON r.design_id = p.design_id AND r.page = p.page WHERE regexp_matches(r.text, '(?i)^{_P['REF_BODY']}$') AND {_PART.format('p.text')})
      WHERE dx <= 70 AND abs(dy) <= 95 GROUP BY 1, 2, 3 HAVING min(score) < 58) GROUP BY 1, 2""",
    V,
)(lambda t: o.part_hints(_sheet(t)))
query("census_summary", "SELECT l.doc_id, l.pages, l.chars, coalesce(r.n, 0) AS refs, coalesce(x.n, 0) AS labels, coalesce(r.n, 0) > 0 OR coalesce(x.n, 0) > 0 AS "
    "available FROM (SELECT doc_id, max(page) AS pages, CAST(sum(length(trim(text, ' '))) AS BIGINT) AS chars FROM lines GROUP BY 1) l LEFT JOIN "
    "(SELECT doc_id, count(*) AS n FROM refs GROUP BY 1) r ON r.doc_id = l.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1) "
    "x ON x.doc_id = l.doc_id", V)(
    lambda t: o.census_summary(t.lines, o.census_refs(t.lines), o.census_labels(t.lines))
)
