"""SQL of the order-dependent operators: recursive queries that take one row after the other."""

from __future__ import annotations

from sheetgraph.operators import folds, layout, review

_q = lambda p: p.replace("'", "''")

# Lines: items in order; a line stays open while items are near its first one
ASSEMBLED = {
    "it": "SELECT doc_id, page, item_no, str, x, y, x + w AS x1, coalesce(nullif(abs(h), 0), 8.0) AS h, greatest(abs(h), 8.0) AS bh, row_number() OVER "
        "(PARTITION BY doc_id, page ORDER BY -y, x, item_no) AS k FROM items WHERE page <= 80 AND trim(str) <> ''",
}
ASSEMBLE = """
SELECT doc_id, page, CAST(line AS INTEGER) AS line_no, trim(regexp_replace(arg_max(text, k), '\\s{3,}', '  ', 'g'), ' ') AS text, arg_max(lx, k) AS x, arg_max(ly, k) AS y, arg_max(lx1, k) AS x1, arg_max(lh, k) AS h FROM (
  WITH RECURSIVE f AS (
    SELECT doc_id, page, k, 0 AS line, str AS text, x AS lx, y AS ly, x1 AS lx1, h AS lh FROM it WHERE k = 1
    UNION ALL
    SELECT i.doc_id, i.page, i.k, CASE WHEN s THEN f.line ELSE f.line + 1 END, CASE WHEN s THEN f.text || CASE WHEN i.x - f.lx1 > i.h * 0.6::DOUBLE THEN '  ' ELSE ' ' END || i.str ELSE i.str END,
      CASE WHEN s THEN f.lx ELSE i.x END, CASE WHEN s THEN f.ly ELSE i.y END, CASE WHEN s THEN greatest(f.lx1, i.x1) ELSE i.x1 END, CASE WHEN s THEN greatest(f.lh, i.h) ELSE i.h END
    FROM f JOIN it i ON i.doc_id = f.doc_id AND i.page = f.page AND i.k = f.k + 1, LATERAL (SELECT abs(f.ly - i.y) < greatest(2.5::DOUBLE, i.h * 0.5::DOUBLE) AS s) z)
  SELECT * FROM f) GROUP BY doc_id, page, line
"""
LINE_BOXES = """
SELECT doc_id, page, CAST(line AS INTEGER) AS line_no, trim(regexp_replace(arg_max(text, k), '\\s{3,}', '  ', 'g'), ' ') AS text, arg_max(l, k) AS "left", arg_max(r, k) AS "right", arg_max(base - lh, k) AS top, arg_max(base + lh * 0.25::DOUBLE, k) AS bottom FROM (
  WITH RECURSIVE b AS (SELECT doc_id, page, item_no, str, x AS lft, x1 AS rgt, 792 - y AS bs, bh AS h, row_number() OVER (PARTITION BY doc_id, page ORDER BY 792 - y, x, item_no) AS k FROM boxes),
  f AS (
    SELECT doc_id, page, k, 0 AS line, str AS text, lft AS l, rgt AS r, bs AS base, h AS lh FROM b WHERE k = 1
    UNION ALL
    SELECT i.doc_id, i.page, i.k, CASE WHEN s THEN f.line ELSE f.line + 1 END, CASE WHEN s THEN f.text || CASE WHEN i.lft - f.r > i.h * 0.6::DOUBLE THEN '  ' ELSE ' ' END || i.str ELSE i.str END,
      CASE WHEN s THEN least(f.l, i.lft) ELSE i.lft END, CASE WHEN s THEN greatest(f.r, i.rgt) ELSE i.rgt END, CASE WHEN s THEN f.base ELSE i.bs END, CASE WHEN s THEN greatest(f.lh, i.h) ELSE i.h END
    FROM f JOIN b i ON i.doc_id = f.doc_id AND i.page = f.page AND i.k = f.k + 1, LATERAL (SELECT abs(f.base - i.bs) < greatest(2.5::DOUBLE, i.h * 0.5::DOUBLE) AS s) z)
  SELECT * FROM f) GROUP BY doc_id, page, line
"""
ASSEMBLED["boxes"] = "SELECT doc_id, page, item_no, str, x, y, x + w AS x1, greatest(abs(h), 8.0) AS bh FROM items"

# Thermal pads: the k-th pad line after four pins takes the number after the largest so far
_NONE = " AND ".join(f"NOT regexp_matches(text, '{_q(p)}')" for p in (layout.ROW_TWO, layout.ROW_NAME_FIRST, layout.ROW_NUMBER_FIRST))
PADS = {
    "padrows": "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, no NULLS FIRST, pin) AS k FROM (SELECT doc_id, line_no, NULL::INTEGER AS "
        f"no, 0 AS pin FROM region WHERE part = 'row' AND {_NONE} AND regexp_matches(text, '{_q(layout.EP_LINE)}')"
    " UNION ALL SELECT doc_id, line_no, try_cast(number AS INTEGER), 1 FROM pfirst WHERE \"set\" = 'A')",
}
PIN_EP = """
SELECT * FROM (WITH RECURSIVE f AS (
  SELECT doc_id, k, line_no, CASE WHEN pin = 1 THEN 1 ELSE 0 END AS size, CASE WHEN pin = 1 THEN greatest(0, coalesce(no, 0)) ELSE 0 END AS top, FALSE AS made FROM padrows WHERE k = 1
  UNION ALL
  SELECT p.doc_id, p.k, p.line_no, f.size + CASE WHEN p.pin = 1 OR f.size >= 4 THEN 1 ELSE 0 END, CASE WHEN p.pin = 0 AND f.size >= 4 THEN f.top + 1 ELSE greatest(f.top, coalesce(p.no, 0)) END, p.pin = 0 AND f.size >= 4
  FROM f JOIN padrows p ON p.doc_id = f.doc_id AND p.k = f.k + 1)
SELECT doc_id, line_no, top::VARCHAR AS number, 'EP' AS name, 'passive' AS type FROM f WHERE made)
"""

# Figures: one stays unless it is near one that stayed
_KEEP = """
  WITH RECURSIVE f AS (
    SELECT doc_id, page, kind, k, line_no, y0, y1, TRUE AS kept, [y0] AS ys FROM {rows} WHERE k = 1
    UNION ALL
    SELECT r.doc_id, r.page, r.kind, r.k, r.line_no, r.y0, r.y1, NOT n, CASE WHEN n THEN f.ys ELSE list_append(f.ys, r.y0) END
    FROM f JOIN {rows} r ON r.doc_id = f.doc_id AND r.page = f.page AND r.kind = f.kind AND r.k = f.k + 1, LATERAL (SELECT len(list_filter(f.ys, lambda y: abs(y - r.y0) < 0.05::DOUBLE)) > 0 AS n) z)
  SELECT * FROM f WHERE kept
"""
_EDGE = "least(0.995, greatest(0.005, round({0}, 4)))::DOUBLE"


def final_figures(region: str) -> tuple[str, dict[str, str]]:
    rows = f"SELECT r.doc_id, r.page, f.kind, r.line_no, {_EDGE.format('r.y0 - 0.02::DOUBLE')} AS y0, {_EDGE.format('r.y1 + 0.02::DOUBLE')} AS y1 FROM ({region}) r JOIN figs f ON f.doc_id = r.doc_id AND f.line_no = r.line_no"
    views = {"frows": f"SELECT *, row_number() OVER (PARTITION BY doc_id, page, kind ORDER BY line_no) AS k FROM ({rows}) WHERE y1 - y0 >= 0.04::DOUBLE"}
    sql = (
        "SELECT doc_id, page, kind, line_no, y0, y1 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY page, line_no) AS p FROM (" + _KEEP.format(rows="frows") + "))"
        " WHERE p <= CASE kind WHEN 'block_diagram' THEN 1 WHEN 'pin_configuration' THEN 8 WHEN 'package_outline' THEN 2 ELSE 3 END"
    )
    return sql, views


_ALLOWED = "CASE kind " + " ".join(f"WHEN '{k}' THEN regexp_matches(title, '{_q(p)}')" for k, p in folds.ALLOWED.items()) + " ELSE FALSE END"
FILTERED = {
    "fwhy": f"SELECT doc_id, line_no, kind, title, page, 1 - y / 792 AS y0, CASE WHEN regexp_matches(title, '{_q(folds.FORBIDDEN)}') THEN "
        f"'blacklist_curve_plot' WHEN NOT {_ALLOWED} THEN 'keyword_not_matched' END AS why FROM figs",
    "fok": "SELECT *, y0 AS y1, row_number() OVER (PARTITION BY doc_id, page, kind ORDER BY line_no) AS k FROM fwhy WHERE why IS NULL",
}
FIGURE_FILTER = (
    "SELECT w.doc_id, w.line_no AS fig_no, coalesce(CASE WHEN g.line_no IS NOT NULL THEN 'kept' END, why, 'duplicate_or_over_cap') AS result FROM fwhy w LEFT JOIN ("
    "SELECT doc_id, line_no FROM (SELECT s.*, row_number() OVER (PARTITION BY s.doc_id, s.kind ORDER BY CASE WHEN regexp_matches(o.title, "
        "'(?i)^figure\\s+\\d') THEN 0 ELSE 1 END, s.page, s.line_no) AS p FROM ("
    + _KEEP.format(rows="fok")
    + ") s JOIN fok o ON o.doc_id = s.doc_id AND o.line_no = s.line_no) WHERE p <= CASE kind WHEN 'application' THEN 3 ELSE 1 END) g ON g.doc_id = "
        "w.doc_id AND g.line_no = w.line_no"
)

# Lifecycle: actions in order over the table of transitions
LIFECYCLE = {
    "acts": "SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS k FROM lifecycle",
    "moves": "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{to}')" for a, m in review.TRANSITIONS.items() for b, to in m.items()) + ") AS v(was, act, goes)",
}
_FOLD = """
  WITH RECURSIVE f AS (
    SELECT job_id, 0::BIGINT AS k, NULL::BIGINT AS event_id, 'extracted' AS state, 0::BIGINT AS applied, 0::BIGINT AS rejected, TRUE AS ok FROM (SELECT DISTINCT job_id FROM acts)
    UNION ALL
    SELECT a.job_id, a.k, a.event_id, coalesce(m.goes, f.state), f.applied + CASE WHEN m.goes IS NULL THEN 0 ELSE 1 END, f.rejected + CASE WHEN m.goes IS NULL THEN 1 ELSE 0 END, m.goes IS NOT NULL
    FROM f JOIN acts a ON a.job_id = f.job_id AND a.k = f.k + 1 LEFT JOIN moves m ON m.was = f.state AND m.act = a.action)
  SELECT * FROM f
"""
LIFECYCLE_SQL = f"SELECT job_id, arg_max(state, k) AS state, max(applied)::INTEGER AS applied, max(rejected)::INTEGER AS rejected FROM ({_FOLD}) GROUP BY 1"
LIFECYCLE_STREAM = (
    f"SELECT 'job' AS what, job_id, 0::BIGINT AS event_id, arg_max(state, k) AS state, max(applied) AS applied, max(rejected) AS rejected FROM ({_FOLD}) GROUP BY job_id"
    f" UNION ALL SELECT 'refused', job_id, event_id, state, 0, 0 FROM ({_FOLD}) WHERE NOT ok"
)

# Ledger: a reservation needs the balance; only one that is still open can be committed or refunded
LEDGER = {"entries": "SELECT *, row_number() OVER (PARTITION BY principal ORDER BY ts, event_id) AS k FROM ledger"}
LEDGER_SQL = """
SELECT * FROM (WITH RECURSIVE f AS (
  SELECT principal, 0::BIGINT AS k, 0::BIGINT AS balance, 0::BIGINT AS spent, []::STRUCT(id BIGINT, cost BIGINT)[] AS open, 0::BIGINT AS refused FROM (SELECT DISTINCT principal FROM entries)
  UNION ALL
  SELECT e.principal, e.k,
    f.balance + CASE WHEN e.op = 'topup' THEN e.amount WHEN e.op = 'reserve' AND e.amount > 0 AND f.balance >= e.amount THEN -e.amount WHEN e.op = 'refund' THEN coalesce(cost, 0) ELSE 0 END,
    CASE WHEN e.op = 'reserve' AND e.amount > 0 AND f.balance >= e.amount THEN f.spent + e.amount WHEN e.op = 'refund' AND cost IS NOT NULL THEN greatest(0, f.spent - cost) ELSE f.spent END,
    CASE WHEN e.op = 'reserve' AND e.amount > 0 AND f.balance >= e.amount THEN list_append(f.open, {'id': e.reservation, 'cost': e.amount})
      WHEN e.op IN ('commit', 'refund') THEN list_filter(f.open, lambda r: r.id IS DISTINCT FROM e.reservation) ELSE f.open END,
    f.refused + CASE WHEN e.op = 'reserve' AND f.balance < e.amount THEN 1 ELSE 0 END
  FROM f JOIN entries e ON e.principal = f.principal AND e.k = f.k + 1, LATERAL (SELECT list_filter(f.open, lambda r: r.id = e.reservation)[1].cost AS cost) z)
SELECT principal, arg_max(balance, k) AS balance, arg_max(spent, k) AS spent, arg_max(len(open), k) AS open, arg_max(refused, k) AS refused FROM f GROUP BY 1)
"""

# Ink that goes on from an anchor, and the first candidate that fits a figure
_CELL_ROW = "greatest(0, least(gh - 1, CAST(floor({0} / 4 + 0.5::DOUBLE) AS BIGINT)))"
_ROUND = "CAST(floor({0} + 0.5::DOUBLE) AS BIGINT)"
PROFILE = {
    "sz0": "SELECT page_id, w, h, chrome_top, chrome_bottom, greatest(1, CAST(ceil(w / 4) AS BIGINT)) AS gw, greatest(1, CAST(ceil(h / 4) AS BIGINT)) AS gh FROM pxsize",
    "sz": f"SELECT *, {_CELL_ROW.format('chrome_top')} AS t, {_CELL_ROW.format('chrome_bottom')} AS b, greatest(2, {_ROUND.format('gw * 0.006::DOUBLE')}) AS least_ink, "
    f"greatest(2, {_ROUND.format('gh * 0.03::DOUBLE')}) AS gap, greatest(3, {_ROUND.format('gh * 0.055::DOUBLE')}) AS lead, {_ROUND.format('gh * 0.8::DOUBLE')} AS most FROM sz0",
    "stopped": f"SELECT DISTINCT page_id, unnest(range({_CELL_ROW.format('top')}, {_CELL_ROW.format('bottom')} + 1)) AS r FROM pxlines JOIN sz USING (page_id) WHERE length(text) > 40",
    "cellrows": "SELECT page_id, r, count(*) AS n, min(c) AS c0, max(c) AS c1 FROM ink GROUP BY 1, 2",
}
# Columns page_id, anchor, dir, lead_rows of {anchors}; rows count from the anchor on
_GROW = """
SELECT page_id, anchor, dir, lead_rows, anchor + max(far) * dir AS last FROM (SELECT *, sum(cut) OVER (PARTITION BY page_id, anchor, dir, lead_rows ORDER BY far) AS broken FROM (
  SELECT *, CAST(CASE WHEN lag(far) OVER w IS NULL THEN far - 1 > lead_rows ELSE far - lag(far) OVER w - 1 > gap END AS INTEGER) AS cut
  FROM (SELECT a.*, z.gap, (i.r - a.anchor) * a.dir AS far FROM (SELECT DISTINCT * FROM ({anchors})) a JOIN sz z ON z.page_id = a.page_id
    JOIN cellrows i ON i.page_id = a.page_id AND i.n >= z.least_ink AND i.r BETWEEN z.t AND z.b AND (i.r - a.anchor) * a.dir BETWEEN 1 AND z.most + 1
    WHERE a.anchor BETWEEN 0 AND z.gh - 1 AND CASE WHEN dir = 1 THEN anchor + 1 >= z.t ELSE anchor - 1 <= z.b END
      AND NOT EXISTS (FROM stopped s WHERE s.page_id = a.page_id AND (s.r - a.anchor) * a.dir BETWEEN 1 AND (i.r - a.anchor) * a.dir AND s.r BETWEEN z.t AND z.b))
  WINDOW w AS (PARTITION BY page_id, anchor, dir, lead_rows ORDER BY far))) WHERE broken = 0 GROUP BY 1, 2, 3, 4
"""
INK_GROW = "SELECT page_id, anchor, dir, last FROM (" + _GROW.format(anchors="SELECT page_id, page_id % 20 AS anchor, dir, lead AS lead_rows FROM sz CROSS JOIN (VALUES (1), (-1)) AS v(dir)") + ")"
_INK_IN = "(SELECT coalesce(sum(n), 0) FROM cellrows k WHERE k.page_id = {p}.page_id AND k.r BETWEEN {a} AND {b})"
_FIT_EDGE = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, {0} * 4 / {1} {2} 0.014::DOUBLE))"
FITTED = {
    "caps0": f"SELECT c.*, {_CELL_ROW.format('top')} AS q0, {_CELL_ROW.format('bottom')} AS q1 FROM pxcaps c JOIN sz USING (page_id)",
    "caps1": "SELECT *, " + _INK_IN.format(p="x", a="greatest(t, q0 - span)", b="q0 - 1") + " AS over, " + _INK_IN.format(p="x", a="q1 + 1", b="least(b, q1 + span)")
    + f" AS under FROM (SELECT c.*, t, b, lead, {_ROUND.format('gh * 0.3::DOUBLE')} AS span FROM caps0 c JOIN sz USING (page_id)) x",
    "caps2": "SELECT *, CASE WHEN regexp_matches(text, '(?i)^\\s*(figure|fig\\.?|图|圖)\\s*\\d') THEN -1 WHEN regexp_matches(text, '^\\s*\\d+(\\.\\d+)*[\\s.、]') THEN 1 WHEN under > over THEN 1 ELSE -1 END AS way FROM caps1",
    "capgrown": _GROW.format(anchors="SELECT page_id, q0 AS anchor, -1 AS dir, lead AS lead_rows FROM caps2 UNION ALL SELECT page_id, q1, 1, lead FROM caps2"),
    "boxes": f"SELECT page_id, 0 AS turned, {_CELL_ROW.format('y0 * h')} AS a, {_CELL_ROW.format('y1 * h')} AS z FROM pxfigs JOIN sz USING (page_id) WHERE y0 IS NOT NULL UNION ALL SELECT page_id, 1, {_CELL_ROW.format('(1 - y1) * h')}, {_CELL_ROW.format('(1 - y0) * h')} FROM pxfigs JOIN sz USING (page_id) WHERE y0 IS NOT NULL",
    "best": "SELECT * FROM (SELECT x.*, gw, gap, least_ink, CASE WHEN z >= a THEN " + _INK_IN.format(p="x", a="a", b="z") + " / ((z - a + 1) * gw) ELSE 0 END AS ratio FROM boxes x JOIN sz USING (page_id)) "
    "QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY ratio DESC, turned) = 1",
    "trimmed": "SELECT x.page_id, turned, min(r) AS a, max(r) AS z, greatest(2, CAST(floor(any_value(gap) / 2 + 0.5::DOUBLE) AS BIGINT)) AS half FROM best x JOIN cellrows k ON k.page_id = x.page_id AND k.r BETWEEN a AND z AND n >= least_ink WHERE ratio >= 0.003 GROUP BY 1, 2",
    "trimgrown": _GROW.format(anchors="SELECT page_id, a AS anchor, -1 AS dir, half AS lead_rows FROM trimmed UNION ALL SELECT page_id, z, 1, half FROM trimmed"),
    "islands": "SELECT page_id, min(r) AS r0, max(r) AS r1 FROM (SELECT *, sum(nw) OVER (PARTITION BY page_id ORDER BY r) AS i FROM (SELECT k.page_id, r, CASE WHEN r - lag(r) OVER (PARTITION BY k.page_id ORDER BY r) - 1 <= gap THEN 0 ELSE 1 END AS nw "
    "FROM cellrows k JOIN sz z ON z.page_id = k.page_id AND r BETWEEN t AND b AND n >= least_ink)) GROUP BY page_id, i",
    "cands": "SELECT c.page_id, CASE WHEN g.dir = way THEN 1 ELSE 2 END AS prio, CASE WHEN g.dir = -1 THEN 'caption_up' ELSE 'caption_down' END AS method, least(q0, last) AS r0, greatest(q1, last) AS r1, 0.0::DOUBLE AS score, 0 AS n "
    "FROM caps2 c JOIN capgrown g ON g.page_id = c.page_id AND g.anchor = CASE WHEN g.dir = -1 THEN q0 ELSE q1 END"
    " UNION ALL SELECT x.page_id, 3, CASE WHEN turned = 1 THEN 'seed_mirror' ELSE 'seed_trim' END, coalesce(u.last, a), coalesce(d.last, z), 0, 0 FROM trimmed x LEFT JOIN trimgrown u ON u.page_id = x.page_id AND u.dir = -1 AND u.anchor = a "
    "LEFT JOIN trimgrown d ON d.page_id = x.page_id AND d.dir = 1 AND d.anchor = z"
    " UNION ALL SELECT page_id, 4, 'largest_block', r0, r1, n * CASE WHEN (a + z) / 2 BETWEEN r0 AND r1 THEN 1.5::DOUBLE ELSE 1 END, n FROM (SELECT i.*, s.a, s.z, " + _INK_IN.format(p="i", a="i.r0", b="i.r1") + " AS n FROM islands i LEFT JOIN best s ON s.page_id = i.page_id)",
    "bounded": "SELECT c.page_id, prio, method, r0, r1, score, c.n, sum(k.n) AS cells, min(c0) AS c0, max(c1) AS c1 FROM cands c JOIN cellrows k ON k.page_id = c.page_id AND k.r BETWEEN c.r0 AND c.r1 GROUP BY ALL",
}
FIGURE_FIT = (
    "SELECT page_id, fig_no, method, r0, r1, " + ", ".join(f"{_FIT_EDGE.format(*e)} AS {n}" for n, e in {"x0": ("c0", "w", "-"), "y0": ("r0", "h", "-"), "x1": ("(c1 + 1)", "w", "+"), "y1": ("(r1 + 1)", "h", "+")}.items())
    + " FROM bounded JOIN sz USING (page_id) JOIN pxfigs USING (page_id) WHERE (r1 - r0 + 1) / gh BETWEEN 0.04::DOUBLE AND 0.8::DOUBLE AND cells / ((r1 - r0 + 1) * (c1 - c0 + 1)) >= 0.003::DOUBLE "
    "QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY prio, score DESC, n DESC, r0) = 1"
)

# Unnamed nets: each joins the first group that it shares an endpoint with
ANONYMOUS = {
    "anon": "SELECT *, row_number() OVER (PARTITION BY design_id ORDER BY batch_no, net_id) AS k FROM (SELECT design_id, batch_no, net_id, list(ref || "
        "'|' || pin ORDER BY ref, pin) AS ends, max(conf_pct) AS conf"
    " FROM batch_eps WHERE trim(name) = '' GROUP BY 1, 2, 3 HAVING count(*) >= 2)",
}
ANONYMOUS_SQL = """
SELECT design_id, 'N$' || i::VARCHAR AS net, split_part(e, '|', 1) AS ref, split_part(e, '|', 2) AS pin, conf AS conf_pct FROM (
  SELECT design_id, i, unnest(groups[i].ends) AS e, groups[i].conf AS conf FROM (SELECT design_id, groups, unnest(range(1, len(groups) + 1)) AS i FROM (SELECT design_id, arg_max(groups, k) AS groups FROM (
    WITH RECURSIVE f AS (
      SELECT design_id, k, [{'ends': ends, 'conf': conf}] AS groups FROM anon WHERE k = 1
      UNION ALL
      SELECT n.design_id, n.k, CASE WHEN coalesce(hit, 0) = 0 THEN list_append(f.groups, {'ends': n.ends, 'conf': n.conf})
        ELSE list_transform(f.groups, lambda g, i: CASE WHEN i = hit THEN {'ends': list_distinct(list_concat(g.ends, n.ends)), 'conf': greatest(g.conf, n.conf)} ELSE g END) END
      FROM f JOIN anon n ON n.design_id = f.design_id AND n.k = f.k + 1, LATERAL (SELECT list_position(list_transform(f.groups, lambda g: list_has_any(g.ends, n.ends)), TRUE) AS hit) z)
    SELECT * FROM f) GROUP BY design_id)))
"""

# Interfaces: nets of one type merge while their members overlap in two; nets of one member attach by their roles
GROUPED = {
    "icand": "SELECT r.design_id, r.type, r.net_id, r.role, c.conf, coalesce(m.members, []) AS members FROM roled r JOIN (SELECT design_id, net_id, "
        "min(net_conf) AS conf FROM ctx GROUP BY 1, 2) c ON c.design_id = r.design_id AND c.net_id = r.net_id"
    " LEFT JOIN (SELECT design_id, net_id, list(DISTINCT ref ORDER BY ref) AS members FROM live GROUP BY 1, 2) m ON m.design_id = r.design_id AND "
        "m.net_id = r.net_id WHERE r.type <> 'POWER'",
    "grouped": """
SELECT design_id, type, arg_max(g, step) AS g FROM (
  WITH RECURSIVE f AS (
    SELECT design_id, type, 0 AS step, list({'m': members, 'nets': [net_id], 'conf': conf} ORDER BY net_id) AS g FROM icand WHERE len(members) >= 2 GROUP BY 1, 2
    UNION ALL
    SELECT design_id, type, step + 1, list_filter(list_transform(g, lambda x, k: CASE WHEN k = p.i THEN {'m': list_distinct(list_concat(g[p.i].m, g[p.j].m)), 'nets': list_concat(g[p.i].nets, g[p.j].nets), 'conf': least(g[p.i].conf, g[p.j].conf)} ELSE x END), lambda x, k: k <> p.j)
    FROM f, LATERAL (SELECT list_filter(flatten(list_transform(range(1, len(g) + 1), lambda i: list_transform(range(i + 1, len(g) + 1), lambda j: {'i': i, 'j': j}))), lambda q: len(list_intersect(g[q.i].m, g[q.j].m)) >= 2)[1] AS p) z WHERE p IS NOT NULL)
  SELECT * FROM f) GROUP BY 1, 2""",
    "merged": "SELECT design_id, type, i, g[i].m AS m, g[i].nets AS nets, g[i].conf AS conf FROM (SELECT design_id, type, g, unnest(range(1, len(g) + 1)) "
        "AS i FROM grouped)",
    "single": "SELECT c.design_id, c.type, c.net_id, c.conf, c.members[1] AS m, c.role IN ('CC1', 'CC2', 'NRST', 'SWO', 'CS') AS side, min(g.i) AS home "
        "FROM icand c LEFT JOIN merged g ON g.design_id = c.design_id AND g.type = c.type"
    " AND c.role IN ('CC1', 'CC2', 'NRST', 'SWO', 'CS') AND list_contains(g.m, c.members[1]) WHERE len(c.members) < 2 GROUP BY ALL",
    "alone": "SELECT *, CASE WHEN side AND m IS NOT NULL THEN min(net_id) OVER (PARTITION BY design_id, type, m ORDER BY net_id) ELSE net_id END AS leader "
        "FROM single WHERE home IS NULL",
    "own": "SELECT *, row_number() OVER (PARTITION BY design_id, type ORDER BY leader) AS place FROM (SELECT design_id, type, leader, any_value(m) AS m, "
        "min(conf) AS conf FROM alone GROUP BY 1, 2, 3)",
    "wide": "SELECT g.design_id, g.type, g.i, g.m, least(g.conf, coalesce(min(s.conf), g.conf)) AS conf FROM merged g LEFT JOIN single s ON s.design_id = "
        "g.design_id AND s.type = g.type AND s.home = g.i GROUP BY g.design_id, g.type, g.i, g.m, g.conf",
}
_IFACE = "type || ':' || array_to_string(list_sort(m), ',') AS iface, net_id, array_to_string(list_sort(m), ',') AS members, conf AS conf_pct"
GROUPS_SQL = f"SELECT design_id, type, {_IFACE} FROM (SELECT design_id, type, m, conf, unnest(nets) AS net_id FROM merged)"
SIDEBAND_SQL = (
    f"SELECT design_id, type, {_IFACE} FROM (SELECT w.design_id, w.type, w.m, w.conf, unnest(g.nets) AS net_id FROM wide w JOIN merged g ON "
        "g.design_id = w.design_id AND g.type = w.type AND g.i = w.i"
    " UNION ALL SELECT s.design_id, s.type, w.m, w.conf, s.net_id FROM single s JOIN wide w ON w.design_id = s.design_id AND w.type = s.type AND w.i = s.home)"
    " UNION ALL SELECT a.design_id, a.type, a.type || ':' || coalesce(o.m, 'group' || (o.place + coalesce(n.n, 0))::VARCHAR), a.net_id, "
        "coalesce(o.m, ''), o.conf FROM alone a"
    " JOIN own o ON o.design_id = a.design_id AND o.type = a.type AND o.leader = a.leader LEFT JOIN (SELECT design_id, type, count(*) AS n FROM "
        "merged GROUP BY 1, 2) n ON n.design_id = a.design_id AND n.type = a.type"
)
