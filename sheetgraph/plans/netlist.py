"""Queries of the netlist operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetgraph.operators import netlist as n
from sheetgraph.plans.registry import query

#: References and hints as a census would give them, and a model's components for two thirds of them and some more.
HINTS = {"hints": "SELECT design_id, ref, value FROM comps WHERE ref_no % 3 <> 0", "refs": "SELECT DISTINCT design_id, ref FROM comps"}
MODEL = {"model": "SELECT design_id, CASE WHEN ref_no % 7 = 0 THEN 'X' || ref ELSE ref END AS ref, CASE WHEN ref_no % 5 = 0 THEN '' ELSE value || 'm' END AS "
    "value, conf_pct FROM comps WHERE ref_no % 3 <> 1"}


def _hints(t):
    return t.comps.where("ref_no % 3 <> 0").select("design_id", "ref", "value")


def _model(t):
    return t.comps.where("ref_no % 3 <> 1").selectExpr("design_id", "CASE WHEN ref_no % 7 = 0 THEN 'X' || ref ELSE ref END AS ref", "CASE WHEN ref_no % 5 = 0 THEN '' ELSE value || 'm' END AS value", "conf_pct")


query(
    "skeleton",
    "SELECT r.design_id, r.ref, coalesce(h.value, r.ref) AS value, CASE WHEN regexp_matches(h.value, '[A-Za-z].*[0-9]|[0-9].*[A-Za-z]') THEN "
        "h.value ELSE '' END AS mpn, CASE WHEN regexp_matches(r.ref, '^[RCLDF][0-9]+') THEN 2 ELSE 0 END AS n_pins, 92 AS conf_pct FROM refs r LEFT "
        "JOIN hints h ON r.design_id = h.design_id AND r.ref = h.ref",
    HINTS,
)(lambda t: n.skeleton(t.comps.select("design_id", "ref").distinct(), _hints(t)))

_HALVES = {
    "a": "SELECT design_id, ref, number, name, type, conf_pct FROM pins WHERE pin_no <= 5",
    "b": "SELECT design_id, ref, number, name || '2' AS name, type, 100 - conf_pct AS conf_pct FROM pins WHERE pin_no >= 3",
}
query(
    "merge_pins",
    "SELECT coalesce(a.design_id, b.design_id) AS design_id, coalesce(a.ref, b.ref) AS ref, coalesce(a.number, b.number) AS number, "
        "coalesce(b.name, a.name) AS name, coalesce(b.type, a.type) AS type, greatest(coalesce(a.conf_pct, 0), coalesce(b.conf_pct, 0)) AS conf_pct "
        "FROM a FULL JOIN b ON a.design_id = b.design_id AND a.ref = b.ref AND a.number = b.number",
    _HALVES,
)(lambda t: n.merge_pins(t.pins.where("pin_no <= 5").select("design_id", "ref", "number", "name", "type", "conf_pct"), t.pins.where("pin_no >= 3").selectExpr("design_id", "ref", "number", "name || '2' AS name", "type", "100 - conf_pct AS conf_pct")))

query(
    "merge_model",
    "SELECT c.design_id, c.ref, coalesce(nullif(m.value, ''), nullif(c.value, ''), c.ref) AS value, greatest(c.conf_pct, coalesce(m.conf_pct, 0)) "
        "AS conf_pct FROM comps c LEFT JOIN model m ON c.design_id = m.design_id AND c.ref = m.ref UNION ALL SELECT design_id, ref, value, conf_pct "
        "FROM model m WHERE NOT EXISTS (SELECT 1 FROM comps c WHERE c.design_id = m.design_id AND c.ref = m.ref)",
    MODEL,
)(lambda t: n.merge_model(t.comps, _model(t)))

query("focus_batches", "SELECT design_id, ref, CAST(floor((row_number() OVER (PARTITION BY design_id ORDER BY ref) - 1) / 18) AS BIGINT) AS batch_no FROM comps")(lambda t: n.focus_batches(t.comps))

query("batch_components", "SELECT design_id, ref, arg_max(value, batch_no) FILTER (value IS NOT NULL) AS value, max(conf_pct) AS conf_pct FROM batch_comps GROUP BY 1, "
    "2")(lambda t: n.batch_components(t.batch_comps))

query(
    "batch_named_nets",
    "SELECT design_id, net, count(*) AS n_endpoints, max(c) AS conf_pct, CAST(sum(c) AS BIGINT) AS sum_pct FROM (SELECT design_id, "
        "upper(trim(name)) AS net, ref, pin, arg_max(conf_pct, batch_no) AS c FROM (SELECT *, count(*) OVER (PARTITION BY design_id, batch_no, "
        "net_id) AS n FROM batch_eps WHERE trim(name) <> '' AND NOT regexp_matches(name, '(?i)^N\\$?[0-9]+$')) WHERE n >= 2 GROUP BY 1, 2, 3, 4) "
        "GROUP BY 1, 2",
)(lambda t: n.batch_named_nets(t.batch_eps))

_WARN = "CASE WHEN value IS NULL THEN 'no value for ' || ref ELSE 'fine' END"
query(
    "batch_rollup",
    "SELECT design_id, coalesce(n.n, 0) AS n_nets, CAST(CASE WHEN coalesce(n.n, 0) > 0 THEN least(950, 550 + least(350, n.n * 5)) ELSE 350 END AS "
        "BIGINT) AS conf_mille, coalesce(x.n, 0) AS n_no_connects, coalesce(w.n, 0) AS n_warnings"
    " FROM (SELECT design_id, count(*) AS n FROM nets GROUP BY 1) n FULL JOIN (SELECT design_id, count(*) AS n FROM (SELECT DISTINCT * FROM ncs) "
        "GROUP BY 1) x USING (design_id)"
    f" FULL JOIN (SELECT design_id, count(DISTINCT {_WARN}) AS n FROM batch_comps GROUP BY 1) w USING (design_id)",
)(lambda t: n.batch_rollup(t.nets, t.ncs.union(t.ncs.selectExpr("design_id", "lower(ref)", "pin")), t.batch_comps.selectExpr("design_id", f"{_WARN} AS text")))

_DUP = {"dup": "SELECT design_id, ref_no AS pos, CASE WHEN ref_no % 4 = 0 THEN 'U1' ELSE ref END AS ref FROM comps"}
query("dedupe_refs", "SELECT design_id, pos, ref AS old_ref, CASE WHEN k = 1 THEN ref ELSE ref || '_' || k::VARCHAR END AS ref, k > 1 AS renamed FROM (SELECT *, "
    "row_number() OVER (PARTITION BY design_id, ref ORDER BY pos) AS k FROM dup)", _DUP)(
    lambda t: n.dedupe_refs(t.comps.selectExpr("design_id", "ref_no AS pos", "CASE WHEN ref_no % 4 = 0 THEN 'U1' ELSE ref END AS ref"))
)

query(
    "normalize_comp_pins",
    """SELECT package_id AS design_id, 'U1' AS ref, place, CASE WHEN k = 1 THEN no ELSE no || '_' || k::VARCHAR END AS number, coalesce(nullif(name, ''), CASE WHEN k = 1 THEN no ELSE no || '_' || k::VARCHAR END) AS name, kind AS type,
      CASE WHEN kind = 'power_in' THEN CASE WHEN place % 2 = 1 THEN 'top' ELSE 'bottom' END WHEN kind IN ('power_out', 'output', 'bidirectional') THEN 'right' ELSE 'left' END AS side
    FROM (SELECT *, row_number() OVER (PARTITION BY package_id, no ORDER BY pos) AS k, CASE WHEN type = 'weird' THEN 'unspecified' ELSE type END AS kind
      FROM (SELECT *, pos AS place, CASE WHEN trim(coalesce(number, '')) IN ('', '?') THEN pos::VARCHAR ELSE trim(number) END AS no FROM raw_pins))""",
)(lambda t: n.normalize_comp_pins(t.raw_pins.selectExpr("package_id AS design_id", "'U1' AS ref", "pos", "number", "name", "type")))

query(
    "default_passive_pins",
    "SELECT c.design_id, c.ref, k.number, 'passive' AS type, CASE WHEN k.number = '1' THEN 'left' ELSE 'right' END AS side, 45 AS conf_pct FROM "
        "comps c CROSS JOIN (VALUES ('1'), ('2')) AS k(number) WHERE regexp_matches(c.ref, '^[RCLDF][0-9]+') AND NOT EXISTS (SELECT 1 FROM pins p "
        "WHERE p.design_id = c.design_id AND p.ref = c.ref AND p.ref_no % 2 = 0)",
)(lambda t: n.default_passive_pins(t.comps, t.pins.where("ref_no % 2 = 0")))

query(
    "library_hint",
    """SELECT design_id, ref, CASE WHEN regexp_matches(ref, '^R[0-9]') THEN 'Device:R' WHEN regexp_matches(ref, '^C[0-9]') THEN CASE WHEN regexp_matches(upper(value), 'POL|ELECT|TANT') THEN 'Device:C_Polarized' ELSE 'Device:C' END
      WHEN regexp_matches(ref, '^L[0-9]') THEN 'Device:L' WHEN regexp_matches(ref, '^J[0-9]') THEN 'Connector_Generic:Conn_01x' || lpad((ref_no % 41 + 1)::VARCHAR, 2, '0') ELSE '' END AS library_id FROM comps""",
)(lambda t: t.comps.select("design_id", "ref", n.library_hint(F.col("ref"), F.col("value"), F.col("ref_no") % 41 + 1).alias("library_id")))

_RAW = {"raw": "SELECT design_id, net_id, ref, CASE WHEN net_id % 5 = 0 THEN 'VCC' WHEN net_id % 7 = 0 THEN '77' ELSE pin END AS pin, conf_pct FROM eps"}
query(
    "resolve_endpoints",
    """SELECT r.design_id, r.net_id, r.ref, coalesce(a.number, b.number, r.pin) AS pin, coalesce(a.number, b.number) IS NULL AS "unknown", max(r.conf_pct) AS conf_pct FROM raw r
      LEFT JOIN pins a ON a.design_id = r.design_id AND a.ref = r.ref AND a.number = r.pin
      LEFT JOIN (SELECT design_id, ref, name, min(number) AS number FROM pins GROUP BY 1, 2, 3) b ON b.design_id = r.design_id AND b.ref = r.ref AND b.name = r.pin GROUP BY 1, 2, 3, 4, 5""",
    _RAW,
)(lambda t: n.resolve_endpoints(t.eps.selectExpr("design_id", "net_id", "ref", "CASE WHEN net_id % 5 = 0 THEN 'VCC' WHEN net_id % 7 = 0 THEN '77' ELSE pin END AS pin", "conf_pct"), t.pins))

query(
    "filter_nets",
    "SELECT design_id, net_id, CASE WHEN b = 1 THEN 'N$' || (sum(b) OVER (PARTITION BY design_id ORDER BY net_id))::VARCHAR ELSE name END AS "
        "name, n AS n_endpoints, conf_pct FROM (SELECT n.*, c.n, CASE WHEN n.net_id >= 60 THEN 1 ELSE 0 END AS b FROM nets n JOIN (SELECT design_id, "
        "net_id, count(*) AS n FROM eps GROUP BY 1, 2 HAVING count(*) >= 2) c ON c.design_id = n.design_id AND c.net_id = n.net_id)",
)(lambda t: n.filter_nets(t.nets.withColumn("name", F.when(F.col("net_id") >= 60, " ").otherwise(F.col("name"))), t.eps))

query(
    "no_connects",
    "SELECT design_id, ref, number AS pin, CASE WHEN nc THEN 'no_connect' ELSE 'unconnected_low_confidence' END AS kind FROM ("
    "SELECT p.*, p.type = 'no_connect' OR x.pin IS NOT NULL AS nc, e.pin IS NOT NULL AS con FROM pins p"
    " LEFT JOIN (SELECT DISTINCT design_id, ref, pin FROM ncs) x ON x.design_id = p.design_id AND x.ref = p.ref AND x.pin = p.number"
    " LEFT JOIN (SELECT DISTINCT design_id, ref, pin FROM eps) e ON e.design_id = p.design_id AND e.ref = p.ref AND e.pin = p.number) WHERE nc OR "
        "(NOT con AND conf_pct < 50)",
)(lambda t: n.no_connects(t.pins, t.ncs, t.eps))

query(
    "ir_caps",
    "SELECT c.design_id, least(c.n, 30) AS components, least(m.n, 50) AS nets, e.n AS endpoints FROM (SELECT design_id, count(*) AS n FROM comps "
        "GROUP BY 1) c JOIN (SELECT design_id, count(*) AS n FROM nets GROUP BY 1) m ON c.design_id = m.design_id JOIN (SELECT design_id, "
        "CAST(sum(least(n, 8)) AS BIGINT) AS n FROM (SELECT design_id, net_id, count(*) AS n FROM eps GROUP BY 1, 2) GROUP BY 1) e ON c.design_id = "
        "e.design_id",
)(lambda t: n.ir_caps(t.comps, t.nets, t.eps, (30, 50, 8)))

query(
    "netlist_summary",
    "SELECT c.design_id, c.components, c.conf_pct, (SELECT count(*) FROM pins p WHERE p.design_id = c.design_id) AS pins, (SELECT count(*) FROM "
        "nets p WHERE p.design_id = c.design_id) AS nets, (SELECT count(*) FROM eps p WHERE p.design_id = c.design_id) AS endpoints FROM (SELECT "
        "design_id, count(*) AS components, min(conf_pct) AS conf_pct FROM comps GROUP BY 1) c",
)(lambda t: n.netlist_summary(t.comps, t.pins, t.nets, t.eps))

_REN = "SELECT design_id, ref, number AS pin, CASE WHEN ref_no % 5 = 0 THEN ref || 'A' END AS new_ref, CASE WHEN pin_no = 3 THEN '33' END AS new_pin FROM pins WHERE ref_no % 5 = 0 OR pin_no = 3"
query("netlist_rename", "SELECT e.design_id, net_id, CASE WHEN c.ref_no % 5 = 0 THEN e.ref || 'A' ELSE e.ref END AS ref, CASE WHEN pin = '3' THEN '33' ELSE pin END "
    "AS pin FROM eps e JOIN comps c ON e.design_id = c.design_id AND e.ref = c.ref")(
    lambda t: n.netlist_rename(t.eps, t.pins.selectExpr("design_id", "ref", "CASE WHEN pin_no = 3 THEN number END AS pin", "CASE WHEN ref_no % 5 = 0 THEN ref || 'A' END AS new_ref", "CASE WHEN pin_no = 3 THEN '33' END AS new_pin"))
)

query("pin_peers", "SELECT a.design_id, a.ref AS of_ref, a.pin AS of_pin, a.net_id, b.ref, b.pin FROM eps a JOIN eps b ON a.design_id = b.design_id AND a.net_id "
    "= b.net_id WHERE a.ref <> b.ref OR a.pin <> b.pin")(
    lambda t: n.pin_peers(t.eps, t.pins.select("design_id", "ref", F.col("number").alias("pin")))
)

query("net_search", "SELECT design_id, net_id, name FROM nets n WHERE contains(lower(name), 'u7.2') OR EXISTS (SELECT 1 FROM eps e WHERE e.design_id = "
    "n.design_id AND e.net_id = n.net_id AND contains(lower(e.ref || '.' || e.pin), 'u7.2'))")(lambda t: n.net_search(t.nets, t.eps, "U7.2"))

query("endpoint_context", "SELECT * FROM ctx")(lambda t: n.endpoint_context(t.eps, t.nets, t.pins))
