"""Queries of quality, evidence, review, lifecycle and ledger operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetgraph.operators import cleaning, evidence, layout, quality, review
from sheetgraph.operators import netlist as n
from sheetgraph.plans.cleaning import V as CV
from sheetgraph.plans.cleaning import PROV_SQL, REL, REV_SQL, _odd, _pk, reviewed
from sheetgraph.plans.checks import HEALTH
from sheetgraph.plans.checks import V as CHECKS
from sheetgraph.plans.folds import LEDGER, LEDGER_SQL, LIFECYCLE, LIFECYCLE_SQL
from sheetgraph.plans.layout import V as LV
from sheetgraph.plans.registry import query

# Quality
_SRC = "SELECT design_id, ref || CASE WHEN ref_no % 9 = 0 THEN 'x' ELSE '' END AS value FROM comps"
query("coverage", "SELECT s.design_id, count(*) AS source, count(c.ref) AS matched, count(c.ref) / count(*) AS ratio FROM (SELECT DISTINCT design_id, "
    f"upper(value) AS value FROM ({_SRC})) s LEFT JOIN (SELECT DISTINCT design_id, upper(ref) AS ref FROM comps) c ON c.design_id = s.design_id "
    "AND c.ref = s.value GROUP BY 1")(
    lambda t: quality.coverage(t.comps.selectExpr("design_id", "ref || CASE WHEN ref_no % 9 = 0 THEN 'x' ELSE '' END AS value"), t.comps.select("design_id", F.col("ref").alias("value")))
)
KC = "SELECT design_id, ref, value, CASE WHEN ref_no % 11 = 0 THEN 'LM-555' WHEN ref_no % 13 = 0 THEN 'mcp3204' END AS mpn FROM comps"
_ALIAS = " ".join(
    f"WHEN list_has_any([{', '.join(_bare.format(c) for c in ('mpn', 'value', 'ref'))}], "
        f"[{', '.join(repr(a) for a, p in quality.ALIASES.items() if p == part)}]) THEN '{part}'"
    for part in quality.KNOWN_PINS
    for _bare in ["regexp_replace(upper(coalesce({0}, '')), '[^A-Z0-9]', '', 'g')"]
)
_NAME = "regexp_replace(upper(coalesce({0}, '')), '[^A-Z0-9+\\-/]', '', 'g')"
KV = {
    "kcomps": KC,
    "known": f"SELECT * FROM (SELECT design_id, ref, CASE {_ALIAS} END AS part FROM kcomps) WHERE part IS NOT NULL",
    "canon": "SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{a}', '{b}', '{c}')" for p, v in quality.KNOWN_PINS.items() for a, b, c in v) + ") AS v(part, number, c_name, c_type)",
    "want": "SELECT k.*, c.number, c_name, c_type FROM known k JOIN canon c ON c.part = k.part",
    "have": "SELECT k.*, p.number, p.name, p.type, p.conf_pct FROM known k JOIN pins p ON p.design_id = k.design_id AND p.ref = k.ref",
    "recon": "SELECT coalesce(w.design_id, h.design_id) AS design_id, coalesce(w.ref, h.ref) AS ref, coalesce(w.part, h.part) AS part, coalesce(w.number, "
        "h.number) AS number,"
    " coalesce(c_name, name) AS name, coalesce(c_type, type) AS type, CASE WHEN c_name IS NULL THEN least(coalesce(conf_pct, 50), 40) ELSE "
        "greatest(coalesce(conf_pct, 0), 98) END AS conf_pct,"
    f" CASE WHEN c_name IS NULL THEN 'extra' WHEN h.ref IS NULL THEN 'added' WHEN {_NAME.format('name')} = {_NAME.format('c_name')} AND type = "
        "c_type THEN 'kept' ELSE 'corrected' END AS result,"
    " name AS was_name, type AS was_type FROM want w FULL JOIN have h ON w.design_id = h.design_id AND w.ref = h.ref AND w.number = h.number",
    "chk": "SELECT design_id, ref, part, count(*) FILTER (result IN ('kept', 'corrected')) AS compared, count(*) FILTER (result = 'corrected') AS mismatched,"
    " count(*) FILTER (result = 'added') AS missing, count(*) FILTER (result = 'extra') AS extra FROM recon GROUP BY 1, 2, 3",
}


def _kcomps(t):
    return t.comps.selectExpr("design_id", "ref", "value", "CASE WHEN ref_no % 11 = 0 THEN 'LM-555' WHEN ref_no % 13 = 0 THEN 'mcp3204' END AS mpn")


def _recon(t):
    return quality.known_pin_reconcile(quality.known_part_match(_kcomps(t)), t.pins)


query("known_part_match", "SELECT * FROM known", KV)(lambda t: quality.known_part_match(_kcomps(t)))
query("known_pin_reconcile", "SELECT * FROM recon", KV)(_recon)
# The source shows some references under another name; the component then has its value as reference, or keeps it as value
HV = {
    "h": "SELECT design_id, CASE WHEN ref_no % 6 = 0 THEN 'Z' || CAST(ref_no AS VARCHAR(9)) ELSE ref END AS ref, CASE WHEN ref_no % 6 = 0 THEN 'W-' || "
        "CAST(ref_no % 12 + design_id % 50 * 100 AS VARCHAR(20)) ELSE value END AS value,"
    " CAST(50 + (ref_no * 7) % 50 AS DOUBLE) / 100 AS confidence FROM comps",
    "c": "SELECT design_id, CASE WHEN ref_no % 18 = 0 THEN 'W' || CAST(ref_no + design_id % 50 * 100 AS VARCHAR(20)) ELSE ref END AS ref,"
    " CASE WHEN ref_no % 6 = 0 THEN 'w' || CAST(ref_no + design_id % 50 * 100 AS VARCHAR(20)) ELSE value END AS value, NULL::VARCHAR AS mpn FROM comps",
    "sure": "SELECT design_id, upper(ref) AS ref, regexp_replace(upper(value), '[^A-Z0-9]', '', 'g') AS v FROM h WHERE confidence >= 0.66",
    "cv": "SELECT DISTINCT design_id, ref, regexp_replace(upper(x), '[^A-Z0-9]', '', 'g') AS v FROM (SELECT design_id, ref, value AS x FROM c UNION ALL "
        "SELECT design_id, ref, ref FROM c)",
    "lone": "SELECT design_id, v, min(ref) AS from_ref FROM cv WHERE v <> '' GROUP BY 1, 2 HAVING count(*) = 1",
    "cand": "SELECT s.design_id, s.ref AS to_ref, l.from_ref FROM sure s JOIN lone l ON l.design_id = s.design_id AND l.v = s.v LEFT JOIN c ON "
        "c.design_id = s.design_id AND upper(c.ref) = s.ref"
    " LEFT JOIN (SELECT DISTINCT design_id, upper(ref) AS r FROM h) x ON x.design_id = l.design_id AND x.r = upper(l.from_ref) WHERE c.ref IS "
        "NULL AND x.r IS NULL AND s.v <> ''",
    "ren": "SELECT design_id, min(from_ref) AS from_ref, to_ref FROM (SELECT design_id, from_ref, min(to_ref) AS to_ref FROM cand GROUP BY 1, 2) GROUP "
        "BY design_id, to_ref",
}


def _hints(t):
    return t.comps.selectExpr(
        "design_id", "CASE WHEN ref_no % 6 = 0 THEN 'Z' || ref_no ELSE ref END AS ref",
        "CASE WHEN ref_no % 6 = 0 THEN 'W-' || (ref_no % 12 + design_id % 50 * 100) ELSE value END AS value", "CAST(50 + (ref_no * 7) % 50 AS DOUBLE) / 100 AS confidence",
    )


def _misnamed(t):
    return t.comps.selectExpr(
        "design_id", "CASE WHEN ref_no % 18 = 0 THEN 'W' || (ref_no + design_id % 50 * 100) ELSE ref END AS ref",
        "CASE WHEN ref_no % 6 = 0 THEN 'w' || (ref_no + design_id % 50 * 100) ELSE value END AS value", "CAST(NULL AS STRING) AS mpn",
    )


def _renamed(t):
    """Components and endpoints after the renames; the endpoints are those of the components as they were named."""
    renames = quality.ref_reconcile(_hints(t), _misnamed(t))
    comps = quality.ref_rename(_misnamed(t).select("design_id", "ref", "value"), renames)
    ends = t.eps.selectExpr("design_id", "net_id", "ref AS was", "pin").join(t.comps.selectExpr("design_id", "ref AS was", "ref_no"), ["design_id", "was"])
    ends = ends.selectExpr("design_id", "CASE WHEN ref_no % 18 = 0 THEN 'W' || (ref_no + design_id % 50 * 100) ELSE was END AS ref", "net_id || '.' || pin AS value")
    return comps.withColumn("tbl", F.lit("components")).union(quality.ref_rename(ends, renames).select("design_id", "ref", "value", F.lit("endpoints")))


query(
    "ref_reconcile",
    "SELECT t.design_id, coalesce(to_ref, t.ref) AS ref, value, tbl FROM (SELECT design_id, ref, value, 'components' AS tbl FROM c UNION ALL"
    " SELECT e.design_id, CASE WHEN ref_no % 18 = 0 THEN 'W' || CAST(ref_no + e.design_id % 50 * 100 AS VARCHAR(20)) ELSE e.ref END, "
        "net_id::VARCHAR || '.' || pin, 'endpoints'"
    " FROM eps e JOIN comps k ON k.design_id = e.design_id AND k.ref = e.ref) t LEFT JOIN ren r ON r.design_id = t.design_id AND r.from_ref = t.ref",
    HV,
)(_renamed)
# Signals by the rules: what the source shows, the pin maps, and the issues of the netlist. The source names nets of its own
# in every third design, and every seventh design has lost its nets.
_LBL = "CASE WHEN design_id % 3 = 0 AND net_id % 3 = 0 THEN 'X' || name ELSE name END"
QV = CHECKS | KV | HV | {
    "cover_c": "SELECT s.design_id, count(*) AS n_refs, count(c.ref) / count(*) AS components FROM (SELECT DISTINCT design_id, regexp_replace(upper(ref), "
        "'\\s+', '', 'g') AS v FROM h) s"
    " LEFT JOIN (SELECT DISTINCT design_id, upper(ref) AS ref FROM comps) c ON c.design_id = s.design_id AND c.ref = s.v GROUP BY 1",
    "own_nets": "SELECT * FROM nets WHERE design_id % 7 <> 0",
    "cover_n": f"SELECT s.design_id, count(*) AS n_labels, count(c.v) / count(*) AS nets FROM (SELECT DISTINCT design_id, regexp_replace(upper({_LBL}), "
        "'\\s+', '', 'g') AS v FROM nets) s"
    " LEFT JOIN (SELECT DISTINCT design_id, upper(name) AS v FROM own_nets) c ON c.design_id = s.design_id AND c.v = s.v GROUP BY 1",
    "kn": "SELECT design_id, sum(compared)::BIGINT AS compared, sum(mismatched)::BIGINT AS mismatched, sum(missing)::BIGINT AS missing, sum(extra)::BIGINT AS extra,"
    " count(*) FILTER (compared >= 3 AND (compared - mismatched) / compared < 0.8) AS conflicts, count(*) FILTER (extra > 0) AS unresolved FROM chk GROUP BY 1",
    "health": HEALTH,
    "sig0": "SELECT k.design_id, k.n_comps, coalesce(n.n, 0) AS n_nets, coalesce(n_refs, 0) AS n_refs, components, coalesce(n_labels, 0) AS n_labels, "
        "nets, coalesce(compared, 0) AS compared,"
    " coalesce(mismatched, 0) AS mismatched, coalesce(missing, 0) AS missing, coalesce(extra, 0) AS extra, coalesce(conflicts, 0) AS conflicts, "
        "coalesce(unresolved, 0) AS unresolved,"
    " coalesce(error, 0) AS error, coalesce(warning, 0) AS warning, coalesce(review, 0) AS review, coalesce(r.n, 0) AS renames"
    " FROM (SELECT design_id, count(*) AS n_comps FROM comps GROUP BY 1) k LEFT JOIN (SELECT design_id, count(*) AS n FROM own_nets GROUP BY 1) n USING (design_id)"
    " LEFT JOIN cover_c USING (design_id) LEFT JOIN cover_n USING (design_id) LEFT JOIN kn USING (design_id) LEFT JOIN health USING (design_id)"
    " LEFT JOIN (SELECT design_id, count(*) AS n FROM ren GROUP BY 1) r USING (design_id)",
    "signals": "SELECT *, CASE WHEN compared > 0 THEN (compared - mismatched) / compared END AS pins,"
    " greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - (error * 2 + warning * 0.45::DOUBLE + review * 0.2::DOUBLE) / greatest(8, n_comps + n_nets))) AS graph FROM sig0",
    "scored": "SELECT *, CAST(floor(100 * (coalesce(components * 0.3::DOUBLE, 0) + coalesce(nets * 0.4::DOUBLE, 0) + coalesce(pins * 0.2::DOUBLE, 0) + "
        "coalesce(graph * 0.1::DOUBLE, 0))"
    " / (CASE WHEN components IS NULL THEN 0 ELSE 0.3::DOUBLE END + CASE WHEN nets IS NULL THEN 0 ELSE 0.4::DOUBLE END + CASE WHEN pins IS NULL "
        "THEN 0 ELSE 0.2::DOUBLE END + 0.1::DOUBLE) + 0.5) AS BIGINT) AS score FROM signals",
    "reasoned": "SELECT *, concat_ws(',', "
    + ", ".join(f"CASE WHEN {cond.replace('1.0D', '1').replace('0.7D', '0.7')} THEN '{code}' END" for code, cond in quality.REJECTING)
    + ") AS reasons FROM scored",
}


def _signals(t):
    """One row a design, made once for the score, the gate and its issues."""
    return t.kept("signals", lambda: _made_signals(t))


def _made_signals(t):
    from sheetgraph.plans.checks import flagship

    labels = t.nets.selectExpr("design_id", f"{_LBL} AS value")
    nets = t.nets.where("design_id % 7 <> 0").selectExpr("design_id", "name AS value")
    renames = quality.ref_reconcile(_hints(t), _misnamed(t))
    checks = quality.known_pin_checks(_recon(t))
    health = t.kept("health", lambda: flagship(t))  # a plan of its own: with the signals in it the driver would hold one of twice the stages
    return quality.quality_signals(_hints(t).selectExpr("design_id", "ref AS value"), labels, t.comps.selectExpr("design_id", "ref AS value"), nets, checks, health, renames)


query("quality_score", "SELECT design_id, score FROM scored", QV)(lambda t: quality.quality_score(_signals(t)))
query(
    "quality_gate",
    "SELECT design_id, score, reasons, CASE WHEN reasons <> '' THEN 'rejected' WHEN score < 85 OR renames + mismatched + missing > 0 OR (n_refs + "
        "n_labels = 0 AND score < 90) THEN 'review' ELSE 'accepted' END AS status,"
    " reasons = '' AS export_allowed FROM reasoned",
    QV,
)(lambda t: quality.quality_gate(_signals(t)))
_FOUND = " UNION ALL ".join(f"SELECT design_id, '{code}' AS code, '{sev}' AS severity FROM scored WHERE {cond.replace('1.0D', '1').replace('0.7D', '0.7')}" for code, sev, cond in quality.FINDINGS)
query(
    "quality_issues",
    f"SELECT design_id, code, severity, 1 AS n FROM ({_FOUND}) UNION ALL SELECT s.design_id, 'HEALTH', v.sev, CASE v.sev WHEN 'warning' THEN "
        "s.warning WHEN 'error' THEN s.error ELSE s.review END"
    f" + (SELECT count(*) FROM ({_FOUND}) f WHERE f.design_id = s.design_id AND f.severity = v.sev) FROM scored s CROSS JOIN (VALUES ('error'), "
        "('warning'), ('review')) AS v(sev)",
    QV,
)(lambda t: _issues(_signals(t)))


def _issues(signals):
    """The gate's issues, and the counts of all issues with them."""
    health = quality.quality_health(signals).unpivot("design_id", ["error", "warning", "review"], "severity", "n")
    return quality.quality_issues(signals).withColumn("n", F.lit(1).cast("long")).union(health.select("design_id", F.lit("HEALTH"), "severity", "n"))


_EXP = [("ref", "U0"), ("ref", "IC1"), ("ref", "R2"), ("ref", "X99"), ("net", "GND"), ("net", "SDA"), ("net", "VCC"), ("pin", "IC1.1=MISO"), ("pin", "IC1.2=SCK"), ("pin", "U0.1=SDA"), ("pin", "U0.2=SCL")]
query(
    "golden_recall",
    "SELECT d.design_id, e.kind, count(a.value) / count(*) AS recall, count(a.value) / count(*) >= CASE e.kind WHEN 'pin' THEN 1.0 ELSE 0.95 END "
        "AS meets FROM (SELECT DISTINCT design_id FROM act) d CROSS JOIN (VALUES "
    + ", ".join(f"('{k}', '{v}')" for k, v in _EXP)
    + ") AS e(kind, value) LEFT JOIN (SELECT DISTINCT * FROM act) a ON a.design_id = d.design_id AND a.kind = e.kind AND a.value = e.value GROUP BY 1, 2",
    {"act": "SELECT design_id, 'ref' AS kind, ref AS value FROM comps UNION ALL SELECT design_id, 'net', name FROM nets UNION ALL SELECT design_id, "
        "'pin', ref || '.' || number || '=' || name FROM pins"},
)(lambda t: quality.golden_recall(
    t.spark.createDataFrame(_EXP, "kind string, value string"),
    t.comps.selectExpr("design_id", "'ref' AS kind", "ref AS value").union(t.nets.selectExpr("design_id", "'net'", "name")).union(t.pins.selectExpr("design_id", "'pin'", "ref || '.' || number || '=' || name")),
))

# Evidence and the gate
_ANCH = "SELECT p_partkey AS owner_id, f AS field, CASE (p_partkey + i) % 8 WHEN 0 THEN 'datasheet_text' WHEN 1 THEN 'datasheet_table' WHEN 2 THEN 'ocr' WHEN 3 THEN 'model_inference' WHEN 4 THEN 'reviewer' WHEN 5 THEN 'default' WHEN 6 THEN NULL ELSE 'datasheet_drawing' END AS source_type, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE 'sha' END AS sha, CASE WHEN (p_partkey + i) % 5 = 0 THEN NULL ELSE p_partkey % 30 END AS page, (p_partkey + i) % 2 = 0 AS has_bbox, CASE WHEN (p_partkey + i) % 3 = 0 THEN '' ELSE 'seen' END AS quote FROM part CROSS JOIN (VALUES (0, 'pitch'), (1, 'height'), (2, 'body_length')) AS v(i, f)"
_AN = "SELECT owner_id, field, CASE WHEN dn THEN 'unverified' ELSE coalesce(source_type, 'unverified') END AS source_type, CASE WHEN dn THEN source_type END AS downgraded_from FROM (SELECT *, coalesce(source_type, '') IN ('datasheet_text', 'datasheet_table', 'datasheet_drawing', 'ocr') AND NOT coalesce(sha IS NOT NULL AND page >= 1 AND (has_bbox OR quote <> ''), FALSE) AS dn FROM anch)"


def _anchors(t):
    p = t.part.select("*", F.posexplode(F.array(*map(F.lit, ("pitch", "height", "body_length")))).alias("i", "f"))
    return evidence.evidence_anchor(p.selectExpr(
        "p_partkey AS owner_id", "f AS field", "CASE (p_partkey + i) % 8 WHEN 0 THEN 'datasheet_text' WHEN 1 THEN 'datasheet_table' WHEN 2 THEN 'ocr' WHEN 3 THEN 'model_inference' WHEN 4 "
            "THEN 'reviewer' WHEN 5 THEN 'default' WHEN 6 THEN NULL ELSE 'datasheet_drawing' END AS source_type",
        "CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE 'sha' END AS sha", "CASE WHEN (p_partkey + i) % 5 = 0 THEN NULL ELSE p_partkey % 30 END AS page", "(p_partkey + i) % 2 = 0 AS has_bbox", "CASE WHEN (p_partkey + i) % 3 = 0 THEN '' ELSE 'seen' END AS quote",
    ))


query("evidence_anchor", _AN, {"anch": _ANCH})(lambda t: _anchors(t))
query(
    "evidence_explode",
    "SELECT 'package' AS owner_kind, package_id::VARCHAR AS owner_id, field, CASE WHEN source = 'datasheet' AND package_id % 6 <> 0 THEN "
        "'datasheet_drawing' WHEN source = 'reviewer' THEN 'reviewer'"
    " WHEN source = 'missing' THEN 'default' ELSE 'unverified' END AS source_type FROM prov UNION ALL"
    " SELECT 'pin', package_id::VARCHAR || ':' || number, 'pin.' || f, CASE WHEN pos % 3 <> 0 THEN 'datasheet_table' ELSE 'unverified' END FROM "
        "clean CROSS JOIN (VALUES ('number'), ('name'), ('type'), ('description')) AS v(f)"
    " UNION ALL SELECT 'figure', doc_id::VARCHAR || ':' || line_no::VARCHAR, 'figure', CASE WHEN line_no % 2 = 0 THEN 'datasheet_drawing' ELSE "
        "'unverified' END FROM figs",
    CV | {k: LV[k] for k in ("titled", "kinded", "figs")},
)(lambda t: evidence.evidence_explode(
    cleaning.field_provenance(_pk(t)).withColumn("page", F.expr("CASE WHEN package_id % 6 <> 0 THEN package_id END")),
    cleaning.sanitize_pins(t.raw_pins).withColumn("page", F.expr("CASE WHEN pos % 3 <> 0 THEN pos END")),
    layout.figure_candidates(t.lines).selectExpr("doc_id || ':' || line_no AS figure_id", "CASE WHEN line_no % 2 = 0 THEN page END AS page"),
))
query("evidence_unbacked", "SELECT owner_id, string_agg(field, ',' ORDER BY field) AS fields FROM (SELECT owner_id, field FROM (" + _AN + ") GROUP BY 1, 2 HAVING NOT bool_or(source_type IN ('datasheet_text', 'datasheet_table', 'datasheet_drawing', 'ocr'))) GROUP BY 1", {"anch": _ANCH})(lambda t: evidence.evidence_unbacked(_anchors(t)))
_ITEM = {  # one row a package: every flag by the id
    "mock": "package_id % 41 = 0", "supported": "package_id % 10 <> 3", "valid": "CASE WHEN package_id % 9 = 0 THEN NULL ELSE package_id % 43 <> 0 END", "session": "CASE WHEN package_id % 29 = 0 THEN NULL ELSE package_id % 31 <> 0 END",
    "pins_review": "CASE WHEN package_id % 23 = 0 THEN NULL ELSE package_id % 5 = 0 END", "transformed": "package_id % 6 = 0", "land_source": "CASE package_id % 3 WHEN 0 THEN 'datasheet' WHEN 1 THEN 'derived_by_rules' ELSE 'reviewer_entered' END",
    "land_reviewer": "CASE WHEN package_id % 2 = 0 THEN 'ann' END", "has_model3d": "package_id % 4 <> 0", "has_pad": "package_id % 8 = 0",
    "confirmed_figures": "CASE WHEN package_id % 7 = 0 THEN 0 WHEN package_id % 7 = 1 THEN NULL ELSE 2 END", "blocked": "package_id % 47 = 0", "has_footprint": "package_id % 17 <> 0", "has_model_file": "package_id % 19 <> 0",
}
_PIN = "SELECT package_id, number, package_id % 3 = 0 AND pos = 2 AS edited, package_id % 2 = 0 AS anchored FROM clean"
_ANCHOR = "SELECT *, CASE WHEN owner_id % 3 = 0 THEN 'ann' END AS reviewer FROM an WHERE NOT (owner_id % 53 = 0)"
_FIGURE = "SELECT package_id, package_id % 4 = 0 AS confirmed, package_id % 3 <> 0 AS backed FROM packages"
_WARNING = "SELECT package_id, CASE WHEN package_id % 14 = 0 THEN 'body length derived' WHEN package_id % 15 = 0 THEN 'length and width swapped' ELSE 'fine' END AS text FROM packages"
_BLOCKED = {
    "mock_data": "mock", "unsupported_package_family": "NOT coalesce(supported, TRUE)", "validation_error": "NOT coalesce(valid, TRUE)", "no_authenticated_session": "NOT coalesce(session, FALSE)",
    "pin_data_transformed_requires_review": "coalesce(pins_review, TRUE)", "geometry_transformation_applied": "transformed", "land_pattern_derived_not_from_datasheet": "land_source = 'derived_by_rules'",
    "reviewer_edit_without_provenance": "land_source = 'reviewer_entered' AND land_reviewer IS NULL", "approximate_parametric_3d_not_vendor_step": "has_model3d", "no_confirmed_figures": "confirmed_figures <= 0",
    "missing_required_geometry": "blocked", "required_output_missing": "NOT blocked AND NOT (has_footprint AND has_model_file)",
}
GV = CV | {
    "anch": _ANCH,
    "an": _AN,
    "rev": REV_SQL,
    "gprov": PROV_SQL,
    "gitems": "SELECT package_id, pin_count, " + ", ".join(f"{e} AS {c}" for c, e in _ITEM.items()) + " FROM packages",
    "gpins": _PIN,
    "ganch": _ANCHOR,
    "reasons": "SELECT DISTINCT package_id, reason FROM ("
    + " UNION ALL ".join(f"SELECT package_id, '{r}' AS reason FROM gitems WHERE {c}" for r, c in _BLOCKED.items())
    + " UNION ALL SELECT package_id, CASE WHEN source = 'reviewer' AND reviewer IS NULL THEN 'reviewer_edit_without_provenance' WHEN source = "
        "'clamped' THEN 'value_out_of_range_clamped' WHEN source = 'invalid' THEN 'validation_error'"
    f" WHEN source = 'missing' AND {REL} THEN 'missing_required_geometry' END FROM gprov"
    " UNION ALL SELECT p.package_id, CASE WHEN k = 'reviewer' AND reviewer IS NULL THEN 'reviewer_edit_without_provenance' WHEN k = "
        "'model_inference' THEN 'field_evidence_model_inference' WHEN k = 'default' THEN 'field_evidence_default_value'"
    " WHEN k NOT IN ('reviewer', 'datasheet_text', 'datasheet_table', 'datasheet_drawing', 'ocr') THEN 'package_field_evidence_unverified' END "
        "FROM (SELECT package_id, a.reviewer, coalesce(a.source_type, 'unverified') AS k"
    f" FROM (SELECT package_id, field FROM gprov WHERE {REL}) g LEFT JOIN ganch a ON a.owner_id = g.package_id AND a.field = g.field) p"
    " UNION ALL SELECT package_id, 'pin_field_evidence_unverified' FROM gpins WHERE edited AND NOT anchored"
    " UNION ALL SELECT i.package_id, 'pin_count_or_number_conflict' FROM gitems i JOIN (SELECT package_id, count(*) AS n, count(DISTINCT number) "
        "AS d FROM gpins GROUP BY 1) n ON n.package_id = i.package_id"
    " WHERE n > d OR NOT (n = pin_count OR (has_pad AND n = pin_count + 1))"
    f" UNION ALL SELECT package_id, 'figure_evidence_missing' FROM ({_FIGURE}) WHERE confirmed AND NOT backed"
    " UNION ALL SELECT package_id, CASE WHEN text LIKE '%derived%' THEN 'rule_or_jedec_derived' WHEN text LIKE '%swapped%' THEN "
        f"'geometry_auto_corrected' END FROM ({_WARNING})"
    ") WHERE reason IS NOT NULL",
    "scope0": "SELECT * FROM (VALUES " + ", ".join(f"('{r}', '{a}')" for r, v in evidence.SCOPE.items() for a in v) + ") AS v(reason, asset)",
    "scope": "SELECT * FROM scope0 UNION ALL SELECT DISTINCT reason, a FROM reasons CROSS JOIN (VALUES ('symbol'), ('footprint'), ('model3d'), "
        "('figures')) AS v(a) WHERE reason NOT IN (SELECT reason FROM scope0)",
}


def _reasons(t):
    prov = cleaning.field_provenance(_odd(t), reviewed(t)).withColumn("relevant", F.array_contains(cleaning.relevant_fields(), F.col("field")))
    anchors = _anchors(t).where("owner_id % 53 <> 0").select(F.col("owner_id").alias("package_id"), "field", "source_type", F.expr("CASE WHEN owner_id % 3 = 0 THEN 'ann' END AS reviewer"))
    items = t.packages.selectExpr("package_id", "pin_count", *(f"{e} AS {c}" for c, e in _ITEM.items()))
    pins = cleaning.sanitize_pins(t.raw_pins).selectExpr("package_id", "number", "package_id % 3 = 0 AND pos = 2 AS edited", "package_id % 2 = 0 AS anchored")
    figures = t.packages.selectExpr("package_id", "package_id % 4 = 0 AS confirmed", "package_id % 3 <> 0 AS backed")
    warnings = t.packages.selectExpr("package_id", _WARNING.removeprefix("SELECT package_id, ").removesuffix(" FROM packages"))
    return evidence.gate_item(items, prov, anchors, pins, figures, warnings)


query("gate_item", "SELECT * FROM reasons", GV)(_reasons)
_WARN = "CASE event_id % 7 WHEN 0 THEN 'body length derived' WHEN 1 THEN 'length and width swapped' WHEN 2 THEN 'duplicate pin' WHEN 3 THEN 'symbol only' WHEN 4 THEN 'blocked_missing_geometry' ELSE 'fine' END"
query("gate_warning_map", "SELECT DISTINCT event_id % 100 AS item_id, CASE event_id % 7 WHEN 0 THEN 'rule_or_jedec_derived' WHEN 1 THEN 'geometry_auto_corrected' WHEN "
    "2 THEN 'pin_count_or_number_conflict' WHEN 3 THEN 'unsupported_package_family' ELSE 'missing_required_geometry' END AS reason FROM ev WHERE "
    "event_id % 7 < 5")(
    lambda t: evidence.gate_warning_map(t.ev.selectExpr("event_id % 100 AS item_id", f"{_WARN} AS text"))
)
query("gate_scope", "SELECT r.package_id, s.asset, string_agg(DISTINCT r.reason, ',' ORDER BY r.reason) AS reasons FROM reasons r JOIN scope s ON s.reason = "
    "r.reason GROUP BY 1, 2", GV)(lambda t: evidence.gate_scope(_reasons(t)))
query(
    "gate_bundle",
    "SELECT k.key, coalesce(string_agg(DISTINCT r, ',' ORDER BY r), '') AS reasons, count(r) = 0 AS promotable FROM (SELECT package_id, a AS "
        "asset, a || ':' || package_id::VARCHAR AS key FROM packages CROSS JOIN (VALUES ('footprint'), ('symbol'), ('figures')) AS v(a)) k"
    " LEFT JOIN (SELECT r.package_id, s.asset, r.reason AS r FROM reasons r JOIN scope s ON s.reason = r.reason WHERE r.reason <> 'figure_evidence_missing'"
    " UNION ALL SELECT package_id, 'symbol', 'mock_data' FROM packages WHERE package_id % 13 = 0) x ON x.package_id = k.package_id AND x.asset = k.asset GROUP BY 1",
    GV,
)(lambda t: evidence.gate_bundle(
    t.packages.selectExpr("package_id", "explode(array('footprint', 'symbol', 'figures')) AS asset").selectExpr("*", "asset || ':' || package_id AS key"), evidence.gate_scope(_reasons(t)),
    t.packages.where("package_id % 13 = 0").selectExpr("'symbol:' || package_id AS key", "'mock_data' AS reason"),
))

# Review and lifecycle
_RNG = " ".join(f"WHEN 'packages/{k}' THEN n NOT BETWEEN {lo} AND {hi}" for k, (lo, hi, _) in cleaning.FIELDS.items())
_BOX = "coalesce(len({0}) = 4 AND list_min({0}) >= 0 AND list_max({0}) <= 1 AND {0}[1] < {0}[3] AND {0}[2] < {0}[4], FALSE)"
_EVIDENCE = (
    "CASE evidence WHEN '{\"page\": 0}' THEN 'evidence_page' WHEN '{\"bbox\": [0, 0, 2, 1]}' THEN 'evidence_bbox'"
    " WHEN '{\"colour\": 1}' THEN 'evidence_unknown_field' WHEN '[1]' THEN 'evidence_not_an_object' END"
)
_ERR = (
    f"CASE WHEN path = 'packages/unknown' THEN 'unknown_field' WHEN {_EVIDENCE} IS NOT NULL THEN {_EVIDENCE}"
    " WHEN trim(reason) = '' AND coalesce(evidence, '') NOT IN ('{\"page\": 3}', '{\"note\": \"seen\"}') THEN 'reason_missing'"
    " WHEN path LIKE 'packages/%' AND NOT (path = 'packages/lead_width' AND value IS NULL) THEN CASE"
    " WHEN n IS NULL OR NOT isfinite(n) THEN 'not_a_number' WHEN path = 'packages/pin_count' AND n <> floor(n) THEN 'not_whole'"
    f" WHEN CASE path {_RNG} WHEN 'packages/pin_count' THEN n NOT BETWEEN 2 AND 256 WHEN 'packages/lead_width' THEN n NOT BETWEEN 0.05 AND 5 END THEN 'out_of_range' END"
    " WHEN path = 'pins/type' AND value IS DISTINCT FROM 'input' THEN 'unknown_type'"
    " WHEN path = 'figures/kind' AND value IS DISTINCT FROM 'application' THEN 'unknown_kind'"
    " WHEN path = 'figures/confirmed' AND (value IS NULL OR value NOT IN ('true', 'false')) THEN 'not_a_boolean'"
    " WHEN path = 'figures/page' AND NOT coalesce(n >= 1 AND n = floor(n), FALSE) THEN 'not_a_page'"
    f" WHEN path = 'figures/bbox' AND NOT {_BOX.format('box')} THEN 'not_a_box' END"
)
query("patch_validate", f"SELECT event_id, job_id, path, value, {_ERR} AS error FROM (SELECT *, try_cast(value AS DOUBLE) AS n, CASE WHEN value LIKE '[%' THEN "
    "try_cast(value AS DOUBLE[]) END AS box FROM edits)")(lambda t: review.patch_validate(t.edits))
_OLD = "SELECT package_id AS id, 'name' || CAST(pos AS VARCHAR(9)) AS field, name AS value FROM raw_pins"
_NEW = "SELECT package_id AS id, 'name' || CAST(pos AS VARCHAR(9)) AS field, CASE WHEN package_id % 5 = pos THEN name || 'n' ELSE name END AS value FROM raw_pins WHERE (package_id + pos) % 11 <> 0 UNION ALL SELECT package_id, 'name9', 'new' FROM packages WHERE package_id % 6 = 0"
_old = lambda t: t.raw_pins.selectExpr("package_id AS id", "'name' || pos AS field", "name AS value")
query("patch_diff", "SELECT coalesce(o.id, n.id) AS id, coalesce(o.field, n.field) AS field, CASE WHEN o.id IS NULL THEN 'add' WHEN n.id IS NULL THEN 'remove' "
    "ELSE 'update' END AS op, o.value AS before, n.value AS after FROM o FULL JOIN n ON o.id = n.id AND o.field = n.field WHERE o.id IS NULL OR "
    "n.id IS NULL OR o.value IS DISTINCT FROM n.value", {"o": _OLD, "n": _NEW})(
    lambda t: review.patch_diff(_old(t), _revised(t))
)


def _revised(t):
    kept = t.raw_pins.where("(package_id + pos) % 11 <> 0").selectExpr("package_id AS id", "'name' || pos AS field", "CASE WHEN package_id % 5 = pos THEN name || 'n' ELSE name END AS value")
    return kept.union(t.packages.where("package_id % 6 = 0").selectExpr("package_id", "'name9'", "'new'"))


_EDS = "SELECT package_id AS id, 'name' || CAST(pos + pos % 3 AS VARCHAR(9)) AS field, CASE WHEN (package_id + pos) % 4 = 0 THEN 'remove' ELSE 'update' END AS op, 'e' || CAST(pos AS VARCHAR(9)) AS value, pos AS seq, 'r' || CAST(pos AS VARCHAR(9)) AS reviewer, CASE WHEN pos = 3 THEN NULL ELSE 'why' END AS reason, CASE WHEN pos % 2 = 0 THEN pos END AS page FROM raw_pins"
_eds = lambda t: t.raw_pins.selectExpr("package_id AS id", "'name' || (pos + pos % 3) AS field", "CASE WHEN (package_id + pos) % 4 = 0 THEN 'remove' ELSE 'update' END AS op", "'e' || pos AS value", "pos AS seq", "'r' || pos AS reviewer", "CASE WHEN pos = 3 THEN NULL ELSE 'why' END AS reason", "CASE WHEN pos % 2 = 0 THEN pos END AS page")
_APPLY = "SELECT coalesce(o.id, l.id) AS id, coalesce(o.field, l.field) AS field, CASE WHEN l.id IS NOT NULL THEN l.value ELSE o.value END AS value, l.id IS NOT NULL AS reviewed, CASE WHEN l.id IS NOT NULL THEN 'reviewer' END AS source_type, l.reviewer, CASE WHEN l.id IS NOT NULL THEN coalesce(l.reason, '') END AS reason, l.page FROM o FULL JOIN (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY id, field ORDER BY seq DESC) = 1) l ON l.id = o.id AND l.field = o.field WHERE l.op IS NULL OR l.op <> 'remove'"
query("patch_apply", f"SELECT * REPLACE (coalesce(page, -1) AS page) FROM ({_APPLY})", {"o": _OLD, "e": _EDS})(lambda t: review.patch_apply(_old(t), _eds(t)).na.fill(-1, ["page"]))
query("change_log", "SELECT coalesce(o.id, n.id) AS id, coalesce(o.field, n.field) AS field, CASE WHEN o.id IS NULL THEN 'add' WHEN n.id IS NULL THEN 'remove' "
    "ELSE 'update' END AS op, o.value AS before, n.value AS after FROM o FULL JOIN (" + _APPLY + ") n ON o.id = n.id AND o.field = n.field WHERE o.id IS NULL OR n.id IS NULL OR o.value IS DISTINCT FROM n.value", {"o": _OLD, "e": _EDS})(lambda t: review.change_log(_old(t), _eds(t)))
query("asset_keys", "SELECT 'symbol' AS kind, 'symbol:' || k::VARCHAR AS key FROM (SELECT DISTINCT package_id % 20 AS k FROM packages) UNION ALL SELECT "
    "'footprint', 'footprint:' || package_id::VARCHAR FROM packages UNION ALL SELECT 'model3d', 'model3d:' || package_id::VARCHAR FROM packages "
    "UNION ALL SELECT 'figure', 'figure:' || doc_id::VARCHAR FROM (SELECT DISTINCT doc_id FROM lines)")(
    lambda t: review.asset_keys(t.packages.selectExpr("package_id % 20 AS k").distinct(), t.packages.select("package_id"), t.lines.select("doc_id").distinct())
)
query("lifecycle_state", LIFECYCLE_SQL, LIFECYCLE)(lambda t: review.lifecycle_state(t.lifecycle))
_PATH = (
    "CASE event_id % 7 WHEN 0 THEN 'packages[' || CAST(k AS VARCHAR(9)) || '].pitch' WHEN 1 THEN 'pinsets[' || CAST(k % 20 AS VARCHAR(9)) || '].pin[3].name'"
    " WHEN 2 THEN 'figures[' || CAST(k AS VARCHAR(9)) || '].title' WHEN 3 THEN CASE WHEN k % 10 = 0 THEN 'part.mpn' ELSE 'partial' END"
    " WHEN 4 THEN CASE WHEN k % 9 = 0 THEN 'packages[' || CAST(k AS VARCHAR(9)) || '].pinset_id' ELSE 'other' END ELSE 'other' END"
)
_CHANGES = f"SELECT user_id % 200 AS job_id, {_PATH} AS path FROM ev"
_OWNED = "SELECT package_id % 200 AS job_id, package_id % 100 AS package_id, package_id % 20 AS pinset_id FROM packages"
_APPROVED = "SELECT DISTINCT job_id, a || ':' || CAST(CASE WHEN a = 'symbol' THEN pinset_id ELSE package_id END AS VARCHAR(9)) AS key FROM owned CROSS JOIN (VALUES ('symbol'), ('footprint'), ('model3d'), ('figure')) AS v(a) WHERE (package_id + job_id) % 3 <> 0"
_LAPSED = """
SELECT a.job_id, a.key FROM approved a JOIN (
  SELECT job_id, 'footprint:' || i AS key FROM c WHERE kind = 'packages' UNION SELECT job_id, 'model3d:' || i FROM c WHERE kind = 'packages'
  UNION SELECT job_id, 'symbol:' || i FROM c WHERE kind = 'pinsets' UNION SELECT job_id, 'figure:' || i FROM c WHERE kind = 'figures'
  UNION SELECT c.job_id, 'footprint:' || o.package_id::VARCHAR FROM c JOIN owned o ON o.job_id = c.job_id AND o.pinset_id::VARCHAR = c.i WHERE kind = 'pinsets'
  UNION SELECT c.job_id, 'model3d:' || o.package_id::VARCHAR FROM c JOIN owned o ON o.job_id = c.job_id AND o.pinset_id::VARCHAR = c.i WHERE kind = 'pinsets'
) n ON n.job_id = a.job_id AND n.key = a.key
UNION SELECT a.job_id, a.key FROM approved a JOIN c ON c.job_id = a.job_id WHERE c.path LIKE 'part.%'
UNION SELECT a.job_id, a.key FROM approved a JOIN c ON c.job_id = a.job_id WHERE c.path LIKE 'packages[%].pinset_id' AND a.key LIKE 'symbol:%'
"""


def _owned(t):
    return t.packages.selectExpr("package_id % 200 AS job_id", "package_id % 100 AS package_id", "package_id % 20 AS pinset_id")


def _approved(t):
    each = _owned(t).selectExpr("*", "explode(array('symbol', 'footprint', 'model3d', 'figure')) AS a").where("(package_id + job_id) % 3 <> 0")
    return each.selectExpr("job_id", "a || ':' || CASE WHEN a = 'symbol' THEN pinset_id ELSE package_id END AS key").distinct()


query(
    "approvals_invalidated",
    _LAPSED,
    {
        "owned": _OWNED,
        "approved": _APPROVED,
        "c": f"SELECT DISTINCT job_id, path, regexp_extract(path, '^(\\w+)', 1) AS kind, regexp_extract(path, '^\\w+\\[([^\\]]+)\\]', 1) AS i FROM ({_CHANGES})",
    },
)(lambda t: review.approvals_invalidated(t.ev.selectExpr("user_id % 200 AS job_id", f"{_PATH} AS path"), _owned(t), _approved(t)))
_APP = "CASE WHEN job_id % 3 = 0 THEN NULL ELSE 'h' || CAST(job_id % 5 AS VARCHAR(9)) END"
query("approval_valid", f"SELECT j.job_id::VARCHAR AS key, coalesce(a.rev = j.job_id % 4 AND ({_APP} IS NULL OR a.h = {_APP}), FALSE) AS valid FROM jobs j LEFT JOIN "
    "(SELECT job_id AS a_id, job_id % 8 AS rev, 'h' || (job_id % 7)::VARCHAR AS h FROM jobs WHERE job_id % 5 <> 0) a ON a.a_id = j.job_id")(
    lambda t: review.approval_valid(t.jobs.where("job_id % 5 <> 0").selectExpr("CAST(job_id AS STRING) AS key", "job_id % 8 AS revision", "'h' || (job_id % 7) AS hash"), t.jobs.selectExpr("CAST(job_id AS STRING) AS key", "job_id % 4 AS revision", f"{_APP} AS hash"))
)
_PUB = "SELECT job_id, a || ':' || CAST(event_id % 40 AS VARCHAR(9)) AS key, expected_revision AS revision, event_id % 3 = 0 AS approved FROM edits CROSS JOIN (VALUES ('footprint'), ('symbol')) AS v(a)"
query(
    "asset_versions",
    "SELECT * FROM vers UNION ALL SELECT job_id + 1000000, version, revision, FALSE, conflict FROM vers WHERE job_id % 5 = 0",
    {"pub": _PUB, "vers": "SELECT job_id, key || '@r' || revision::VARCHAR AS version, revision, bool_and(approved) AS approved, count(*) > 1 AS conflict FROM pub "
        "WHERE key NOT LIKE '%:7' GROUP BY job_id, key, revision"},
)(lambda t: _versions(t))


def _versions(t):
    pub = t.edits.selectExpr("job_id", "explode(array('footprint', 'symbol')) AS a", "event_id", "expected_revision AS revision")
    pub = pub.selectExpr("job_id", "a || ':' || (event_id % 40) AS key", "revision", "event_id % 3 = 0 AS approved")
    versions = review.asset_versions(pub.select("job_id", "key").where("key not like '%:7'").distinct(), pub)
    return review.asset_fork(versions, t.edits.select("job_id").distinct().where("job_id % 5 = 0").selectExpr("job_id", "job_id + 1000000 AS new_job_id"))


# Jobs of packages with the files of their symbols, footprints and models; some files are missing, and figures may lack an image
_JOB_FILES = (
    "SELECT package_id % 40 AS job_id, 'symbol' AS kind, package_id % 30 AS owner, CAST(package_id % 30 AS VARCHAR(9)) || '.sym' AS path, type AS content FROM packages"
    " UNION ALL SELECT package_id % 40, 'footprint', package_id, CAST(package_id AS VARCHAR(9)) || '.mod', type || CAST(pin_count AS VARCHAR(9)) FROM packages"
    " UNION ALL SELECT package_id % 40, 'model3d', package_id, CAST(package_id AS VARCHAR(9)) || '.wrl', type FROM packages WHERE package_id % 9 <> 0"
    " UNION ALL SELECT package_id % 40, 'figure', package_id, CAST(package_id AS VARCHAR(9)) || '.png', 'image' FROM packages WHERE package_id % 4 <> 0"
)
_JOB_KEYS = (
    "SELECT job_id, kind, owner, kind || ':' || CAST(owner AS VARCHAR(9)) AS key, CASE WHEN kind = 'figure' THEN '0.1,0.2,0.3,0.' || CAST(owner % 10 AS VARCHAR(9)) END AS instead FROM ("
    "SELECT DISTINCT package_id % 40 AS job_id, v.kind, CASE WHEN v.kind = 'symbol' THEN package_id % 30 ELSE package_id END AS owner FROM packages CROSS JOIN (VALUES ('symbol'), ('footprint'), ('model3d'), ('figure')) AS v(kind))"
)

JOB_VIEWS = {"jobfiles": _JOB_FILES, "jobkeys": _JOB_KEYS}


def _job_files(t):
    kind = lambda name, owner, ending, content, some="true": t.packages.where(some).selectExpr("package_id % 40 AS job_id", f"'{name}' AS kind", f"{owner} AS owner", f"{owner} || '{ending}' AS path", f"sha2({content}, 256) AS sha")
    return (
        kind("symbol", "package_id % 30", ".sym", "type").union(kind("footprint", "package_id", ".mod", "type || pin_count"))
        .union(kind("model3d", "package_id", ".wrl", "type", "package_id % 9 <> 0")).union(kind("figure", "package_id", ".png", "'image'", "package_id % 4 <> 0"))
    )


def _job_keys(t):
    k = t.packages.select("package_id", F.explode(F.array(*map(F.lit, ("symbol", "footprint", "model3d", "figure")))).alias("kind"))
    k = k.selectExpr("package_id % 40 AS job_id", "kind", "CASE WHEN kind = 'symbol' THEN package_id % 30 ELSE package_id END AS owner").distinct()
    return k.selectExpr("*", "kind || ':' || owner AS key", "CASE WHEN kind = 'figure' THEN '0.1,0.2,0.3,0.' || owner % 10 END AS instead")


query(
    "asset_hashes",
    "SELECT * FROM (WITH one AS (SELECT k.job_id, k.key, sha256(coalesce(f.lines, k.instead, '')) AS hash, coalesce(f.n, 0) AS files FROM jobkeys k LEFT JOIN (SELECT job_id, kind, owner, string_agg(line, chr(10) ORDER BY line) AS lines, count(*) AS n "
    "FROM (SELECT DISTINCT job_id, kind, owner, path || ' ' || sha256(content) AS line FROM jobfiles) GROUP BY 1, 2, 3) f ON f.job_id = k.job_id AND f.kind = k.kind AND f.owner = k.owner) "
    "SELECT * FROM one UNION ALL SELECT job_id, 'revision', sha256(string_agg(key || ' ' || hash, chr(10) ORDER BY key || ' ' || hash)), CAST(sum(files) AS BIGINT) FROM one GROUP BY 1)",
    JOB_VIEWS,
)(lambda t: review.asset_hashes(_job_files(t), _job_keys(t)))
query("can_publish", "SELECT job_id::VARCHAR AS key, job_id % 2 = 0 AND job_id % 3 = 0 AND tenant <> 1 AS can_publish FROM jobs")(lambda t: review.can_publish(t.jobs.selectExpr("CAST(job_id AS STRING) AS key", "job_id % 2 = 0 AS approved", "job_id % 3 = 0 AS promotable", "tenant <> 1 AS publisher")))
_ROLE = "CASE event_id % 5 WHEN 0 THEN 'Publisher' WHEN 1 THEN 'reviewer' WHEN 2 THEN 'editor' WHEN 3 THEN 'viewer' ELSE 'guest' END"
_NEED = "CASE k % 3 WHEN 0 THEN 'viewer' WHEN 1 THEN 'editor' ELSE 'publisher' END"
query("role_access", "SELECT event_id AS request_id, CASE WHEN user_id % 5 <> k % 5 AND k % 4 = 0 THEN 'tenant_mismatch' WHEN k % 2 = 1 AND event_id % 5 > 1 THEN "
    f"'not_job_owner' WHEN ({_NEED}) = 'publisher' AND event_id % 5 <> 0 THEN 'insufficient_role' WHEN ({_NEED}) = 'editor' AND event_id % 5 > 2 "
    "THEN 'insufficient_role' ELSE 'ok' END AS result FROM ev")(
    lambda t: review.role_access(t.ev.selectExpr("event_id AS request_id", "user_id % 5 AS tenant", "user_id AS user", f"{_ROLE} AS role", "CASE WHEN k % 4 = 0 THEN k % 5 ELSE user_id % 5 END AS job_tenant", "CASE WHEN k % 2 = 1 THEN user_id + 1 ELSE user_id END AS owner", f"{_NEED} AS need"))
)
query("revision_conflicts", "SELECT event_id, job_id, expected_revision, CASE WHEN row_number() OVER (PARTITION BY job_id, expected_revision ORDER BY ts, event_id) = 1 "
    "THEN 'ok' ELSE 'revision_conflict' END AS result FROM edits")(lambda t: review.revision_conflicts(t.edits))
# Requests of which some have no key; a job lives for two days, and errors revoke the job of the click with their key
_KEYED = "CASE WHEN event_id % 11 = 0 THEN NULL ELSE key END"
TTL = 2 * 86_400
_SCOPE = "sha256(concat_ws(chr(0), tenant::VARCHAR, owner::VARCHAR, {op}, doc::VARCHAR, key::VARCHAR))"
SCOPES = {
    "asked": f"SELECT CASE WHEN key IS NOT NULL THEN {_SCOPE.format(op='operation')} END AS scope, ts, event_id, FALSE AS clears FROM (SELECT * REPLACE ({_KEYED} AS key) FROM requests)",
    "turns": f"SELECT *, row_number() OVER (PARTITION BY scope ORDER BY ts, clears, event_id) AS i FROM (SELECT * FROM asked WHERE scope IS NOT NULL UNION ALL SELECT {_SCOPE.format(op=repr('click'))}, ts, NULL, TRUE FROM requests WHERE operation = 'error')",
}
query(
    "idempotency_scope",
    "SELECT event_id, scope, job, reused FROM (WITH RECURSIVE f AS (SELECT scope, 0::BIGINT AS i, NULL::BIGINT AS event_id, NULL::BIGINT AS job, NULL::TIMESTAMP AS since, FALSE AS reused FROM (SELECT DISTINCT scope FROM turns)"
    " UNION ALL SELECT r.scope, r.i, r.event_id, CASE WHEN r.clears THEN NULL WHEN again THEN f.job ELSE r.event_id END, CASE WHEN r.clears THEN NULL WHEN again THEN f.since ELSE r.ts END, again"
    f" FROM f JOIN turns r ON r.scope = f.scope AND r.i = f.i + 1, LATERAL (SELECT coalesce(f.job IS NOT NULL AND r.ts <= f.since + to_seconds({TTL}), FALSE) AND NOT r.clears AS again) z) SELECT * FROM f) WHERE event_id IS NOT NULL"
    " UNION ALL SELECT event_id, scope, event_id, FALSE FROM asked WHERE scope IS NULL",
    SCOPES,
)(lambda t: review.idempotency_scope(t.requests.withColumn("key", F.expr(_KEYED)), TTL, t.requests.where("operation = 'error'").withColumn("operation", F.lit("click")).select(review.scope_key().alias("scope"), "ts")))
query(
    "reap_expired",
    "SELECT job_id, status, CASE WHEN status = 'active' THEN scope END AS scope, CASE WHEN was = 'revoked' THEN 'job_revoked' WHEN over THEN 'job_expired' END AS code FROM ("
    "SELECT job_id, status AS was, CASE WHEN status = 'active' AND over THEN 'expired' ELSE status END AS status, over, 's' || job_id::VARCHAR AS scope FROM ("
    "SELECT *, TIMESTAMP '1997-06-01 00:00:00' > created + to_days(CAST(ttl_days AS INT)) AS over FROM jobs))",
)(lambda t: review.reap_expired(t.jobs.withColumn("scope", F.concat(F.lit("s"), F.col("job_id").cast("string"))), "1997-06-01 00:00:00"))
_DIFF = "SELECT '{area}' AS area, path, CASE WHEN f IS NULL THEN 'missing' WHEN m IS NULL THEN 'extra' ELSE 'changed' END AS problem FROM ({rows}) WHERE m IS DISTINCT FROM f"
query(
    "manifest_check",
    _DIFF.format(area="files", rows="SELECT package_id::VARCHAR AS path, CASE WHEN package_id % 7 <> 0 THEN type END AS m, CASE WHEN package_id % 5 = 0 THEN NULL WHEN package_id "
        "% 11 = 0 THEN 'x' ELSE type END AS f FROM packages")
    + " UNION ALL "
    + _DIFF.format(area="data", rows="SELECT package_id::VARCHAR || '/pin_count' AS path, CASE WHEN package_id % 17 <> 0 THEN pin_count END AS m, CASE WHEN package_id % 19 = 0 "
        "THEN pin_count + 1 WHEN package_id % 23 <> 0 THEN pin_count END AS f FROM packages"),
)(lambda t: review.manifest_check(
    t.packages.where("package_id % 7 <> 0").selectExpr("CAST(package_id AS STRING) AS path", "type AS sha"),
    t.packages.where("package_id % 5 <> 0").selectExpr("CAST(package_id AS STRING) AS path", "CASE WHEN package_id % 11 = 0 THEN 'x' ELSE type END AS sha"),
    t.packages.where("package_id % 17 <> 0").selectExpr("package_id || '/pin_count' AS path", "pin_count AS value"),
    t.packages.where("package_id % 23 <> 0 or package_id % 19 = 0").selectExpr("package_id || '/pin_count' AS path", "CASE WHEN package_id % 19 = 0 THEN pin_count + 1 ELSE pin_count END AS value"),
))
query("audit_trail", "SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS step, action, event_id FROM lifecycle")(lambda t: review.audit_trail(t.lifecycle))
query("wallet_balance", "SELECT principal, CAST(sum(CASE WHEN op = 'topup' THEN amount ELSE 0 END) AS BIGINT) AS granted, CAST(sum(CASE WHEN op = 'reserve' THEN "
    "amount ELSE 0 END) AS BIGINT) AS spent, CAST(sum(CASE WHEN op = 'topup' THEN amount WHEN op = 'reserve' THEN -amount ELSE 0 END) AS BIGINT) "
    "AS balance FROM ledger GROUP BY 1")(lambda t: review.wallet_balance(t.ledger))
query("ledger_fold", LEDGER_SQL, LEDGER)(lambda t: review.ledger_fold(t.ledger))
del n
