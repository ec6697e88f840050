"""Queries of the cleaning operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetgraph.operators import cleaning as o
from sheetgraph.operators.netlist import PIN_TYPES
from sheetgraph.plans.registry import query

_TYPES = ", ".join(f"'{x}'" for x in PIN_TYPES)
_FAM = " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for n, p in o.FAMILY_RULES)
_EP = o.EP_ALIAS
_IN = lambda fields: "field IN (" + ", ".join(f"'{f}'" for f in fields) + ")"
#: Whether a family needs a field, and the default of a field.
REL = "CASE family " + " ".join(f"WHEN '{k}' THEN {_IN(v)}" for k, v in o.CRITICAL.items()) + f" ELSE {_IN(o.CRITICAL_ELSE)} END"
DEF = "CASE " + " ".join(f"WHEN family = 'qfn' AND field = '{k}' THEN {v}" for k, v in o.QFN_DEFAULTS.items()) + " ELSE def END"
V = {
    "ex": "SELECT *, row_number() OVER (PARTITION BY package_id, upper(number) ORDER BY pos, part) AS seen FROM (SELECT package_id, pos, z[1] - 1 AS "
        "part, z[2] AS number, name, type FROM (SELECT package_id, pos, unnest(list_zip(range(1, len(s) + 1), s)) AS z, CASE WHEN trim(coalesce(name, "
        f"'')) = '' THEN 'NC' ELSE trim(name) END AS name, CASE WHEN type IN ({_TYPES}) THEN type ELSE 'unspecified' END AS type FROM (SELECT *, "
        f"list_filter(regexp_split_to_array(number, '{o.SPLIT}'), lambda x: x <> '') AS s FROM raw_pins WHERE number IS NOT NULL)))",
    "clean": "SELECT package_id, pos, CAST(part AS INT) AS part, number, name, type FROM ex WHERE seen = 1",
    "fam0": f"SELECT *, CASE WHEN regexp_matches(t, '{o.BGA}') AND NOT regexp_matches(t, 'LFCSP') THEN 'bga' ELSE CASE {_FAM} ELSE 'unknown' END END AS f "
        "FROM (SELECT *, upper(type) AS t FROM packages)",
    "fam": "SELECT *, CASE WHEN f = 'sot23' AND pin_count <> 3 THEN 'dual' ELSE f END AS family FROM fam0",
    "longs": " UNION ALL ".join(
        f"SELECT package_id, family, '{k}' AS field, {k} AS raw, {lo}::DOUBLE AS lo, {hi}::DOUBLE AS hi, {d}::DOUBLE AS def FROM fam" for k, (lo, hi, d) in o.FIELDS.items()
    ),
    "prov": f"SELECT package_id, family, field, CASE WHEN raw IS NULL THEN CASE WHEN {REL} THEN 'missing' ELSE 'not_applicable' END"
    f" WHEN raw < lo OR raw > hi THEN 'clamped' ELSE 'datasheet' END AS source, raw, CASE WHEN raw IS NULL THEN {DEF} ELSE least(hi, greatest(lo, raw)) END AS value,"
    " NULL::VARCHAR AS reviewer FROM longs",
}


def _pk(t):
    return t.packages.join(o.package_family(t.packages).select("package_id", "family"), "package_id")


query("sanitize_pins", "SELECT * FROM clean", V)(lambda t: o.sanitize_pins(t.raw_pins))
query(
    "renumber_ep",
    "SELECT package_id, pos, part, CASE WHEN ep THEN (coalesce(max(try_cast(CASE WHEN regexp_matches(number, '^[0-9]+$') THEN number END AS "
        "BIGINT)) OVER (PARTITION BY package_id), 0) + CAST(sum(ep::INT) OVER (PARTITION BY package_id ORDER BY pos, part) AS BIGINT))::VARCHAR ELSE "
        f"number END AS number, CASE WHEN ep AND (name = 'NC' OR regexp_matches(name, '(?i){_EP}')) THEN 'EP' ELSE name END AS name, CASE WHEN ep AND "
        f"type = 'unspecified' THEN 'passive' ELSE type END AS type, ep FROM (SELECT *, regexp_matches(number, '(?i){_EP}') AS ep FROM clean)",
    V,
)(lambda t: o.renumber_ep(o.sanitize_pins(t.raw_pins)))
query(
    "transformation_log",
    "SELECT package_id, op, count(*) AS n FROM (SELECT package_id, 'drop_row' AS op FROM raw_pins WHERE number IS NULL UNION ALL SELECT "
        "package_id, 'empty_name_to_nc' FROM raw_pins WHERE number IS NOT NULL AND trim(coalesce(name, '')) = '' UNION ALL SELECT package_id, "
        f"'invalid_type_fallback' FROM raw_pins WHERE number IS NOT NULL AND type NOT IN ({_TYPES}) UNION ALL SELECT package_id, 'merged_row_expanded' "
        "FROM raw_pins WHERE contains(number, ',') UNION ALL SELECT package_id, 'duplicate_number_dropped' FROM ex WHERE seen > 1 UNION ALL SELECT "
        f"package_id, 'ep_renumbered' FROM ex WHERE seen = 1 AND regexp_matches(number, '(?i){_EP}')) GROUP BY 1, 2",
    V,
)(lambda t: o.transformation_log(t.raw_pins))
_ED = "CASE WHEN package_id % 7 = 0 AND pos = 2 THEN 'update' WHEN package_id % 5 = 0 AND pos = 3 THEN 'remove' WHEN package_id % 4 = 0 AND pos = 8 THEN 'add' END"
query(
    "pinset_overlay",
    f"""SELECT c.package_id, c.number, coalesce(u.name, c.name) AS name, u.name IS NOT NULL AS reviewed FROM clean c LEFT JOIN ed u ON u.package_id = c.package_id AND u.number = c.number AND u.action = 'update'
      WHERE NOT EXISTS (SELECT 1 FROM ed r WHERE r.package_id = c.package_id AND r.number = c.number AND r.action = 'remove')
      UNION ALL SELECT package_id, number, name, TRUE FROM ed a WHERE action = 'add' AND NOT EXISTS (SELECT 1 FROM clean c WHERE c.package_id = a.package_id AND c.number = a.number)""",
    V | {"ed": f"SELECT package_id, CASE WHEN pos = 8 THEN '88' ELSE pos::VARCHAR END AS number, {_ED} AS action, 'R' || pos::VARCHAR AS name FROM raw_pins "
        f"WHERE {_ED} IS NOT NULL"},
)(lambda t: o.pinset_overlay(o.sanitize_pins(t.raw_pins), t.raw_pins.selectExpr("package_id", "CASE WHEN pos = 8 THEN '88' ELSE CAST(pos AS STRING) END AS number", f"{_ED} AS action", "'R' || pos AS name").where("action is not null")))
query("package_family", "SELECT package_id, type, family, family IN ('dual', 'qfn', 'dip', 'sot23') AS supported FROM fam", V)(lambda t: o.package_family(t.packages))
# Some values are no numbers, some are set by reviewers: one within range, one beyond, and one by nobody known.
_ODD = "CASE WHEN field = 'body_width' AND package_id % 37 = 0 THEN CAST('NaN' AS DOUBLE) ELSE raw END"
REVIEWED = [("pitch", 4, "0.8", "'ann'"), ("height", 5, "99.0", "'bob'"), ("body_length", 6, "3.0", "NULL")]
_REV = " UNION ALL ".join(f"SELECT package_id, '{f}' AS field, {v}::DOUBLE AS edited, TRUE AS by_hand, {who}::VARCHAR AS reviewer FROM packages WHERE package_id % 13 = "
    f"{k}" for f, k, v, who in REVIEWED)
_PROV = f"""
SELECT package_id, family, field, CASE WHEN by_hand THEN CASE WHEN g < lo OR g > hi THEN 'clamped' ELSE 'reviewer' END
  WHEN g IS NULL THEN CASE WHEN {REL} THEN 'missing' ELSE 'not_applicable' END WHEN isnan(g) THEN 'invalid' WHEN g < lo OR g > hi THEN 'clamped' ELSE 'datasheet' END AS source,
  raw, CASE WHEN g IS NULL OR isnan(g) THEN {DEF} ELSE least(hi, greatest(lo, g)) END AS value, reviewer
FROM (SELECT l.package_id, family, l.field, l.raw, lo, hi, def, by_hand, reviewer, CASE WHEN by_hand THEN edited ELSE l.raw END AS g
  FROM (SELECT * REPLACE ({_ODD} AS raw) FROM longs) l LEFT JOIN rev r ON r.package_id = l.package_id AND r.field = l.field)
"""


PROV_SQL, REV_SQL = _PROV, _REV


def reviewed(t):
    rows = [t.packages.where(f"package_id % 13 = {k}").selectExpr("package_id", f"'{f}' AS field", f"CAST({v} AS DOUBLE) AS value", f"CAST({who} AS STRING) AS reviewer") for f, k, v, who in REVIEWED]
    return rows[0].union(rows[1]).union(rows[2])


def _odd(t):
    return _pk(t).withColumn("body_width", F.expr("CASE WHEN package_id % 37 = 0 THEN CAST('NaN' AS DOUBLE) ELSE body_width END"))


query("field_provenance", _PROV, V | {"rev": _REV})(lambda t: o.field_provenance(_odd(t), reviewed(t)))
query(
    "optional_fields",
    "SELECT package_id, field, CASE WHEN raw IS NULL OR raw = 0 THEN 'absent' WHEN isnan(raw) THEN 'invalid' WHEN raw < lo OR raw > hi THEN 'clamped' ELSE 'datasheet' END AS "
        "source, CASE WHEN raw IS NOT NULL AND raw <> 0 AND NOT isnan(raw) THEN least(hi, greatest(lo, raw)) END AS value FROM (SELECT package_id, 'pad_w' AS field, "
        "CASE WHEN package_id % 13 = 0 THEN 'NaN'::DOUBLE ELSE pad_w END AS raw, 0.05::DOUBLE AS lo, 0.6::DOUBLE AS hi FROM packages UNION ALL SELECT package_id, 'pad_l', pad_l, 0.1::DOUBLE, 1.2::DOUBLE FROM "
        "packages)",
)(lambda t: o.optional_fields(_pk(t).withColumn("pad_w", F.expr("CASE WHEN package_id % 13 = 0 THEN double('NaN') ELSE pad_w END")), {"pad_w": (0.05, 0.6), "pad_l": (0.1, 1.2)}))
query("land_pattern", "SELECT package_id, kept, CASE WHEN kept THEN 'datasheet' ELSE 'derived_by_rules' END AS source, void FROM (SELECT package_id, v AS void, NOT "
    "v AND pad_w IS NOT NULL AND pad_l IS NOT NULL AND lp_row_span IS NOT NULL AS kept FROM (SELECT *, coalesce(pad_w < 0.1 OR pad_w > 5, FALSE) "
    "OR coalesce(pad_l < 0.1 OR pad_l > 6, FALSE) OR coalesce(lp_row_span < 1 OR lp_row_span > 90, FALSE) AS v FROM packages))")(lambda t: o.land_pattern(t.packages))
query(
    "critical_missing",
    f"SELECT package_id, string_agg(field, ',' ORDER BY field) AS fields FROM ({_PROV}) WHERE (source IN ('missing', 'clamped', 'invalid') OR "
        f"(source = 'reviewer' AND reviewer IS NULL)) AND {REL} GROUP BY 1",
    V | {"rev": _REV},
)(lambda t: o.critical_missing(o.field_provenance(_odd(t), reviewed(t))))
# Packages of a part, and some whose pins repeat those of the part's first package
_PART = "'P' || CAST(CAST(floor(package_id / 4) AS BIGINT) AS VARCHAR(20))"
_LIKE = "CASE WHEN package_id % 4 = 1 THEN package_id - 1 ELSE package_id END"
query(
    "symbol_groups",
    f"""SELECT package_id, part, fingerprint, sharers, CASE WHEN k = 1 THEN part ELSE part || '_' || CASE WHEN tag = '' THEN 'ALT' ELSE tag END END AS symbol FROM own JOIN (
      SELECT part, fingerprint, count(*) AS sharers, row_number() OVER (PARTITION BY part ORDER BY min(package_id)) AS k, upper(regexp_replace(arg_min(type, package_id), '\\W+', '', 'g')) AS tag
      FROM own GROUP BY 1, 2) USING (part, fingerprint)""",
    V
    | {
        "own": f"SELECT p.package_id, {_PART.replace('package_id', 'p.package_id')} AS part, p.type, f.fingerprint FROM packages p JOIN ("
        "SELECT package_id, sha256(string_agg(p, chr(10) ORDER BY p)) AS fingerprint FROM (SELECT package_id, number || '|' || name || '|' || type AS "
            "p FROM clean) GROUP BY 1"
        f") f ON f.package_id = {_LIKE.replace('package_id', 'p.package_id')}"
    },
)(lambda t: o.symbol_groups(_shared_pins(t), t.packages.selectExpr("package_id", f"{_PART} AS part", "type", "package_id AS place")))


def _shared_pins(t):
    """Cleaned pins, every fourth package having those of the one before."""
    pins = o.sanitize_pins(t.raw_pins).drop("package_id_2")
    ids = t.packages.selectExpr("package_id AS own", f"{_LIKE} AS like_id")
    return pins.join(ids, pins["package_id"] == ids["like_id"]).select(F.col("own").alias("package_id"), "number", "name", "type")


query("active_low_name", "SELECT package_id, pos, part, CASE WHEN regexp_matches(name, '^[/~].+$|^.+#$') THEN '~{{' || regexp_replace(name, '^[/~]|#$', '', 'g') || "
    "'}}' ELSE name END AS name FROM clean".replace("{{", "{").replace("}}", "}"), V)(lambda t: o.sanitize_pins(t.raw_pins).select("package_id", "pos", "part", o.active_low_name(F.col("name")).alias("name")))
# Links of pages, and addresses in every notation derived from their ids
_AT = " || '.' || ".join(f"CAST(page_id * {m} % 256 AS VARCHAR(20))" for m in (37, 11, 101, 7))
_URL = (
    f"CASE page_id % 12 WHEN 0 THEN replace(url, 'http', 'ftp') WHEN 1 THEN 'http://user@' || {_AT} || '/x' WHEN 2 THEN 'no link'"
    " WHEN 3 THEN 'https://' || CAST(page_id * 265443573 % 4300000000 AS VARCHAR(20)) || '/'"
    f" WHEN 4 THEN 'http://[::ffff:' || {_AT} || ']:8080/' WHEN 5 THEN 'http://0x7f.0' || CAST(page_id % 8 AS VARCHAR(20)) || '.1' WHEN 6 THEN 'http://[f' || CAST(page_id * 7 % 10 AS VARCHAR(20)) || 'd0::' || CAST(page_id AS VARCHAR(20)) || ']'"
    " WHEN 7 THEN 'http://example.com:' || CASE page_id % 4 WHEN 3 THEN '22' ELSE '8443' END || '/' WHEN 8 THEN 'http://' || CAST(page_id * 37 % 300 AS VARCHAR(20)) || '.16.1/'"
    " WHEN 9 THEN 'http://[fc' || CAST(page_id % 90 AS VARCHAR(20)) || '::1:2]:443' ELSE url END"
)
_BASE = "list_reduce(list_concat([0::BIGINT], list_transform(string_split({0}, ''), lambda c: strpos('0123456789abcdef', c) - 1)), lambda a, x: a * {1} + x)"
_DEC, _HEX = "^(0|[1-9][0-9]{0,9})$", "^0x[0-9a-f]{1,8}$"
_V4 = " OR ".join("{0} BETWEEN " + f"{o.v4_number(lo)} AND {o.v4_number(hi)}" for lo, hi in o.PRIVATE_V4)
_GROUPS = " OR ".join(f"v6[1] BETWEEN {lo} AND {hi}" for lo, hi in o.PRIVATE_GROUPS)
URLS = {
    "u0": f"SELECT page_id, url, lower(regexp_extract(url, '{o.LINK}', 1)) AS scheme, regexp_replace(regexp_extract(url, '{o.LINK}', 2), '^.*@', '') AS place FROM (SELECT page_id, {_URL} AS url FROM pages)",
    "u1": "SELECT *, lower(regexp_extract(place, '^(\\[[^\\]]*\\]|[^:\\[\\]]*)(:[0-9]*)?$', 1)) AS host, regexp_replace(regexp_extract(place, ':([0-9]*)$', 1), '^0+(.)', '\\1') AS port FROM u0",
    "u2": "SELECT *, string_split(regexp_replace(host, '\\.$', ''), '.') AS parts, CASE WHEN host[1] = '[' THEN host[2:-2] END AS six FROM u1",
    "u3": f"SELECT *, list_transform(parts, lambda p: CASE WHEN regexp_matches(p, '{_HEX}') THEN {_BASE.format('p[3:]', 16)} WHEN regexp_matches(p, '^0[0-7]+$') THEN {_BASE.format('p', 8)}"
    f" WHEN regexp_matches(p, '{_DEC}') THEN p::BIGINT END) AS nums, CASE WHEN contains(six, '.') THEN regexp_extract(six, '^(.*:)[^:]*$', 1) ELSE six END AS front,"
    " list_transform(string_split(regexp_extract(six, '([0-9.]*)$', 1), '.'), lambda x: TRY_CAST(x AS BIGINT)) AS tail FROM u2",
    "u4": "SELECT *, len(nums) AS n, nums[-1] AS lastn, list_reduce(list_concat([0::BIGINT], nums[:-2]), lambda a, x: a * 256 + x) AS high, CASE len(nums) WHEN 1 THEN 4294967296 WHEN 2 THEN 16777216 WHEN 3 THEN 65536 ELSE 256 END AS room,"
    " string_split(CASE WHEN contains(six, '.') THEN front || printf('%x:%x', tail[1] * 256 + tail[2], tail[3] * 256 + tail[4]) ELSE six END, '::') AS halves FROM u3",
    "u5": "SELECT *, CASE WHEN regexp_matches(parts[-1], '^([0-9]+|0x[0-9a-f]*)$') THEN CASE WHEN n <= 4 AND len(list_filter(nums, lambda x: x IS NULL)) = 0 AND len(list_filter(nums[:-2], lambda x: x > 255)) = 0 AND lastn < room THEN high * room + lastn ELSE -1 END END AS v4,"
    f" list_transform(CASE len(halves) WHEN 1 THEN string_split(halves[1], ':') WHEN 2 THEN list_concat(list_filter(string_split(halves[1], ':'), lambda g: g <> ''), list_transform(range(8 - len(list_filter(string_split(halves[1] || ':' || halves[2], ':'), lambda g: g <> ''))), lambda i: '0'),"
    f" list_filter(string_split(halves[2], ':'), lambda g: g <> '')) END, lambda g: CASE WHEN regexp_matches(g, '^[0-9a-f]{{1,4}}$') THEN {_BASE.format('g', 16)} END) AS v6 FROM u4",
}
query(
    "url_check",
    "SELECT page_id, url, CASE WHEN scheme = '' OR coalesce(host, '') = '' OR v4 = -1 OR (six IS NOT NULL AND coalesce(len(list_filter(v6, lambda g: g IS NOT NULL)), 0) <> 8) OR len(v6) <> 8 THEN 'invalid' WHEN scheme NOT IN ('http', 'https') THEN 'scheme'"
    f" WHEN port NOT IN ({', '.join(repr(x) for x in o.PORTS)}) THEN 'port' WHEN {_V4.format('v4')} OR {_GROUPS} OR (list_sum(v6[1:7]) = 0 AND v6[8] <= 1)"
    f" OR (list_sum(v6[1:5]) = 0 AND v6[6] = 65535 AND ({_V4.format('(v6[7] * 65536 + v6[8])')})) OR regexp_matches(host, '^(.*[.])?localhost[.]?$') THEN 'private_host' ELSE 'ok' END AS result FROM u5",
    URLS,
)(lambda t: o.url_check(t.pages.withColumn("url", F.expr(_URL))))
