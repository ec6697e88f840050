"""Queries of package geometry, page rasters, records, folds and streams."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetgraph.functions.store import shared_folder
from sheetgraph.operators import cleaning, folds, geometry, layout, raster, review
from sheetgraph.operators.netlist import focus_batches
from sheetgraph.plans.cleaning import V as CV
from sheetgraph.plans.cleaning import _pk
from sheetgraph.plans.layout import _items
from sheetgraph.plans.folds import ANONYMOUS, ANONYMOUS_SQL, ASSEMBLED, FIGURE_FILTER, FIGURE_FIT, FILTERED, FITTED, INK_GROW, LEDGER, LEDGER_SQL, LIFECYCLE, LIFECYCLE_STREAM, LINE_BOXES, PROFILE
from sheetgraph.plans.layout import V as LV
from sheetgraph.plans.registry import query
from sheetgraph.plans.review import JOB_VIEWS, _job_files, _job_keys
from sheetgraph.sources import records
from sheetgraph.streaming import jobs

FIELDS = list(cleaning.FIELDS)


def folder(t) -> str:
    """Where a query writes what it reads again: the session's shared folder."""
    return shared_folder(t.spark)


def _norm(t, *more: str) -> DataFrame:
    """Packages with cleaned fields side by side, and more columns of the packages."""
    p = cleaning.field_provenance(_pk(t)).groupBy("package_id", "family").pivot("field", FIELDS).agg(F.first("value"))
    return p.join(t.packages.selectExpr("package_id", "type", "pin_count", *more), "package_id")


def _prior(field: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(type, '{p}') THEN {v.get(field, 'NULL')}" for p, v in geometry.PRIORS) + " END"


# Sizes of the rasters, paragraphs as their lines, a figure a page with a box or without, and captions of all kinds
_HIGH = "CAST(ceil(length(html) / CAST(32 AS DOUBLE)) AS BIGINT)"
_SIZES_COLUMNS = ["page_id", "CAST(32 AS BIGINT) AS w", f"{_HIGH} AS h", f"CASE WHEN page_id % 4 = 0 THEN 8 ELSE 0 END AS chrome_top", f"{_HIGH} - CASE WHEN page_id % 4 < 2 THEN 6 ELSE 0 END AS chrome_bottom"]
_PARAGRAPH = "CAST(floor(page_id % 7 * {0} / 8) AS BIGINT)".format(_HIGH)
_LINES_COLUMNS = ["page_id", f"substr(html, 1, CAST(20 + page_id % 3 * 30 AS INT)) AS text", f"{_PARAGRAPH} AS top", f"{_PARAGRAPH} + page_id % 5 AS bottom"]
_FIGS_COLUMNS = ["page_id", "CAST(1 AS BIGINT) AS fig_no", "CASE WHEN page_id % 5 <> 0 THEN page_id % 9 / CAST(10 AS DOUBLE) END AS y0", "CASE WHEN page_id % 5 <> 0 THEN page_id % 9 / CAST(10 AS DOUBLE) + CAST(0.3 AS DOUBLE) END AS y1"]
_AT = "CAST(floor(page_id % 11 * {0} / 12) AS BIGINT)".format(_HIGH)
_CAPS_COLUMNS = ["page_id", "CAST(1 AS BIGINT) AS fig_no", "CASE page_id % 4 WHEN 0 THEN 'Figure 3. Overview' WHEN 1 THEN '7.2 Overview' ELSE 'Overview' END AS text", f"CASE WHEN page_id % 3 <> 1 THEN {_AT} END AS top", f"{_AT} + 3 AS bottom"]
_SIZES = "SELECT " + ", ".join(_SIZES_COLUMNS) + " FROM pages WHERE length(html) > 0"
_LINES = "SELECT " + ", ".join(_LINES_COLUMNS) + " FROM pages WHERE length(html) > 0"
_FIGS = "SELECT " + ", ".join(_FIGS_COLUMNS) + " FROM pages"
_CAPS = "SELECT * FROM (SELECT " + ", ".join(_CAPS_COLUMNS) + " FROM pages) WHERE top IS NOT NULL"
_ISQ = "family = 'qfn' AND pin_count % 4 = 0"
# Holes and thermal pads of packages, some without
_MORE_COLUMNS = [
    "pad_w", "pad_l", "lp_row_span", "CASE WHEN package_id % 2 = 0 THEN CAST(0.8 AS DOUBLE) END AS hole_dia",
    "CASE WHEN package_id % 5 > 0 THEN CAST(package_id * 7 % 600 AS DOUBLE) / 100 END AS ep_length", "CASE WHEN package_id % 7 > 0 THEN CAST(package_id * 11 % 600 AS DOUBLE) / 100 END AS ep_width",
]
_LAND_OK = " AND ".join(f"coalesce({c} BETWEEN {lo} AND {hi}, FALSE)" for c, (lo, hi) in cleaning.LAND.items())
_ODD_SIZE = "coalesce(family IN ('dual', 'sot23') AND ({0} IS NULL OR {0} < n_{0} * " + f"{geometry.LOW}::DOUBLE OR " + "{0} > n_{0} * " + f"{geometry.HIGH}::DOUBLE), FALSE)"
_SIDED = "family IN ('dual', 'dip')"
V = CV | {
    "wide": "SELECT p.package_id, p.family, k.type, k.pin_count, " + ", ".join(f"max(value) FILTER (field = '{f}') AS {f}" for f in FIELDS) + " FROM prov p JOIN packages k ON k.package_id = p.package_id GROUP BY 1, 2, 3, 4",
    "priors": " UNION ALL ".join(f"SELECT package_id, '{f}' AS field, {f} AS before, CAST({_prior(f)} AS DOUBLE) AS after FROM fam WHERE family IN ('dual', 'sot23')" for f in ("pitch", "body_length", "body_width", "lead_span", "height")),
    "more": "SELECT package_id AS more_id, " + ", ".join(_MORE_COLUMNS) + " FROM packages",
    "ga": "SELECT * EXCLUDE (more_id), " + ", ".join(f"CAST({_prior(f)} AS DOUBLE) AS n_{f}" for f in geometry.PRIOR_FIELDS) + f", {_LAND_OK} AS own FROM wide JOIN more ON more_id = package_id",
    "gb": "SELECT *, " + ", ".join(f"{_ODD_SIZE.format(f)} AS p_{f}" for f in geometry.PRIOR_FIELDS) + " FROM ga",
    "gc": "SELECT * REPLACE (" + ", ".join(f"CASE WHEN p_{f} THEN n_{f} ELSE {f} END AS {f}" for f in geometry.PRIOR_FIELDS) + ") FROM gb",
    "g0": "SELECT *, own AND (pad_w >= pitch - 0.05::DOUBLE OR (family = 'dual' AND lp_row_span + pad_l * 2 < body_width) OR (family = 'dip' AND (lp_row_span < body_width * 0.7::DOUBLE OR "
        "(coalesce(hole_dia, 0) = 0 AND pad_w < 1.0)))) AS di, (ceil(pin_count / 2) - 1) * pitch AS rw FROM gc",
    "g1": f"SELECT *, {_SIDED} AND body_length < rw + greatest(0.4, pitch * 0.3::DOUBLE) AND body_width >= rw + greatest(0.4, pitch * 0.3::DOUBLE) AND "
        "body_width > body_length AS sw FROM g0",
    "g2": "SELECT *, CASE WHEN sw THEN body_width ELSE body_length END AS bl, CASE WHEN sw THEN body_length ELSE body_width END AS bw FROM g1",
    "g3": f"SELECT *, {_SIDED} AND (bl < rw + greatest(0.4, pitch * 0.3::DOUBLE) OR bl > rw + greatest(4.0, pitch * 3)) AS st FROM g2",
    "g4": "SELECT *, CASE WHEN st THEN round(rw + pitch * 1.2::DOUBLE, 2) ELSE bl END AS bl2, family = 'dual' AND NOT lead_span > bw + 0.6::DOUBLE AS sh FROM g3",
    "g5": "SELECT *, CASE WHEN sh THEN round(bw + 2.0, 2) ELSE lead_span END AS ls1 FROM g4",
    "g6": "SELECT *, family = 'dual' AND ls1 > bw + 8 AS lg, family = 'dip' AND row_span < bw * 0.85::DOUBLE AS na, (pin_count / 4 - 1) * pitch + "
        "greatest(0.8, pitch) AS sd FROM g5",
    "g7": f"SELECT *, {_ISQ} AND bl2 < sd AS ql, {_ISQ} AND bw < sd AS qw, CASE WHEN {_ISQ} AND bl2 < sd THEN round(sd, 2) ELSE bl2 END AS bl3, CASE WHEN {_ISQ} AND bw < sd THEN round(sd, 2) ELSE bw END AS bw3 FROM g6",
    "g8": f"SELECT *, coalesce({_ISQ} AND ep_length <> 0 AND ep_length > bl3 - 1.2::DOUBLE, FALSE) AS ep, round(bl3 - 1.4::DOUBLE, 2) AS el, round(bw3 - 1.4::DOUBLE, 2) AS ew FROM g7",
    # A page's whole source as a raster: 32 characters a row, dark where a tag begins or ends; rows without one are its text
    "pxrows": "SELECT page_id, y, substr(html, y * 32 + 1, 32) AS row FROM (SELECT page_id, html, unnest(range(CAST(ceil(length(html) / 32) AS BIGINT))) AS y FROM pages)",
    "px": "SELECT page_id, x, y, CASE WHEN substr(row, x + 1, 1) IN ('<', '>') THEN 0 ELSE 255 END AS luma FROM pxrows CROSS JOIN (SELECT unnest(range(32)) AS x)",
    "pxsize": _SIZES,
    "pxlines": _LINES,
    "pxfigs": _FIGS,
    "pxcaps": _CAPS,
    "ink": "SELECT DISTINCT page_id, CAST(floor(y / 4) AS BIGINT) AS r, CAST(floor(x / 4) AS BIGINT) AS c FROM px WHERE luma < 236",
    "inkrows": "SELECT page_id, r, count(*) AS cells FROM ink GROUP BY 1, 2",
}


def _px(t) -> DataFrame:
    high = F.ceil(F.length("html") / 32).cast("int")
    rows = t.pages.where("html <> ''").select("page_id", "html", F.explode(F.sequence(F.lit(0), high - 1)).alias("y")).selectExpr("page_id", "y", "substr(html, y * 32 + 1, 32) AS row")
    pixels = rows.select("page_id", "y", "row", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("x"))
    return pixels.selectExpr("page_id", "x", "y", "CASE WHEN substr(row, x + 1, 1) IN ('<', '>') THEN 0 ELSE 255 END AS luma")


def _profile(t) -> DataFrame:
    return raster.ink_profile(raster.ink_grid(_px(t)), t.pages.selectExpr(*_SIZES_COLUMNS).where("h > 0"), t.pages.selectExpr(*_LINES_COLUMNS).where("text <> ''"))


query("geometry_priors", f"SELECT * FROM priors WHERE after IS NOT NULL AND (before IS NULL OR before < after * {geometry.LOW}::DOUBLE OR before > after * "
    f"{geometry.HIGH}::DOUBLE)", V)(lambda t: geometry.geometry_priors(_pk(t)))
_OPS = [
    *((f"p_{f}", f"prior_{f}") for f in geometry.PRIOR_FIELDS), ("di", "land_pattern_discarded"), ("sw", "body_dimensions_swapped"), ("st", "body_length_derived"), ("sh", "lead_span_too_small"),
    ("lg", "lead_span_implausible"), ("na", "row_span_derived"), ("ql", "qfn_body_length"), ("qw", "qfn_body_width"), ("ep", "ep_shrunk"),
]
query(
    "geometry_rules",
    f"""SELECT package_id, pitch, bl3 AS body_length, bw3 AS body_width, height, CASE WHEN lg THEN round(bw + 2.4::DOUBLE, 2) ELSE ls1 END AS lead_span,
      CASE WHEN na THEN CASE WHEN bw <= 7 THEN 7.62 WHEN bw <= 13 THEN 15.24 ELSE round(bw + 2.5, 2) END ELSE row_span END AS row_span,
      {", ".join(f"CASE WHEN own AND NOT di THEN {c} END AS {c}" for c in cleaning.LAND)}, CASE WHEN own AND NOT di THEN 'datasheet' ELSE 'derived_by_rules' END AS land_source,
      CASE WHEN ep THEN el ELSE ep_length END AS ep_length, CASE WHEN ep THEN least(coalesce(nullif(ep_width, 0), el), ew) ELSE ep_width END AS ep_width,
      concat_ws(',', {", ".join(f"CASE WHEN {c} THEN '{name}' END" for c, name in _OPS)}) AS ops FROM g8""",
    V,
)(lambda t: geometry.geometry_rules(_norm(t, *_MORE_COLUMNS)))
query("lga_promote", "SELECT package_id, 'lga' AS family, concat_ws(',', CASE WHEN pitch IS NULL THEN 'pitch' END, CASE WHEN body_length IS NULL THEN "
    "'body_length' END, CASE WHEN height IS NULL THEN 'height' END) AS missing FROM packages WHERE type = 'LGA'")(lambda t: geometry.lga_promote(t.packages, ["pitch", "body_length", "height"]))
_NEED = "SELECT package_id, bool_or(field = 'pitch') AS p, bool_or(field IN ('body_length', 'body_width')) AS b FROM prov WHERE source IN ('missing', 'clamped') GROUP BY 1"
query(
    "generation_block",
    f"""SELECT f.package_id, x.finding FROM fam f LEFT JOIN ({_NEED}) m ON m.package_id = f.package_id JOIN (SELECT package_id, count(*) AS n FROM clean GROUP BY 1) c ON c.package_id = f.package_id CROSS JOIN (VALUES ('blocked_missing_geometry'), ('blocked_quad_pin_count'), ('unsupported_package'), ('warn_pin_count_mismatch')) AS x(finding)
      WHERE CASE x.finding WHEN 'blocked_missing_geometry' THEN coalesce(m.p AND m.b, FALSE) WHEN 'blocked_quad_pin_count' THEN f.family = 'qfn' AND f.pin_count % 4 <> 0 WHEN 'unsupported_package' THEN f.family NOT IN ('dual', 'qfn', 'dip', 'sot23', 'lga') ELSE c.n - f.pin_count NOT IN (0, 1) END""",
    V,
)(lambda t: geometry.generation_block(_pk(t), cleaning.critical_missing(cleaning.field_provenance(_pk(t))), cleaning.sanitize_pins(t.raw_pins).groupBy("package_id").agg(F.count("*").alias("n_pins"))))
_PAD = {
    "pad0": "SELECT w.*, i, ceil(pin_count / 2) AS half FROM wide w CROSS JOIN (SELECT unnest(range(24)) AS i) WHERE (family IN ('dual', 'dip') AND i < "
        "pin_count) OR (family = 'sot23' AND i < 3) OR (family = 'qfn' AND pin_count % 4 = 0 AND i < pin_count)",
    "pad1": "SELECT *, CASE WHEN pin_count = 5 AND i = 3 THEN 2 WHEN pin_count = 5 AND i = 4 THEN 0 WHEN i < half THEN i ELSE pin_count - 1 - i END AS "
        "pl, lead_span / 2 + 0.4::DOUBLE AS o, greatest(body_width / 2 - 0.25, lead_span / 2 + 0.4::DOUBLE - 1.8::DOUBLE) AS n, CASE WHEN i < half "
        "THEN -1 ELSE 1 END AS sg, CAST(floor(i / (pin_count / 4)) AS INT) AS sd, (i % CAST(pin_count / 4 AS BIGINT) - (pin_count / 4 - 1) / 2) * "
        "pitch AS q, body_width / 2 + 0.3::DOUBLE AS ox, body_width / 2 - lead_length - 0.05::DOUBLE AS ix, body_length / 2 + 0.3::DOUBLE AS oy, "
        "body_length / 2 - lead_length - 0.05::DOUBLE AS iy, least(pitch - 0.15::DOUBLE, least(0.35, pitch * 0.5) + 0.05::DOUBLE) AS qw FROM pad0",
    "pads": """SELECT package_id, (i + 1)::VARCHAR AS number,
      round(CASE family WHEN 'dual' THEN sg * (o + n) / 2 WHEN 'qfn' THEN CASE sd WHEN 0 THEN -(ox + ix) / 2 WHEN 1 THEN q WHEN 2 THEN (ox + ix) / 2 ELSE -q END WHEN 'dip' THEN sg * (row_span / 2) + row_span / 2 ELSE CASE WHEN i < 2 THEN -(lead_span / 2 + 0.35::DOUBLE) ELSE lead_span / 2 + 0.35::DOUBLE END END, 3) + 0.0 AS x,
      round(CASE family WHEN 'dual' THEN (pl - (half - 1) / 2) * pitch WHEN 'qfn' THEN CASE sd WHEN 0 THEN q WHEN 1 THEN (oy + iy) / 2 WHEN 2 THEN -q ELSE -(oy + iy) / 2 END WHEN 'dip' THEN (pl - (half - 1) / 2) * pitch + (half - 1) / 2 * pitch ELSE CASE i WHEN 0 THEN -0.95 WHEN 1 THEN 0.95 ELSE 0 END END, 3) + 0.0 AS y,
      round(CASE family WHEN 'dual' THEN o - n WHEN 'qfn' THEN CASE WHEN sd IN (0, 2) THEN ox - ix ELSE qw END WHEN 'dip' THEN 1.6::DOUBLE ELSE 1.1::DOUBLE END, 3) AS w,
      round(CASE family WHEN 'dual' THEN least(pitch - 0.2::DOUBLE, least(0.6, pitch * 0.5) + 0.15::DOUBLE) WHEN 'qfn' THEN CASE WHEN sd IN (0, 2) THEN qw ELSE oy - iy END WHEN 'dip' THEN 1.6::DOUBLE ELSE 0.7::DOUBLE END, 3) AS h,
      CASE WHEN i = 0 THEN 'rect' WHEN family = 'dip' THEN 'circle' ELSE 'roundrect' END AS shape FROM pad1""",
}
query("pad_table", "SELECT * FROM pads", V | _PAD)(lambda t: geometry.pad_table(_norm(t)))
query("courtyard", "SELECT w.package_id, floor((greatest(ex, body_width / 2) + g) * 100 + 0.5) / 100 AS half_x, floor((greatest(ey, body_length / 2) + g) * 100 "
    "+ 0.5) / 100 AS half_y, least(1.0, least(body_width, body_length) * 0.25) AS chamfer FROM (SELECT *, CASE WHEN least(body_width, "
    "body_length) < 1.5 THEN 0.15::DOUBLE ELSE 0.25::DOUBLE END AS g FROM wide) w JOIN (SELECT package_id, max(abs(x) + w / 2) AS ex, max(abs(y) "
    "+ h / 2) AS ey FROM pads GROUP BY 1) e ON e.package_id = w.package_id", V | _PAD)(
    lambda t: geometry.courtyard(geometry.pad_table(_norm(t)), _norm(t))
)
_D = "regexp_replace(printf('%.2f', {0}), '\\.?0+$', '')"
query("footprint_name", f"SELECT package_id, CASE WHEN family = 'dip' THEN 'P' || package_id::VARCHAR || '_' || type || '_W' || {_D.format('row_span')} || 'mm_P' || "
    f"{_D.format('pitch')} || 'mm' ELSE 'P' || package_id::VARCHAR || '_' || type || '_' || {_D.format('body_width')} || 'x' || "
    f"{_D.format('body_length')} || 'mm_P' || {_D.format('pitch')} || 'mm' END AS name FROM wide", V)(
    lambda t: geometry.footprint_name(_norm(t), F.concat(F.lit("P"), F.col("package_id").cast("string")))
)
_SIDE = f"CASE WHEN upper(name) IN ('EP', 'EPAD') THEN 'bottom' WHEN type IN ('power_in', 'power_out') THEN CASE WHEN regexp_matches(upper(name), '{geometry.GROUNDY}') THEN 'bottom' WHEN regexp_matches(upper(name), '{geometry.SUPPLY}') THEN 'top' WHEN type = 'power_in' THEN 'left' ELSE 'right' END WHEN type IN ('input', 'tri_state', 'open_collector') THEN 'left' ELSE 'right' END"
query(
    "symbol_layout",
    "SELECT package_id, number, side, row_number() OVER (PARTITION BY package_id, side ORDER BY CASE WHEN type = 'no_connect' THEN 1 ELSE 0 END, "
        "no IS NULL, no, number) - 1 AS slot FROM (SELECT package_id, number, type, no, CASE WHEN s = 'top' AND row_number() OVER (PARTITION BY "
        f"package_id, s ORDER BY no IS NULL, no, number) > 3 THEN 'left' ELSE s END AS side FROM (SELECT *, try_cast(number AS INT) AS no, {_SIDE} AS "
        "s FROM clean))",
    V,
)(lambda t: geometry.symbol_layout(cleaning.sanitize_pins(t.raw_pins)))

# Rasters
query("ink_grid", "SELECT * FROM ink", V)(lambda t: raster.ink_grid(_px(t)))
query("ink_blocks", "SELECT page_id, r0, r1, cells, row_number() OVER (PARTITION BY page_id ORDER BY cells DESC, r0) AS rank FROM (SELECT page_id, b, min(r) AS "
    "r0, max(r) AS r1, CAST(sum(cells) AS BIGINT) AS cells FROM (SELECT *, sum(nw) OVER (PARTITION BY page_id ORDER BY r) AS b FROM (SELECT *, "
    "CASE WHEN r - lag(r) OVER (PARTITION BY page_id ORDER BY r) - 1 <= 2 THEN 0 ELSE 1 END AS nw FROM inkrows)) GROUP BY 1, 2)", V)(lambda t: raster.ink_blocks(raster.ink_grid(_px(t))))
_RANGES = "SELECT page_id, CAST(k AS BIGINT) AS range_id, CAST(k * 4 AS BIGINT) AS r0, CAST(k * 4 + page_id % 5 AS BIGINT) AS r1 FROM pages CROSS JOIN (VALUES (0), (1), (2), (3)) AS v(k)"
query("ink_bounds", f"SELECT g.page_id, g.range_id, count(*) AS cells, min(i.c) AS c0, max(i.c) AS c1 FROM ({_RANGES}) g JOIN ink i ON i.page_id = g.page_id AND "
    "i.r BETWEEN g.r0 AND g.r1 GROUP BY 1, 2", V)(
    lambda t: raster.ink_bounds(raster.ink_grid(_px(t)), t.pages.select("page_id", F.explode(F.expr("array(0L, 1L, 2L, 3L)")).alias("range_id")).selectExpr("page_id", "range_id", "range_id * 4 AS r0", "range_id * 4 + page_id % 5 AS r1"))
)
query("ink_grow", INK_GROW, V | PROFILE)(lambda t: raster.ink_grow(_profile(t), t.pages.select("page_id", F.expr("page_id % 20").alias("anchor"), F.explode(F.array(F.lit(1), F.lit(-1))).alias("dir"))))
query("figure_fit", FIGURE_FIT, V | PROFILE | FITTED)(lambda t: raster.figure_fit(_profile(t), t.pages.selectExpr(*_FIGS_COLUMNS), t.pages.selectExpr(*_CAPS_COLUMNS).where("top IS NOT NULL")))

# Folds
query("line_boxes", LINE_BOXES, LV | ASSEMBLED)(lambda t: folds.line_boxes(_items(t).selectExpr("doc_id", "page", "item_no", "str", "x AS left", "x + w AS right", "792 - y AS base", "greatest(abs(h), 8D) AS h")))
query("figure_filter", FIGURE_FILTER, LV | FILTERED)(lambda t: folds.figure_filter(layout.figure_candidates(t.lines).selectExpr("doc_id", "line_no AS fig_no", "kind", "title", "page", "1 - y / 792 AS y0")))
query("batch_anonymous_nets", ANONYMOUS_SQL, ANONYMOUS)(lambda t: folds.batch_anonymous_nets(t.batch_eps))


def _told(refs, hints):
    """An extractor that says what it was told: a sure value, or how much the source shows."""
    values = dict(p.split("=", 1) for p in hints["pairs"])
    return [(r, values.get(r, f"{len(refs)} of {len(hints['refs'])} references, {len(hints['labels'])} labels from {hints['labels'][0]}")) for r in refs]


query(
    "enrich_batches",
    "SELECT c.design_id, c.batch_no, c.ref, coalesce(p.value, c.n::VARCHAR || ' of ' || least(220, c.total)::VARCHAR || ' references, ' || l.n::VARCHAR || ' labels from ' || l.first) AS value FROM ("
    "SELECT design_id, ref, batch_no, count(*) OVER (PARTITION BY design_id, batch_no) AS n, count(*) OVER (PARTITION BY design_id) AS total FROM (SELECT design_id, ref, CAST(floor((row_number() OVER (PARTITION BY design_id ORDER BY ref) - 1) / 18) AS BIGINT) AS batch_no FROM comps)) c"
    " LEFT JOIN (SELECT * FROM (SELECT design_id, ref, value, row_number() OVER (PARTITION BY design_id ORDER BY ref || '=' || value) AS k FROM comps WHERE conf_pct >= 65) WHERE k <= 80) p ON p.design_id = c.design_id AND p.ref = c.ref"
    " LEFT JOIN (SELECT design_id, least(100, count(DISTINCT name)) AS n, min(name) AS first FROM nets GROUP BY 1) l ON l.design_id = c.design_id",
)(lambda t: folds.enrich_batches(focus_batches(t.comps), _told, hints=folds.census_hints(t.comps, t.nets.selectExpr("design_id", "name AS label"), t.comps.selectExpr("design_id", "ref", "value", "CAST(conf_pct AS DOUBLE) / 100 AS confidence"))))
query("figure_image_bind", "SELECT e.event_id AS upload_id, e.k AS fig_id, CASE WHEN e.k >= 60 THEN 'unknown_figure' WHEN e.event_id % 3 <> e.k % 3 THEN "
    "'revision_conflict' ELSE 'bound' END AS result, CASE WHEN e.k < 60 AND e.event_id % 3 = e.k % 3 THEN 'figure:' || e.k::VARCHAR END AS lapsed "
    "FROM ev e")(
    lambda t: folds.figure_image_bind(t.packages.selectExpr("package_id % 60 AS fig_id", "package_id % 60 % 3 AS revision").distinct(), t.ev.selectExpr("event_id AS upload_id", "k AS fig_id", "event_id % 3 AS expected_revision", "'s' AS sha"))
)

# Records
_NAME = "CASE doc_id % 6 WHEN 0 THEN '../' || source || '//a:b.txt' WHEN 1 THEN 'con.' || source WHEN 2 THEN '' WHEN 3 THEN '..' || source || '/./x' WHEN 4 THEN '-' || source || ' ü' ELSE NULL END"
_SAFE = "coalesce(nullif(substr({f}, 1, 120), ''), '{d}')"
_CLEAN = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '[\\\\/]', '_', 'g'), '\\.{{2,}}', '_', 'g'), '[^A-Za-z0-9._,+\\-]', '_', 'g'), '^[.\\-]+', '_')"
_RES = "CASE WHEN regexp_matches(regexp_extract({0}, '^[^.]*', 0), '(?i)^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$') THEN '_' || {0} ELSE {0} END"
_FILE = lambda x: _RES.format(_CLEAN.format(x))
query(
    "safe_names",
    f"SELECT doc_id AS id, {_SAFE.format(f=_FILE('n'), d='unnamed')} AS file_name, "
        "coalesce(nullif(array_to_string(list_transform(list_filter(string_split(n, '/'), lambda p: p NOT IN ('', '.', '..')), lambda p: "
        f"{_SAFE.format(f=_FILE('p'), d='file')}), '/'), ''), 'file') AS path FROM (SELECT doc_id, coalesce({_NAME}, '') AS n FROM documents)",
)(lambda t: records.safe_names(t.documents.selectExpr("doc_id AS id", f"{_NAME} AS name")))
query("text_safety", r"SELECT doc_id AS id, substr(v, 1, 200) AS value, substr(v, 1, 200) <> t AS changed, length(v) > 200 AS truncated, regexp_matches(t, "
    r"'[\x00-\x1F\x7F\x{200B}-\x{200F}\x{2028}\x{2029}\x{FEFF}]') AS had_control, CASE WHEN regexp_matches(t, "
    r"'[\x00-\x1F\x7F\x{200B}-\x{200F}\x{2028}\x{2029}\x{FEFF}]') THEN 'control' WHEN length(t) > 64 THEN 'too_long' WHEN trim(t) = '' THEN "
    r"'empty' END AS strict_error FROM (SELECT doc_id, t, trim(regexp_replace(regexp_replace(t, "
    r"'[\x00-\x1F\x7F\x{200B}-\x{200F}\x{2028}\x{2029}\x{FEFF}]', ' ', 'g'), '\s+', ' ', 'g'), ' ') AS v FROM (SELECT doc_id, "
    r"coalesce(substr(text, 1, 20 + doc_id % 100), '') AS t FROM documents UNION ALL SELECT -doc_id - 1, CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE "
    r"text END FROM documents))")(
    lambda t: records.text_safety(t.documents.selectExpr("doc_id AS id", "substr(text, 1, CAST(20 + doc_id % 100 AS INT)) AS text").union(t.documents.selectExpr("-doc_id - 1", "CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE text END")))
)
query("object_key", "SELECT job_id AS file_id, tenant::VARCHAR || '/' || job_id::VARCHAR || '/figure/' || substr(sha256(job_id::VARCHAR), 1, 2) || '/' || "
    "sha256(job_id::VARCHAR) || '.png' AS key FROM jobs")(lambda t: records.object_key(t.jobs.selectExpr("job_id AS file_id", "tenant", "job_id", "'figure' AS kind", "sha2(CAST(job_id AS STRING), 256) AS sha", "'png' AS ext")))
query("file_manifest", "SELECT 'docs/' || doc_id::VARCHAR || '.txt' AS path, sha256(coalesce(text, '')) AS sha, octet_length(encode(coalesce(text, ''))) AS bytes "
    "FROM documents")(lambda t: records.file_manifest(t.documents.selectExpr("'docs/../' || doc_id || '.txt' AS path", "coalesce(text, '') AS content")))
_IR = "concat('{\"components\": [{\"ref\": \"U', design_id, '\", \"value\": \"v\"}], \"nets\": [{\"name\": \"n\", \"endpoints\": [{\"ref\": \"U1\", \"pin\": \"1\"}]}]}')"
_BROKEN = f"CASE design_id % 7 WHEN 0 THEN {_IR} WHEN 1 THEN concat('```json\n', {_IR}, '\n```') WHEN 2 THEN replace({_IR}, '\"v\"}}', '\"v\",}}') WHEN 3 THEN replace({_IR}, '\"components\"', 'components') WHEN 4 THEN replace({_IR}, '\"ref\":', '\"ref\"') WHEN 5 THEN left({_IR}, 40) ELSE '{{\"components\": []}}' END".replace("{{", "{").replace("}}", "}")


def _lenient(t) -> DataFrame:
    ok, bad = records.lenient_json(t.comps.select("design_id").distinct().selectExpr("design_id AS id", f"{_BROKEN} AS text"))
    return ok.select("id", F.col("components")[0]["ref"].alias("ref"), F.size("nets").cast("long").alias("nets"), F.lit(True).alias("read")).unionByName(bad.select("id", F.lit(None).cast("string").alias("ref"), F.lit(0).cast("long").alias("nets"), F.lit(False).alias("read")))


query("lenient_json", "SELECT DISTINCT design_id AS id, CASE WHEN design_id % 7 < 5 THEN 'U' || design_id::VARCHAR END AS ref, CAST(CASE WHEN design_id % 7 < 5 "
    "THEN 1 ELSE 0 END AS BIGINT) AS nets, design_id % 7 < 5 AS read FROM comps")(_lenient)


def _written(t) -> DataFrame:
    import uuid

    path = f"{folder(t)}/jobs-{uuid.uuid4().hex}"
    assets = review.asset_hashes(_job_files(t), _job_keys(t)).selectExpr("job_id % 5 AS tenant", "job_id", "job_id % 3 AS revision", "key", "hash")
    frames = {
        "jobs": t.jobs.selectExpr("tenant", "job_id", "job_id % 3 AS revision", "status"),
        "audit": t.lifecycle.selectExpr("job_id % 5 AS tenant", "job_id", "event_id AS revision", "action"),
        "manifests": assets.where("key = 'revision'").drop("key"),
        "versions": assets.where("key <> 'revision'").withColumn("version", F.expr("key || '@r' || revision")),
        "files": _job_files(t).selectExpr("job_id % 5 AS tenant", "job_id", "job_id % 3 AS revision", "kind", "owner", "path", "sha"),
    }
    records.job_write(frames, path, 1)
    records.job_write(frames, path, 1)  # as after a failure
    label = {"jobs": "status", "audit": "action", "manifests": "'manifest'", "versions": "'version'", "files": "kind"}
    every = [records.job_read(t.spark, path, n).selectExpr(f"'{n}' AS in", "CAST(tenant AS BIGINT) AS tenant", f"{c} AS what", "job_id") for n, c in label.items()]
    return functools.reduce(DataFrame.union, every).groupBy("in", "tenant", "what").agg(F.count("*").alias("n"), F.sum("job_id").alias("ids"))


query(
    "job_write",
    "SELECT tbl AS \"in\", tenant, what, count(*) AS n, CAST(sum(job_id) AS BIGINT) AS ids FROM (SELECT 'jobs' AS tbl, CAST(tenant AS BIGINT) AS tenant, status AS what, job_id FROM jobs UNION ALL SELECT 'audit', job_id % 5, action, job_id FROM lifecycle "
    "UNION ALL SELECT DISTINCT 'manifests', job_id % 5, 'manifest', job_id FROM jobkeys UNION ALL SELECT 'versions', job_id % 5, 'version', job_id FROM jobkeys "
    "UNION ALL SELECT 'files', job_id % 5, kind, job_id FROM (SELECT DISTINCT job_id, kind, owner, path, content FROM jobfiles)) GROUP BY 1, 2, 3",
    JOB_VIEWS,
)(_written)


# Streams: everything the table holds arrives in files by time
def _stream(t, df: DataFrame) -> DataFrame:
    return jobs.replay(t.spark, df, folder(t))


query("stream_idempotent_jobs", "SELECT scope, count(*) AS jobs FROM (SELECT DISTINCT tenant, owner, operation, sha256(concat_ws(chr(0), tenant::VARCHAR, owner::VARCHAR, "
    "operation, doc::VARCHAR, key::VARCHAR)) AS scope FROM requests) GROUP BY 1")(
    lambda t: jobs.run_to_end(jobs.stream_idempotent_jobs(_stream(t, t.requests), "3650 days"), folder(t)).groupBy("scope").agg(F.count("*").alias("jobs"))
)
def _lifecycle(t) -> DataFrame:
    """Where the jobs are at the end, and the actions that were refused on the way."""
    rows = jobs.run_to_end(jobs.stream_lifecycle(_stream(t, t.lifecycle)), folder(t))
    now = jobs.lifecycle_current(rows).selectExpr("'job' AS what", "job_id", "0L AS event_id", "state", "applied", "rejected")
    return now.union(jobs.lifecycle_rejected(rows).selectExpr("'refused'", "job_id", "event_id", "state", "0L", "0L"))


query("stream_lifecycle", LIFECYCLE_STREAM, LIFECYCLE)(_lifecycle)
query("stream_ledger", LEDGER_SQL, LEDGER)(lambda t: jobs.run_to_end(jobs.stream_ledger(_stream(t, t.ledger)), folder(t), "principal", "update"))
query(
    "stream_batches",
    "SELECT design_id, net, count(*) AS n_endpoints, max(c) AS conf_pct, CAST(sum(c) AS BIGINT) AS sum_pct FROM (SELECT design_id, "
        "upper(trim(name)) AS net, ref, pin, arg_max(conf_pct, batch_no) AS c FROM (SELECT *, count(*) OVER (PARTITION BY design_id, batch_no, "
        "net_id) AS n FROM batch_eps WHERE trim(name) <> '') WHERE n >= 2 GROUP BY 1, 2, 3, 4) GROUP BY 1, 2",
)(lambda t: jobs.latest_nets(jobs.stream_batches(_stream(t, t.batch_eps.withColumn("ts", F.timestamp_seconds(F.lit(2) - F.col("batch_no")))), folder(t))))
