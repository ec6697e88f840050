"""How well a reconstructed netlist agrees with what its source shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetgraph.functions.store import dealt

# Pin maps of known parts, as (number, name, type), and their aliases.
KNOWN_PINS = {
    "ADM8829": [("1", "OUT", "power_out"), ("2", "IN", "power_in"), ("3", "CAP-", "passive"), ("4", "GND", "power_in"), ("5", "NC", "no_connect"), ("6", "CAP+", "passive")],
    "MCP3204": [
        ("1", "CH0", "input"), ("2", "CH1", "input"), ("3", "CH2", "input"), ("4", "CH3", "input"), ("5", "NC", "no_connect"), ("6", "NC", "no_connect"), ("7", "DGND", "power_in"),
        ("8", "CS/SHDN", "input"), ("9", "DIN", "input"), ("10", "DOUT", "tri_state"), ("11", "CLK", "input"), ("12", "AGND", "power_in"), ("13", "VREF", "power_in"), ("14", "VDD", "power_in"),
    ],
    "NE555": [("1", "GND", "power_in"), ("2", "TRIG", "input"), ("3", "OUT", "output"), ("4", "RST", "input"), ("5", "CON", "input"), ("6", "THR", "input"), ("7", "DIS", "open_collector"), ("8", "VCC", "power_in")],
    "MAX6106": [("1", "IN", "power_in"), ("2", "OUT", "power_out"), ("3", "GND", "power_in")],
}
ALIASES = {"ADM8829": "ADM8829", "MCP3204": "MCP3204", "NE555": "NE555", "LM555": "NE555", "SE555": "NE555", "MAX6106": "MAX6106"}
WEIGHTS = (("components", 0.30), ("nets", 0.40), ("pins", 0.20), ("graph", 0.10))


def coverage(source: DataFrame, actual: DataFrame) -> DataFrame:
    """Of each design's distinct source values how many the reconstruction has. Both: (design_id, value)."""
    plain = lambda df: df.select("design_id", F.regexp_replace(F.upper("value"), r"\s+", "").alias("value")).where("value <> ''").distinct()
    hit = plain(source).join(dealt(plain(actual).withColumn("hit", F.lit(1))), ["design_id", "value"], "left")
    out = hit.groupBy("design_id").agg(F.count("*").alias("source"), F.count("hit").alias("matched"))
    return out.withColumn("ratio", F.col("matched") / F.col("source"))


def plain(c: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9]", "")


def known_part_match(comps: DataFrame) -> DataFrame:
    """Components whose part number, value or reference is an alias of a known part; the first part of the list counts."""
    fields = F.array(*(plain(F.col(c)) for c in ("mpn", "value", "ref")))
    part = None
    for name in KNOWN_PINS:
        hit = F.arrays_overlap(fields, F.array(*(F.lit(a) for a, p in ALIASES.items() if p == name)))
        part = F.when(hit, name) if part is None else part.when(hit, name)
    return comps.select("design_id", "ref", part.alias("part")).where("part is not null")


def known_pin_reconcile(matched: DataFrame, pins: DataFrame) -> DataFrame:
    """Pins of known components after the canonical map is applied, which wins:
    (design_id, ref, part, number, name, type, conf_pct, result, was_name, was_type).

    result: kept, corrected, added or extra. Canonical pins are 98 % sure at least, extra ones 40 % at most.
    """
    rows = [(p, no, name, kind) for p, v in KNOWN_PINS.items() for no, name, kind in v]
    canon = F.broadcast(pins.sparkSession.createDataFrame(rows, "part string, number string, c_name string, c_type string"))  # a fixed list
    want = matched.join(canon, "part")
    have = matched.join(pins.select("design_id", "ref", "number", "name", "type", "conf_pct", F.lit(True).alias("have")), ["design_id", "ref"])
    both = want.join(have, ["design_id", "ref", "part", "number"], "full")
    bare = lambda c: F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"[^A-Z0-9+\-/]", "")
    same = (bare(F.col("name")) == bare(F.col("c_name"))) & F.coalesce(F.col("type") == F.col("c_type"), F.lit(False))
    result = F.when(F.col("c_name").isNull(), "extra").when(F.col("have").isNull(), "added").when(same, "kept").otherwise("corrected")
    conf = F.when(result == "extra", F.least(F.coalesce("conf_pct", F.lit(50)), F.lit(40))).otherwise(F.greatest(F.coalesce("conf_pct", F.lit(0)), F.lit(98)))
    return both.select(
        "design_id", "ref", "part", "number", F.coalesce("c_name", "name").alias("name"), F.coalesce("c_type", "type").alias("type"), conf.cast("long").alias("conf_pct"),
        result.alias("result"), F.col("name").alias("was_name"), F.col("type").alias("was_type"),
    )


def known_pin_checks(reconciled: DataFrame) -> DataFrame:
    """Of each known component how many pins were compared, differed, were missing and are extra, and how many of those
    compared were right."""
    n = lambda *r: F.count_if(F.col("result").isin(*r))
    out = reconciled.groupBy("design_id", "ref", "part").agg(n("kept", "corrected").alias("compared"), n("corrected").alias("mismatched"), n("added").alias("missing"), n("extra").alias("extra"))
    accuracy = F.when(F.col("compared") > 0, (F.col("compared") - F.col("mismatched")) / F.col("compared")).otherwise(0.0)
    return out.withColumn("accuracy", accuracy)


def ref_reconcile(hints: DataFrame, comps: DataFrame) -> DataFrame:
    """Renames (design_id, from_ref, to_ref): a sure hint's reference is absent, and just one component, itself no source
    reference, has the hinted value as part number, value or reference.

    hints: (design_id, ref, value, confidence), the source references of the design; comps: (design_id, ref, value, mpn).
    """
    source = hints.select("design_id", F.upper("ref").alias("ref")).distinct()
    have = comps.select("design_id", F.upper("ref").alias("ref")).distinct()
    sure = hints.where("confidence >= 0.66").select("design_id", F.upper("ref").alias("ref"), plain(F.col("value")).alias("v")).where("v <> '' and ref <> ''")
    sure = sure.join(dealt(have), ["design_id", "ref"], "left_anti")
    names = F.array_distinct(F.array(*(plain(F.col(c)) for c in ("mpn", "value", "ref"))))
    lone = comps.select("design_id", "ref", F.explode(names).alias("v")).groupBy("design_id", "v").agg(F.count("*").alias("n"), F.min("ref").alias("from_ref")).where("n = 1 and v <> ''")
    lone = lone.join(dealt(source.withColumnRenamed("ref", "r")), (lone["design_id"] == source["design_id"]) & (F.upper("from_ref") == F.col("r")), "left_anti")
    hit = sure.join(dealt(lone.drop("n")), ["design_id", "v"])
    first = hit.groupBy("design_id", "from_ref").agg(F.min("ref").alias("to_ref"))
    return first.groupBy("design_id", "to_ref").agg(F.min("from_ref").alias("from_ref")).select("design_id", "from_ref", "to_ref")


def ref_rename(table: DataFrame, renames: DataFrame) -> DataFrame:
    """A table of a netlist (components, endpoints or no-connects) after renames."""
    r = renames.select("design_id", F.col("from_ref").alias("ref"), "to_ref")
    out = table.join(dealt(r), ["design_id", "ref"], "left")
    return out.select(*(F.coalesce("to_ref", "ref").alias("ref") if c == "ref" else c for c in table.columns))


def quality_signals(refs: DataFrame, labels: DataFrame, comps: DataFrame, nets: DataFrame, checks: DataFrame, health: DataFrame, renames: DataFrame) -> DataFrame:
    """One row a design with all that score and gate need.

    refs, labels: (design_id, value) of the source; comps, nets: (design_id, value) reconstructed; checks: known_pin_checks;
    health: (design_id, error, warning, review); renames: ref_reconcile.
    """
    by = lambda df, name: df.groupBy("design_id").agg(F.count("*").alias(name))
    cover = lambda src, act, a, b: coverage(src, act).select("design_id", F.col("source").alias(a), F.col("ratio").alias(b))
    known = checks.groupBy("design_id").agg(
        F.sum("compared").alias("compared"), F.sum("mismatched").alias("mismatched"), F.sum("missing").alias("missing"), F.sum("extra").alias("extra"),
        F.count_if((F.col("compared") >= 3) & (F.col("accuracy") < 0.8)).alias("conflicts"), F.count_if(F.col("extra") > 0).alias("unresolved"),
    )
    out = by(comps, "n_comps")
    for df in (by(nets, "n_nets"), cover(refs, comps, "n_refs", "components"), cover(labels, nets, "n_labels", "nets"), known, health.select("design_id", "error", "warning", "review"), by(renames, "renames")):
        out = out.join(dealt(df), "design_id", "left")
    whole = ("n_nets", "n_refs", "n_labels", "compared", "mismatched", "missing", "extra", "conflicts", "unresolved", "error", "warning", "review", "renames")
    out = out.na.fill(0, list(whole))
    pins = F.when(F.col("compared") > 0, (F.col("compared") - F.col("mismatched")) / F.col("compared"))
    size = F.greatest(F.lit(8), F.col("n_comps") + F.col("n_nets"))
    graph = 1 - (F.col("error") * 2 + F.col("warning") * F.lit(0.45) + F.col("review") * F.lit(0.2)) / size
    return out.select("*", pins.alias("pins"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), graph)).alias("graph"))


def _score() -> Column:
    """Of a row of signals."""
    top = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in WEIGHTS), F.lit(0.0))
    weight = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in WEIGHTS), F.lit(0.0))
    return F.when(weight > 0, F.floor(100 * top / weight + 0.5)).otherwise(0).cast("long")


def quality_score(signals: DataFrame) -> DataFrame:
    """Weighted mean of the signals that are there (components, nets, pins, graph), in per cent."""
    return signals.select("design_id", _score().alias("score"))


#: Issues that the gate finds, with what tells them in a row of signals; those of the first list reject.
REJECTING = [
    ("COMPONENT_COVERAGE_LOW", "n_refs >= 4 AND coalesce(components, 1.0D) < 0.7D"), ("VISIBLE_NETS_BUT_ZERO_RECONSTRUCTED", "n_labels >= 3 AND n_nets = 0"),
    ("NAMED_NET_COVERAGE_LOW", "n_labels >= 3 AND coalesce(nets, 1.0D) < 0.7D"), ("KNOWN_PINMAP_CONFLICT", "conflicts > 0"), ("KNOWN_PINMAP_EXTRA_PINS", "unresolved > 0"),
]
FINDINGS = [*((code, "error", cond) for code, cond in REJECTING if code != "KNOWN_PINMAP_CONFLICT"), ("REFERENCE_RECONCILED", "review", "renames > 0"), ("KNOWN_PINMAP_RECONCILED", "review", "mismatched + missing > 0")]


def quality_gate(signals: DataFrame) -> DataFrame:
    """(design_id, score, reasons, status, export_allowed) by quality_signals: rejected with a reason, review if something is
    unsure or was mended, else accepted."""
    rows = signals.withColumn("score", _score())
    reasons = F.array_compact(F.array(*(F.when(F.expr(cond), code) for code, cond in REJECTING)))
    unsure = (F.col("score") < 85) | (F.col("renames") + F.col("mismatched") + F.col("missing") > 0) | ((F.col("n_refs") + F.col("n_labels") == 0) & (F.col("score") < 90))
    status = F.when(F.size(reasons) > 0, "rejected").when(unsure, "review").otherwise("accepted")
    return rows.select("design_id", "score", F.array_join(reasons, ",").alias("reasons"), status.alias("status"), (status != "rejected").alias("export_allowed"))


def quality_issues(signals: DataFrame) -> DataFrame:
    """(design_id, code, severity): the gate's findings as issues."""
    found = F.array_compact(F.array(*(F.when(F.expr(cond), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, severity, cond in FINDINGS)))
    return signals.select("design_id", F.explode(found).alias("i")).select("design_id", "i.*")


def quality_health(signals: DataFrame) -> DataFrame:
    """Counts of issues per severity with the gate's findings among them."""
    own = quality_issues(signals).groupBy("design_id").agg(F.count_if(F.col("severity") == "error").alias("e"), F.count_if(F.col("severity") == "review").alias("r"))
    out = signals.join(own, "design_id", "left").na.fill(0, ["e", "r"])
    return out.select("design_id", (F.col("error") + F.col("e")).alias("error"), "warning", (F.col("review") + F.col("r")).alias("review"))


TARGETS = {"ref": 0.95, "net": 0.95, "pin": 1.0}


def golden_recall(expected: DataFrame, actual: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """Share of expected values (kind, value) that each design has, and whether it meets the kind's target.

    Kinds: `ref`, `net`, and `pin` as `ref.number=name`, whose share is the accuracy of the pin maps.
    """
    targets = targets or TARGETS
    want = expected.select("kind", "value").distinct()
    found = actual.select("design_id", "kind", "value").distinct().join(want, ["kind", "value"]).groupBy("design_id", "kind").agg(F.count("*").alias("hits"))
    # Kinds are few, so all of them with their numbers are one row.
    totals = want.groupBy("kind").agg(F.count("*").alias("total")).agg(F.collect_list(F.struct("kind", "total")).alias("all"))
    every = actual.select("design_id").distinct().crossJoin(F.broadcast(totals)).select("design_id", F.explode("all").alias("t")).select("design_id", "t.*")
    out = every.join(found, ["design_id", "kind"], "left")
    recall = F.coalesce("hits", F.lit(0)) / F.col("total")
    target = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in targets.items() for x in kv]), F.col("kind")), F.lit(0.95))
    return out.select("design_id", "kind", recall.alias("recall"), (recall >= target).alias("meets"))
