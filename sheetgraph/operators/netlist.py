"""Netlists: components, pins, nets and endpoints as tables keyed by design_id.

components(design_id, ref, value, conf_pct), pins(design_id, ref, number, name, type, conf_pct),
nets(design_id, net_id, name, conf_pct), endpoints(design_id, net_id, ref, pin, conf_pct), no_connects(design_id, ref, pin).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sheetgraph.functions.rx import matches

# References that need default pins, pin types and sides.
TWO_PIN = r"^[RCLDF]\d+"
PIN_TYPES = ("input", "output", "bidirectional", "power_in", "power_out", "passive", "tri_state", "open_collector", "no_connect", "unspecified")
MAX_COMPONENTS, MAX_NETS, MAX_ENDPOINTS = 300, 1200, 128


def skeleton(refs: DataFrame, hints: DataFrame) -> DataFrame:
    """One component per census reference; the hint names its value, and its part if it has letters and digits."""
    h = hints.select("design_id", "ref", F.col("value").alias("hint"))
    part = matches(F.col("hint"), r"[A-Za-z].*\d|\d.*[A-Za-z]")
    out = refs.join(h, ["design_id", "ref"], "left")
    pins = F.when(matches(F.col("ref"), TWO_PIN, True), 2).otherwise(0)
    return out.select("design_id", "ref", F.coalesce("hint", "ref").alias("value"), F.when(part, F.col("hint")).otherwise("").alias("mpn"), pins.alias("n_pins"), F.lit(92).alias("conf_pct"))


def merge_pins(base: DataFrame, incoming: DataFrame) -> DataFrame:
    """Pins of both by number: what comes in wins, confidence is the larger."""
    inc = incoming.select("design_id", "ref", "number", F.col("name").alias("i_name"), F.col("type").alias("i_type"), F.col("conf_pct").alias("i_conf"))
    out = base.join(inc, ["design_id", "ref", "number"], "full")
    conf = F.greatest(F.coalesce("conf_pct", F.lit(0)), F.coalesce("i_conf", F.lit(0)))
    return out.select("design_id", "ref", "number", F.coalesce("i_name", "name").alias("name"), F.coalesce("i_type", "type").alias("type"), conf.alias("conf_pct"))


def merge_model(base: DataFrame, model: DataFrame) -> DataFrame:
    """The skeleton enriched by reference; references of the model alone are appended and never replace one."""
    m = model.select("design_id", "ref", F.col("value").alias("m_value"), F.col("conf_pct").alias("m_conf"))
    value = F.coalesce(F.expr("nullif(m_value, '')"), F.expr("nullif(value, '')"), "ref")
    hit = base.join(m, ["design_id", "ref"], "left").select("design_id", "ref", value.alias("value"), F.greatest("conf_pct", F.coalesce("m_conf", F.lit(0))).alias("conf_pct"))
    extra = model.join(base, ["design_id", "ref"], "left_anti").select("design_id", "ref", "value", "conf_pct")
    return hit.unionByName(extra)


def focus_batches(refs: DataFrame, size: int = 18) -> DataFrame:
    """Chunks of 8 to 28 references in order."""
    size = min(28, max(8, size))
    rank = F.row_number().over(W.partitionBy("design_id").orderBy("ref"))
    return refs.select("design_id", "ref", F.floor((rank - 1) / size).alias("batch_no"))


def batch_components(rows: DataFrame) -> DataFrame:
    """Components over ordered batches: the last batch that has a value wins, confidence is the largest."""
    last = F.max_by("value", F.when(F.col("value").isNotNull(), F.col("batch_no")))
    return rows.groupBy("design_id", "ref").agg(last.alias("value"), F.max("conf_pct").alias("conf_pct"))


def batch_named_nets(rows: DataFrame) -> DataFrame:
    """Named nets over batches by upper-case name, from contributions of two or more endpoints; per endpoint the last wins.

    rows: (design_id, batch_no, net_id, name, ref, pin, conf_pct).
    """
    named = rows.where((F.trim("name") != "") & ~matches(F.col("name"), r"^N\$?\d+$", True))
    n = F.count("*").over(W.partitionBy("design_id", "batch_no", "net_id"))
    named = named.withColumn("n", n).where("n >= 2")
    ends = named.groupBy("design_id", F.upper(F.trim("name")).alias("net"), "ref", "pin").agg(F.max_by("conf_pct", "batch_no").alias("conf_pct"))
    return ends.groupBy("design_id", "net").agg(F.count("*").alias("n_endpoints"), F.max("conf_pct").alias("conf_pct"), F.sum("conf_pct").alias("sum_pct"))


def batch_rollup(nets: DataFrame, ncs: DataFrame, warnings: DataFrame) -> DataFrame:
    """Of a merged design: its nets, distinct no-connects (design_id, ref, pin) and distinct warnings (design_id, text), and
    its confidence in thousandths: 550 + min(350, 5 n) for n nets, at most 950, 350 without nets."""
    n = F.col("n_nets")
    conf = F.when(n > 0, F.least(F.lit(950), 550 + F.least(F.lit(350), n * 5))).otherwise(350)
    count = lambda df, name: df.distinct().groupBy("design_id").agg(F.count("*").alias(name))
    ends = ncs.select("design_id", F.upper("ref").alias("ref"), "pin")
    out = nets.groupBy("design_id").agg(F.count("*").alias("n_nets")).join(count(ends, "n_no_connects"), "design_id", "full").join(count(warnings.select("design_id", "text"), "n_warnings"), "design_id", "full")
    return out.na.fill(0).select("design_id", "n_nets", conf.cast("long").alias("conf_mille"), "n_no_connects", "n_warnings")


def dedupe_refs(rows: DataFrame) -> DataFrame:
    """A reference seen again gets _2, _3, ... in order of pos."""
    k = F.row_number().over(W.partitionBy("design_id", "ref").orderBy("pos"))
    name = F.when(k == 1, F.col("ref")).otherwise(F.concat("ref", F.lit("_"), k.cast("string")))
    return rows.select("design_id", "pos", F.col("ref").alias("old_ref"), name.alias("ref"), (k > 1).alias("renamed"))


def normalize_comp_pins(rows: DataFrame, most: int = 256) -> DataFrame:
    """Pins in order of pos: blank or `?` numbers become the position, repeated ones get a suffix, odd types unspecified."""
    raw = F.trim(F.coalesce("number", F.lit("")))
    place = F.row_number().over(W.partitionBy("design_id", "ref").orderBy("pos"))
    rows = rows.withColumn("place", place).where(F.col("place") <= most)
    rows = rows.withColumn("no", F.when(raw.isin("", "?"), F.col("place").cast("string")).otherwise(raw))
    k = F.row_number().over(W.partitionBy("design_id", "ref", "no").orderBy("pos"))
    number = F.when(k == 1, F.col("no")).otherwise(F.concat("no", F.lit("_"), k.cast("string")))
    kind = F.when(F.col("type").isin(*PIN_TYPES), F.col("type")).otherwise("unspecified")
    right = kind.isin("power_out", "output", "bidirectional")
    side = F.when(kind == "power_in", F.when(F.col("place") % 2 == 1, "top").otherwise("bottom")).when(right, "right").otherwise("left")
    return rows.select("design_id", "ref", "place", number.alias("number"), F.coalesce(F.expr("nullif(name, '')"), number).alias("name"), kind.alias("type"), side.alias("side"))


def default_passive_pins(comps: DataFrame, pins: DataFrame) -> DataFrame:
    """Pins 1 and 2 for two-pin components that have none."""
    bare = comps.where(matches(F.col("ref"), TWO_PIN, True)).join(pins.select("design_id", "ref"), ["design_id", "ref"], "left_anti")
    side = F.when(F.col("number") == "1", "left").otherwise("right")
    return bare.select("design_id", "ref", F.explode(F.array(F.lit("1"), F.lit("2"))).alias("number")).select("*", F.lit("passive").alias("type"), side.alias("side"), F.lit(45).alias("conf_pct"))


def library_hint(ref: Column, value: Column, n_pins: Column) -> Column:
    """Library id by reference, value and number of pins; empty if none fits."""
    r, v = F.upper(ref), F.upper(value)
    like = lambda c, p: matches(c, p)
    return (
        F.when(like(r, r"^R\d+"), "Device:R")
        .when(like(r, r"^C\d+"), F.when(like(v, "POL|ELECT|TANT"), "Device:C_Polarized").otherwise("Device:C"))
        .when(like(r, r"^L\d+"), "Device:L")
        .when(like(r, r"^F\d+"), "Device:Fuse")
        .when(like(r, r"^D\d+") & like(v, "LED"), "Device:LED")
        .when(like(r, r"^D\d+"), "Device:D")
        .when(like(r, r"^SW\d+"), "Switch:SW_SPST")
        .when(like(r, r"^J\d+") & (n_pins > 0) & (n_pins <= 40), F.concat(F.lit("Connector_Generic:Conn_01x"), F.lpad(n_pins.cast("string"), 2, "0")))
        .otherwise("")
    )


def resolve_endpoints(raw: DataFrame, pins: DataFrame) -> DataFrame:
    """Endpoints whose pin names a pin by number, else by name; the rest carry a warning. One row per net and pin.

    raw: (design_id, net_id, ref, pin, conf_pct); endpoints of unknown references are dropped.
    """
    known = pins.select("design_id", "ref").distinct()
    numbers = pins.select("design_id", "ref", F.col("number").alias("pin"), F.col("number").alias("by_number"))
    names = pins.groupBy("design_id", "ref", F.col("name").alias("pin")).agg(F.min_by("number", F.col("number").cast("int")).alias("by_name"))
    out = raw.join(known, ["design_id", "ref"]).join(numbers, ["design_id", "ref", "pin"], "left").join(names, ["design_id", "ref", "pin"], "left")
    out = out.withColumn("number", F.coalesce("by_number", "by_name"))
    return out.groupBy("design_id", "net_id", "ref", F.coalesce("number", "pin").alias("pin"), F.col("number").isNull().alias("unknown")).agg(F.max("conf_pct").alias("conf_pct"))


def filter_nets(nets: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Nets of two or more endpoints; blank names become N$1, N$2, ... in order."""
    n = endpoints.groupBy("design_id", "net_id").agg(F.count("*").alias("n_endpoints")).where("n_endpoints >= 2")
    kept = nets.join(n, ["design_id", "net_id"])
    blank = (F.trim(F.coalesce("name", F.lit(""))) == "").cast("int")
    k = F.sum(blank).over(W.partitionBy("design_id").orderBy("net_id").rowsBetween(W.unboundedPreceding, 0))
    return kept.select("design_id", "net_id", F.when(blank == 1, F.concat(F.lit("N$"), k.cast("string"))).otherwise(F.trim("name")).alias("name"), "n_endpoints", "conf_pct")


def no_connects(pins: DataFrame, declared: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Pins typed or declared no-connect, and a warning for other unconnected pins under 50 % confidence."""
    d = declared.select("design_id", "ref", F.col("pin").alias("number"), F.lit(True).alias("declared")).distinct()
    e = endpoints.select("design_id", "ref", F.col("pin").alias("number"), F.lit(True).alias("connected")).distinct()
    out = pins.join(d, ["design_id", "ref", "number"], "left").join(e, ["design_id", "ref", "number"], "left")
    nc = (F.col("type") == "no_connect") | F.col("declared").isNotNull()
    out = out.select("design_id", "ref", F.col("number").alias("pin"), F.when(nc, "no_connect").when(F.col("connected").isNull() & (F.col("conf_pct") < 50), "unconnected_low_confidence").alias("kind"))
    return out.where("kind is not null")


def ir_caps(comps: DataFrame, nets: DataFrame, endpoints: DataFrame, most=(MAX_COMPONENTS, MAX_NETS, MAX_ENDPOINTS)) -> DataFrame:
    """What stays of each design under the caps on components, nets and endpoints per net."""
    first = lambda df, keys, order, n: df.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= n).groupBy("design_id").agg(F.count("*").alias("n"))
    c = first(comps, ["design_id"], ["ref"], most[0]).withColumnRenamed("n", "components")
    n = first(nets, ["design_id"], ["net_id"], most[1]).withColumnRenamed("n", "nets")
    e = first(endpoints, ["design_id", "net_id"], ["ref", "pin"], most[2]).withColumnRenamed("n", "endpoints")
    return c.join(n, "design_id", "full").join(e, "design_id", "full").na.fill(0)


def netlist_summary(comps: DataFrame, pins: DataFrame, nets: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Counts of a design and its confidence, the least of its components'."""
    count = lambda df, name: df.groupBy("design_id").agg(F.count("*").alias(name))
    out = comps.groupBy("design_id").agg(F.count("*").alias("components"), F.min("conf_pct").alias("conf_pct"))
    return out.join(count(pins, "pins"), "design_id", "left").join(count(nets, "nets"), "design_id", "left").join(count(endpoints, "endpoints"), "design_id", "left").na.fill(0)


def netlist_rename(endpoints: DataFrame, renames: DataFrame) -> DataFrame:
    """Endpoints after references (and pins) are renamed by (design_id, ref, pin or null, new_ref, new_pin)."""
    r = renames.select("design_id", "ref", "new_ref").where("new_ref is not null").distinct()
    p = renames.select("design_id", "ref", "pin", "new_pin").where("pin is not null").distinct()
    out = endpoints.join(r, ["design_id", "ref"], "left").join(p, ["design_id", "ref", "pin"], "left")
    return out.select("design_id", "net_id", F.coalesce("new_ref", "ref").alias("ref"), F.coalesce("new_pin", "pin").alias("pin"))


def pin_peers(endpoints: DataFrame, of: DataFrame) -> DataFrame:
    """For the pins in `of` (design_id, ref, pin) the other endpoints of their nets, counted per net."""
    mine = of.join(endpoints, ["design_id", "ref", "pin"]).select("design_id", "net_id", F.col("ref").alias("of_ref"), F.col("pin").alias("of_pin"))
    peers = mine.join(endpoints, ["design_id", "net_id"]).where("ref <> of_ref or pin <> of_pin")
    return peers.select("design_id", "of_ref", "of_pin", "net_id", "ref", "pin")


def net_search(nets: DataFrame, endpoints: DataFrame, text: str) -> DataFrame:
    """Nets whose name, or one of whose `ref.pin`, contains a text."""
    t = text.lower()
    hit = endpoints.where(F.lower(F.concat_ws(".", "ref", "pin")).contains(t)).select("design_id", "net_id")
    found = nets.where(F.lower("name").contains(t)).select("design_id", "net_id").union(hit).distinct()
    return nets.join(found, ["design_id", "net_id"], "left_semi").select("design_id", "net_id", "name")


def endpoint_context(endpoints: DataFrame, nets: DataFrame, pins: DataFrame) -> DataFrame:
    """Endpoint x net x pin. Every rule reads this. Nets are joined last, so rows of a net come out together."""
    n = nets.select("design_id", "net_id", F.col("name").alias("net"), F.col("conf_pct").alias("net_conf"))
    p = pins.select("design_id", "ref", F.col("number").alias("pin"), F.col("name").alias("pin_name"), "type", F.col("conf_pct").alias("pin_conf"))
    out = endpoints.select("design_id", "net_id", "ref", "pin").join(p, ["design_id", "ref", "pin"]).join(n, ["design_id", "net_id"])
    return out.select("design_id", "ref", "pin", "net_id", "net", "net_conf", "pin_name", "type", "pin_conf")
