"""Cleaning of pins and packages with a record of every change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sheetgraph.functions.rx import first_of, matches
from sheetgraph.operators.netlist import PIN_TYPES

# Aliases of thermal pads, family rules in order, ranges and defaults of package fields.
EP_ALIAS = r"^(EP|EPAD|E-?PAD|PAD|DAP|TAB|THERMAL\s*PAD)$"
FAMILY_RULES = [
    ("lcc", r"LCCC|PLCC|CLCC|\bLCC\b"),
    ("qfp", r"\bQFP\b|TQFP|LQFP|MQFP"),
    ("power_tab", r"TO-?\d|SOT-?223|DPAK|D2PAK"),
    ("qfn", r"LFCSP|QFN|DFN|SON|WSON|X2SON|VQFN|UQFN|WQFN|HVQFN"),
    ("dual", r"SOT-?23-?[56]|TSOT-?23"),
    ("sot23", r"SOT-?23($|[^-\d])|SOT-?23-?3"),
    ("dual", r"SC-?70|SOT-?353|SOT-?363"),
    ("dual", r"\bSOIC\b|\bSOP\b|\bSO-?\d|\bTSSOP\b|\bSSOP\b|\bMSOP\b|\bVSSOP\b|\bHTSSOP\b|\bQSOP\b|\bTVSOP\b"),
    ("dip", r"\bPDIP\b|\bDIP\b|\bCDIP\b|\bCERDIP\b"),
]
BGA = r"BGA|DSBGA|WLCSP|WCSP|FCBGA|\bCSP\b"
SUPPORTED = ("dual", "qfn", "dip", "sot23")
#: field: (least, most, default)
FIELDS = {
    "pitch": (0.2, 5.08, 1.27), "body_length": (0.5, 80.0, 4.9), "body_width": (0.5, 80.0, 3.9), "height": (0.2, 10.0, 1.0),
    "lead_span": (0.5, 90.0, 6.0), "lead_length": (0.1, 5.0, 1.0), "row_span": (2.54, 30.0, 7.62),
}
QFN_DEFAULTS = {"pitch": 0.5, "lead_length": 0.4}
CRITICAL = {"dip": ["pitch", "body_length", "body_width", "row_span", "height"], "qfn": ["pitch", "body_length", "body_width", "lead_length", "height"]}
CRITICAL_ELSE = ["pitch", "body_length", "body_width", "lead_span", "height"]
LAND = {"pad_w": (0.1, 5.0), "pad_l": (0.1, 6.0), "lp_row_span": (1.0, 90.0)}
SPLIT = r"[,、/;\s]+"


def expanded(raw: DataFrame) -> DataFrame:
    """One row for each number token of each raw pin, in order, with cleaned name and type."""
    name = F.trim(F.coalesce("name", F.lit("")))
    tokens = F.filter(F.split(F.col("number"), SPLIT), lambda x: x != "")
    rows = raw.where("number is not null").select("package_id", "pos", F.posexplode(tokens).alias("part", "number"), F.when(name == "", "NC").otherwise(name).alias("name"), F.when(F.col("type").isin(*PIN_TYPES), F.col("type")).otherwise("unspecified").alias("type"))
    k = F.row_number().over(W.partitionBy("package_id", F.upper("number")).orderBy("pos", "part"))
    return rows.withColumn("seen", k)


def sanitize_pins(raw: DataFrame) -> DataFrame:
    """Merged numbers split, blank names NC, odd types unspecified; the first of a number wins."""
    return expanded(raw).where("seen = 1").drop("seen")


def renumber_ep(pins: DataFrame) -> DataFrame:
    """Thermal-pad aliases get the numbers after the largest, in order; unspecified ones become passive."""
    alias = matches(F.col("number"), EP_ALIAS, True)
    top = F.max(F.when(matches(F.col("number"), r"^\d+$"), F.col("number").cast("long"))).over(W.partitionBy("package_id"))
    k = F.sum(alias.cast("long")).over(W.partitionBy("package_id").orderBy("pos", "part"))
    own = (F.col("name") == "NC") | matches(F.col("name"), EP_ALIAS, True)
    return pins.select(
        "package_id", "pos", "part", F.when(alias, (F.coalesce(top, F.lit(0)) + k).cast("string")).otherwise(F.col("number")).alias("number"),
        F.when(alias & own, "EP").otherwise(F.col("name")).alias("name"), F.when(alias & (F.col("type") == "unspecified"), "passive").otherwise(F.col("type")).alias("type"), alias.alias("ep"),
    )


def transformation_log(raw: DataFrame) -> DataFrame:
    """(package_id, op, n): how often each change happens to a package's pins."""
    blank = F.trim(F.coalesce("name", F.lit(""))) == ""
    has = F.col("number").isNotNull()
    n_tokens = F.size(F.filter(F.split(F.col("number"), SPLIT), lambda x: x != ""))
    ops = [(~has, "drop_row"), (has & blank, "empty_name_to_nc"), (has & ~F.coalesce(F.col("type").isin(*PIN_TYPES), F.lit(False)), "invalid_type_fallback"), (has & (n_tokens > 1), "merged_row_expanded")]
    rows = raw.select("package_id", F.explode(F.array_compact(F.array(*(F.when(c, op) for c, op in ops)))).alias("op"))
    e = expanded(raw)
    rows = rows.union(e.where("seen > 1").select("package_id", F.lit("duplicate_number_dropped"))).union(e.where("seen = 1").where(matches(F.col("number"), EP_ALIAS, True)).select("package_id", F.lit("ep_renumbered")))
    return rows.groupBy("package_id", "op").agg(F.count("*").alias("n"))


def pinset_overlay(pins: DataFrame, edits: DataFrame) -> DataFrame:
    """Cleaned pins with reviewers' edits (package_id, number, action, name): renamed, removed, or added."""
    e = edits.select("package_id", "number", "action", F.col("name").alias("e_name"))
    kept = pins.join(e.where("action = 'remove'"), ["package_id", "number"], "left_anti").join(e.where("action = 'update'").drop("action"), ["package_id", "number"], "left")
    kept = kept.select("package_id", "number", F.coalesce("e_name", "name").alias("name"), F.col("e_name").isNotNull().alias("reviewed"))
    new = e.where("action = 'add'").join(pins, ["package_id", "number"], "left_anti").select("package_id", "number", F.col("e_name").alias("name"), F.lit(True).alias("reviewed"))
    return kept.unionByName(new)


def family_of(text: Column) -> Column:
    t = F.upper(text)
    return F.when(matches(t, BGA) & ~matches(t, "LFCSP"), "bga").otherwise(first_of(t, FAMILY_RULES, F.lit("unknown")))


def package_family(packages: DataFrame) -> DataFrame:
    """Family of each package by its type; a SOT-23 of another pin count than 3 goes the dual way."""
    f = family_of(F.col("type"))
    f = F.when((f == "sot23") & (F.col("pin_count") != 3), "dual").otherwise(f)
    return packages.select("package_id", "type", f.alias("family"), f.isin(*SUPPORTED).alias("supported"))


def _long(packages: DataFrame, fields: list[str]) -> DataFrame:
    return packages.unpivot(["package_id", "family"], fields, "field", "raw")


def field_provenance(packages: DataFrame, reviewed: DataFrame | None = None) -> DataFrame:
    """(package_id, family, field, source, raw, value, reviewer): missing fields get defaults, those out of range are
    clamped, what isn't a number (NaN) is invalid; what reviewers set stands if it is in range. Fields that a family
    has no use for are not_applicable when missing.

    packages carries its family; reviewed: (package_id, field, value, reviewer).
    """
    row = lambda v: F.struct(*(F.lit(float(y)).alias(n) for n, y in zip(("least", "most", "default"), v, strict=True)))
    r = F.element_at(F.create_map(*[x for k, v in FIELDS.items() for x in (F.lit(k), row(v))]), F.col("field"))
    default = r["default"]
    for k, v in QFN_DEFAULTS.items():
        default = F.when((F.col("family") == "qfn") & (F.col("field") == k), v).otherwise(default)
    long = _long(packages, list(FIELDS))
    if reviewed is not None:
        edits = reviewed.select("package_id", "field", F.col("value").alias("edited"), F.coalesce("reviewer", F.lit("")).alias("reviewer"))
        long = long.join(edits, ["package_id", "field"], "left")
    else:
        long = long.select("*", F.lit(None).cast("double").alias("edited"), F.lit(None).cast("string").alias("reviewer"))
    by_hand = F.col("reviewer").isNotNull()
    given = F.when(by_hand, F.col("edited")).otherwise(F.col("raw"))
    outside = (given < r["least"]) | (given > r["most"])
    useless = ~F.array_contains(relevant_fields(), F.col("field"))
    source = (
        F.when(by_hand, F.when(given.isNull() | outside, "clamped").otherwise("reviewer"))
        .when(given.isNull(), F.when(useless, "not_applicable").otherwise("missing")).when(F.isnan(given), "invalid").when(outside, "clamped").otherwise("datasheet")
    )
    value = F.when(given.isNull() | F.isnan(given), default).otherwise(F.least(r["most"], F.greatest(r["least"], given)))
    who = F.nullif(F.col("reviewer"), F.lit(""))
    return long.select("package_id", "family", "field", source.alias("source"), "raw", value.alias("value"), who.alias("reviewer"))


def relevant_fields() -> Column:
    """The fields that a package's family needs."""
    need = F.lit(None).cast("array<string>")
    for family, fields in CRITICAL.items():
        need = F.when(F.col("family") == family, F.array(*map(F.lit, fields))).otherwise(need)
    return F.coalesce(need, F.array(*map(F.lit, CRITICAL_ELSE)))


def optional_fields(packages: DataFrame, fields: dict[str, tuple[float, float]]) -> DataFrame:
    """Fields that may be absent: null and 0 are absent, what isn't a number (NaN) is invalid and has no value, out of range is clamped."""
    ranges = F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), F.array(*(F.lit(float(y)) for y in v)))])
    r = F.element_at(ranges, F.col("field"))
    gone = F.col("raw").isNull() | (F.col("raw") == 0)
    odd = ~gone & F.isnan("raw")
    source = F.when(gone, "absent").when(odd, "invalid").when((F.col("raw") < r[0]) | (F.col("raw") > r[1]), "clamped").otherwise("datasheet")
    return _long(packages, list(fields)).select("package_id", "field", source.alias("source"), F.when(~gone & ~odd, F.least(r[1], F.greatest(r[0], F.col("raw")))).alias("value"))


def land_void() -> Column:
    """Whether a sub-field of a package's own land pattern is out of range."""
    bad = None
    for c, (lo, hi) in LAND.items():
        out = F.coalesce((F.col(c) < lo) | (F.col(c) > hi), F.lit(False))
        bad = out if bad is None else bad | out
    return bad


def land_holds() -> Column:
    """Whether a package's own land pattern holds: every sub-field given is in range, and all three are given."""
    return ~land_void() & F.coalesce(*(F.when(F.col(c).isNull() | (F.col(c) == 0), False) for c in LAND), F.lit(True))


def land_pattern(packages: DataFrame) -> DataFrame:
    """Whether a package's own land pattern holds, and its source."""
    return packages.select("package_id", land_holds().alias("kept"), F.when(land_holds(), "datasheet").otherwise("derived_by_rules").alias("source"), land_void().alias("void"))


def critical_missing(provenance: DataFrame) -> DataFrame:
    """Fields that a family needs and that are missing, clamped, invalid, or edited by nobody known."""
    unsigned = (F.col("source") == "reviewer") & F.col("reviewer").isNull()
    bad = provenance.where((F.col("source").isin("missing", "clamped", "invalid") | unsigned) & F.array_contains(relevant_fields(), F.col("field")))
    return bad.groupBy("package_id").agg(F.array_join(F.array_sort(F.collect_set("field")), ",").alias("fields"))


def symbol_groups(pins: DataFrame, packages: DataFrame) -> DataFrame:
    """Packages of a part whose pins are alike by number, name and type share a symbol: (package_id, part, fingerprint,
    sharers, symbol). A part's first symbol has its name, others the type of their first package with it.

    packages: (package_id, part, type, place), place being its order within the part.
    """
    pin = F.concat_ws("|", "number", "name", "type")
    prints = pins.groupBy("package_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(pin)), "\n"), 256).alias("fingerprint"))
    own = packages.select("package_id", "part", "type", "place").join(prints, "package_id")
    symbols = own.groupBy("part", "fingerprint").agg(F.count("*").alias("sharers"), F.min(F.struct("place", "type")).alias("first"))
    k = F.row_number().over(W.partitionBy("part").orderBy("first.place"))
    tag = F.upper(F.regexp_replace("first.type", r"\W+", ""))
    name = F.when(k == 1, F.col("part")).otherwise(F.concat_ws("_", "part", F.when(tag == "", "ALT").otherwise(tag)))
    symbols = symbols.select("part", "fingerprint", "sharers", name.alias("symbol"))
    return own.join(symbols, ["part", "fingerprint"]).select("package_id", "part", "fingerprint", "sharers", "symbol")


def active_low_name(name: Column) -> Column:
    """`X#`, `/X` and `~X` with the overline mark `~{X}`."""
    body = F.regexp_replace(name, r"^[/~]|#$", "")
    return F.when(matches(name, r"^[/~].+$|^.+#$"), F.concat(F.lit("~{"), body, F.lit("}"))).otherwise(name)


# Ports that links may name, and networks that no link may reach, as first and last address or group.
PORTS = ("", "80", "443", "8080", "8443")
PRIVATE_V4 = [("0.0.0.0", "0.255.255.255"), ("10.0.0.0", "10.255.255.255"), ("100.64.0.0", "100.127.255.255"), ("127.0.0.0", "127.255.255.255"), ("169.254.0.0", "169.254.255.255"),
              ("172.16.0.0", "172.31.255.255"), ("192.168.0.0", "192.168.255.255"), ("224.0.0.0", "255.255.255.255")]
PRIVATE_GROUPS = [(0xFC, 0xFD), (0xFC0, 0xFDF), (0xFC00, 0xFDFF), (0xFE80, 0xFE80)]  # of an IPv6 address' first group
LINK = r"^([A-Za-z][A-Za-z0-9+.-]*):[/\\]{2}([^/?#\\]*)"


def v4_number(dotted: str) -> int:
    a, b, c, d = map(int, dotted.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def private_v4(number: Column) -> Column:
    """Whether a number is the address of a private, reserved or multicast network."""
    out = F.lit(False)
    for low, high in PRIVATE_V4:
        out = out | number.between(v4_number(low), v4_number(high))
    return out


def with_v4(rows: DataFrame) -> DataFrame:
    """Column v4: the number that a host of one to four decimal, octal or hexadecimal parts stands for, the last of which fills
    up the address; -1 if its last part is a number but it is no address, null for names."""
    is_hex, is_octal, is_decimal = (lambda p, r=r: p.rlike(r) for r in ("^0x[0-9a-f]{0,8}$", "^0[0-7]{1,11}$", "^(0|[1-9][0-9]{0,9})$"))
    one = lambda p: F.when(p == "0x", "0").when(is_hex(p), F.conv(F.substring(p, 3, 8), 16, 10)).when(is_octal(p), F.conv(p, 8, 10)).when(is_decimal(p), p)
    rows = rows.withColumn("_parts", F.split(F.regexp_replace("host", r"\.$", ""), r"\."))
    rows = rows.withColumn("_looks", F.element_at("_parts", -1).rlike("^([0-9]+|0x[0-9a-f]*)$"))
    rows = rows.withColumn("_numbers", F.transform("_parts", lambda p: one(p).cast("long"))).withColumn("_n", F.size("_parts"))
    rows = rows.withColumn("_before", F.slice("_numbers", 1, F.col("_n") - 1)).withColumn("_last", F.element_at("_numbers", -1))
    rows = rows.withColumn("_room", F.pow(F.lit(256.0), 5 - F.col("_n")).cast("long"))
    fine = (F.col("_n") <= 4) & ~F.exists("_numbers", lambda x: x.isNull()) & ~F.exists("_before", lambda x: x > 255) & (F.col("_last") < F.col("_room"))
    number = F.aggregate("_before", F.lit(0).cast("long"), lambda a, x: a * 256 + x) * F.col("_room") + F.col("_last")
    v4 = F.when(F.col("_looks"), F.when(F.coalesce(fine, F.lit(False)), number).otherwise(F.lit(-1).cast("long")))
    return rows.withColumn("v4", v4).drop("_parts", "_looks", "_numbers", "_n", "_before", "_last", "_room")


def with_v6(rows: DataFrame) -> DataFrame:
    """Column v6: the eight numbers of an IPv6 address in brackets (a dotted tail is two of them), null if it is none."""
    tail = r"(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"
    rows = rows.withColumn("_text", F.when(F.col("host").startswith("["), F.regexp_extract("host", r"^\[(.*)\]$", 1)))
    rows = rows.withColumn("_bytes", F.when(F.col("_text").rlike(":" + tail), F.array(*(F.regexp_extract("_text", tail, i).cast("int") for i in range(1, 5)))))
    pair = lambda i: F.lower(F.hex(F.col("_bytes")[i] * 256 + F.col("_bytes")[i + 1]))
    dotted = F.when(~F.exists("_bytes", lambda x: x > 255), F.concat(F.regexp_replace("_text", tail, ""), pair(0), F.lit(":"), pair(2)))
    rows = rows.withColumn("_halves", F.split(F.when(F.col("_bytes").isNotNull(), dotted).otherwise(F.col("_text")), "::", -1))
    groups = lambda half: F.when(half == "", F.array().cast("array<string>")).otherwise(F.split(half, ":", -1))
    rows = rows.withColumn("_left", groups(F.col("_halves")[0])).withColumn("_right", F.when(F.size("_halves") == 2, groups(F.try_element_at("_halves", F.lit(2)))))
    rows = rows.withColumn("_gap", F.when(F.col("_right").isNotNull(), 8 - F.size("_left") - F.size("_right")))
    filled = F.concat("_left", F.array_repeat(F.lit("0"), F.greatest(F.col("_gap"), F.lit(0))), "_right")
    rows = rows.withColumn("_every", F.when(F.size("_halves") == 1, F.col("_left")).when((F.size("_halves") == 2) & (F.col("_gap") >= 1), filled))
    fine = (F.size("_every") == 8) & ~F.exists("_every", lambda g: ~g.rlike("^[0-9a-f]{1,4}$"))
    v6 = F.when(fine, F.transform("_every", lambda g: F.conv(g, 16, 10).cast("long")))
    return rows.withColumn("v6", v6).drop("_text", "_bytes", "_halves", "_left", "_right", "_gap", "_every")


def private_v6(groups: Column) -> Column:
    """Loopback, unspecified, link-local and unique local addresses, and IPv4 addresses in IPv6 form by their number."""
    g = lambda i: F.element_at(groups, i)
    zero = lambda n: F.aggregate(F.slice(groups, 1, n), F.lit(0).cast("long"), lambda a, x: a + x) == 0
    out = zero(7) & (g(8) <= 1)
    for low, high in PRIVATE_GROUPS:
        out = out | g(1).between(low, high)
    return out | (zero(5) & (g(6) == 0xFFFF) & private_v4(g(7) * 65536 + g(8)))


def url_check(pages: DataFrame) -> DataFrame:
    """Whether a link may be fetched: http or https, an allowed port, and no host that is, in any notation, an address of a
    private, reserved or multicast network (or localhost). User info before the host is left aside."""
    scheme, place = F.lower(F.regexp_extract("url", LINK, 1)), F.regexp_extract("url", LINK, 2)
    place = F.regexp_replace(place, r"^.*@", "")
    rows = pages.select("page_id", "url", scheme.alias("scheme"), F.lower(F.regexp_extract(place, r"^(\[[^\]]*\]|[^:\[\]]*)(:[0-9]*)?$", 1)).alias("host"), F.regexp_extract(place, r":([0-9]*)$", 1).alias("port"), place.rlike(r"^(\[[^\]]*\]|[^:\[\]]+)(:[0-9]*)?$").alias("formed"))
    rows = with_v6(with_v4(rows))
    port = F.regexp_replace("port", "^0+(?=.)", "")
    broken = (F.col("scheme") == "") | ~F.col("formed") | (F.col("host") == "") | F.col("v4").eqNullSafe(-1) | (F.col("host").startswith("[") & F.col("v6").isNull())
    private = F.coalesce(private_v4(F.col("v4")), F.lit(False)) | F.coalesce(private_v6(F.col("v6")), F.lit(False)) | F.col("host").rlike(r"^(.*\.)?localhost\.?$")
    why = F.when(F.coalesce(broken, F.lit(True)), "invalid").when(~F.col("scheme").isin("http", "https"), "scheme").when(~port.isin(*PORTS), "port").when(private, "private_host").otherwise("ok")
    return rows.select("page_id", "url", why.alias("result"))
