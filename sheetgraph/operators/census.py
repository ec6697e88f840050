"""What a schematic's text shows: reference designators, net labels, and parts beside references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sheetgraph.functions.rx import ascii_boundaries, matches

# Reference prefixes, label and value patterns.
REF_BODY = r"(?:R|C|L|D|Q|U|IC|J|P|CN|SW|F|FB|TP|RV|VR|X|Y|K|OP|PWR)\d+[A-Z]?"
POWER = r"^(?:GND|AGND|DGND|PGND|VGND|VSS|VEE|VCC|VDD|AVDD|DVDD|VBAT|VBUS|VIN|VOUT|VREF|[-+]?[0-9]+(?:\.[0-9]+)?V)$"
PROTOCOL = r"^(?:CS|SS|NSS|SCK|SCLK|MOSI|MISO|SDA|SCL|TX|TXD|RX|RXD|SWDIO|SWCLK|SWO|NRST|TCK|TMS|TDI|TDO|D\+|D-|USB_DP|USB_DM|CC1|CC2|AN|RST|PWM|INT)$"
GENERIC_PIN = r"^(?:IN|OUT|NC|EN|DIS|THR|TRIG|CON|CLK|DIN|DOUT|CAP[+-]?|CH\d+|IO_?VDD)$"
VALUE_UNIT = r"^(?:[-+]?\d+(?:\.\d+)?(?:[kKmM]|[pnuµ]?F|V|R|Ω)?|\d+(?:\.\d+)?[kKmM]|\d+(?:\.\d+)?[pnuµ]?F)$"
ALWAYS = r"^(?:GND|VCC|VDD|VGND|VREF|AGND|DGND|[-+]?[0-9.]+V)$"
MPN_LIKE = r"^[A-Z]{1,6}\d[A-Z0-9\-/]+$"
BRACKETS = ",:;()[]{}"


def tokens(lines: DataFrame) -> DataFrame:
    return lines.select("doc_id", F.explode(F.split(F.trim("text"), r"\s+")).alias("token")).where("token <> ''")


def census_refs(lines: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Distinct references of each document, upper-cased: from anywhere in its lines, and items (doc_id, text) that are one."""
    scan = F.regexp_extract_all("text", F.lit("(?i)(" + ascii_boundaries(rf"\b{REF_BODY}\b") + ")"), 1)
    found = lines.select("doc_id", F.explode(scan).alias("r"))
    if items is not None:
        found = found.union(items.where(matches(F.trim("text"), f"^{REF_BODY}$", True)).select("doc_id", F.trim("text")))
    return found.select("doc_id", F.upper("r").alias("ref")).distinct()


def census_prefix_counts(refs: DataFrame) -> DataFrame:
    return refs.groupBy("doc_id", F.regexp_extract("ref", r"^([A-Z]+)\d", 1).alias("prefix")).agg(F.count("*").alias("n"))


def census_labels(lines: DataFrame) -> DataFrame:
    """Power and protocol labels of each document and how often its lines have them."""
    bare = tokens(lines).select("doc_id", F.translate("token", BRACKETS, "").alias("t"))
    hit = bare.where(matches(F.col("t"), POWER, True) | matches(F.col("t"), PROTOCOL, True))
    return hit.groupBy("doc_id", F.upper("t").alias("label")).agg(F.count("*").alias("n"))


def census_gate_labels(labels: DataFrame) -> DataFrame:
    """Labels seen twice, or always kept."""
    return labels.where((F.col("n") >= 2) | matches(F.col("label"), ALWAYS)).select("doc_id", "label")


def is_part(text: Column) -> Column:
    """Whether a token looks like a part number."""
    none = [matches(text, f"^{REF_BODY}$", True), matches(text, POWER, True), matches(text, PROTOCOL, True), matches(text, GENERIC_PIN, True), matches(text, VALUE_UNIT)]
    out = matches(text, "[A-Za-z]") & matches(text, r"\d") & F.length(text).between(4, 40)
    for n in none:
        out = out & ~n
    return out


def part_token_filter(lines: DataFrame) -> DataFrame:
    t = tokens(lines).where(is_part(F.col("token")))
    return t.groupBy("doc_id", "token").agg(F.count("*").alias("n"))


def part_hints(items: DataFrame) -> DataFrame:
    """The nearest part token of each reference: within 70 across and 95 up or down, by a score under 58.

    items(design_id, page, item_no, text, x, y, w). References and parts meet in cells of 70
    across and 95 down, a part in the nine around it, so a crowded page compares neighbours only.
    """
    mid = F.col("x") + F.col("w") / 2
    refs = items.where(matches(F.col("text"), f"^{REF_BODY}$", True)).select("design_id", "page", F.upper("text").alias("ref"), mid.alias("rx"), F.col("y").alias("ry"))
    parts = items.where(is_part(F.col("text"))).select("design_id", "page", "item_no", "text", mid.alias("px"), F.col("y").alias("py"))
    cells = lambda x, y: (F.floor(F.col(x) / 70), F.floor(F.col(y) / 95))
    across, down = cells("px", "py")
    around = F.array(*(F.struct((across + i).alias("cx"), (down + k).alias("cy")) for i in (-1, 0, 1) for k in (-1, 0, 1)))
    parts = parts.select("*", F.inline(around))
    cx, cy = cells("rx", "ry")
    near = refs.select("*", cx.alias("cx"), cy.alias("cy")).join(parts, ["design_id", "page", "cx", "cy"])
    dx, dy = F.abs(F.col("px") - F.col("rx")), F.col("py") - F.col("ry")
    score = dx * 1.2 + F.abs(dy) * 0.55 - F.when(dy < 0, 7).otherwise(0) - F.when(matches(F.col("text"), MPN_LIKE, True), 4).otherwise(0)
    near = near.where((dx <= 70) & (F.abs(dy) <= 95)).withColumn("score", score)
    best = near.groupBy("design_id", "page", "ref", "rx", "ry").agg(F.min_by(F.struct("text", "score"), F.struct("score", "item_no")).alias("b")).where("b.score < 58")
    conf = F.greatest(F.lit(0.55), F.least(F.lit(0.95), 0.95 - F.col("b.score") / 140))
    best = best.select("design_id", "page", "ref", F.col("b.text").alias("value"), conf.alias("confidence"))
    return best.groupBy("design_id", "ref").agg(F.max_by("value", F.struct("confidence", -F.col("page"))).alias("value"), F.max("confidence").alias("confidence"))


def census_summary(lines: DataFrame, refs: DataFrame, labels: DataFrame) -> DataFrame:
    base = lines.groupBy("doc_id").agg(F.max("page").alias("pages"), F.sum(F.length(F.trim("text"))).alias("chars"))
    r, x = (df.groupBy("doc_id").agg(F.count("*").alias(n)) for df, n in ((refs, "refs"), (labels, "labels")))
    out = base.join(r, "doc_id", "left").join(x, "doc_id", "left").na.fill(0)
    return out.withColumn("available", (F.col("refs") > 0) | (F.col("labels") > 0))


def top_hints(refs: DataFrame, most: int = 220) -> DataFrame:
    """The references a design sends along with a request, in order, at most so many."""
    k = F.row_number().over(W.partitionBy("doc_id").orderBy("ref"))
    return refs.withColumn("_k", k).where(F.col("_k") <= most).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("ref")), ", ").alias("hint"))
