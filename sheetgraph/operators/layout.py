"""Text layout: items to lines, pin tables, figures and pages.

items(doc_id, page, item_no, str, x, y, w, h), lines(doc_id, page, line_no, text, y, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sheetgraph.functions.rx import ascii_boundaries, first_of, matches

# Patterns of pin tables, captions and pages.
NAME = r"[A-Za-z][\w+#/.\-]{0,15}"
LOC = r"(?:\d{1,3}|[A-J]\d{1,2})"
TYPE = r"(I/O|IO|I|O|P|PWR|G|GND|NC|[-—–])"
ROW_TWO = rf"^({NAME})\s+({LOC})\s+({LOC})\s+{TYPE}\s*(.*)$"
ROW_NAME_FIRST = rf"^({NAME})\s+(\d{{1,3}})\s+{TYPE}\s*(.*)$"
ROW_NUMBER_FIRST = rf"^(\d{{1,3}})\s+({NAME})\s+{TYPE}\s*(.*)$"
EP_LINE = rf"^({NAME})?\s*(?:Thermal\s+)?[Pp]ad\b.*|^EP\b.*"
STOP = r"^\d+(\.\d+)*\s+(Specifications|Detailed Description|Application|Parameter Measurement|Absolute Maximum)"
HEAD = r"^(\d+(\.\d+)*\s+)?Pin (Configuration and )?Functions?\b"
COLUMNS = r"NAME\s+(.+?)\s{2,}(.+?)\s{2,}(?:I/O|TYPE)"
TYPE_NAMES = [("input", "^I$"), ("output", "^O$"), ("bidirectional", "^(I/O|IO)$"), ("power_in", "^(P|PWR|G|GND)$"), ("no_connect", "^NC$"), ("passive", "^[-—–]$")]
POWER_PIN = r"^(GND|VSS|VCC|VDD|V\+)"
FIGURE = r"^(?:Figure|图)\s*(\d+(?:[-.]\d+)*)\s*[.:、]?\s*(.*)$"
FIGURE_KINDS = [
    ("block_diagram", r"(?i)(functional|internal|simplified)?\s*block\s+diagram|功能框图|内部框图|方框图|结构框图"),
    ("application", r"(?i)(typical\s+application|application\s+(circuit|schematic|diagram)|simplified\s+(schematic|application))|典型应用|应用电路|应用示例|简化原理图"),
    ("pin_configuration", r"(?i)top\s+view|pin\s+(configuration|connections?|assignment)\s*(diagram)?\b|引脚配置|引脚排列|管脚排列|顶视图|俯视图"),
    ("package_outline", r"(?i)package\s+(outline|drawing|dimensions)|mechanical\s+drawing|land\s+pattern\s+example|封装外形|封装图|机械图|推荐焊盘"),
]
CURVE = r"(?i)\b(curve|curves|waveform|response|characteristic|performance|graph|plot|vs\.?|versus)\b|曲线|波形|特性|性能"
POINTER = r"(?i)\b(see|shown|refer)\b"
BARE_APPLICATION = r"(?i)simplified\s+schematic|典型应用|应用电路|应用示例"
PIN_PAGE = r"(?i)Pin (Configuration and )?Functions?"
MECHANICAL_PAGE = r"(?i)(PACKAGE OUTLINE|MECHANICAL DATA|PACKAGE OPTION ADDENDUM|LAND PATTERN|PLASTIC QUAD|SMALL OUTLINE|Package Information|Mechanical, Packaging)"
CATEGORY = r"(?i)(multiplexer|switch|amplifier|regulator|converter|controller|driver|sensor|transceiver|comparator|MOSFET|microcontroller|translator|monitor)"
VENDORS = (
    r"(?i)(Texas Instruments|Analog Devices|STMicroelectronics|NXP|Infineon|onsemi|ON Semiconductor|Microchip|Renesas|Toshiba|ROHM|"
    r"Diodes Incorporated|Nexperia|Vishay|Silicon Labs|Skyworks|Qorvo|TDK|Murata)"
)
PART_LINE = r"^[A-Z]{2,}[A-Z0-9\-]{3,}(\s*,\s*[A-Z0-9\-]+)*$"

# Signs that stand for nothing when titles and lines are compared
NO_WORD = r"""[\s.。．,，、:：;；()（）\[\]【】"'“”‘’\-–—_/\\|]+"""
HALF_WIDTH = "".join(map(chr, range(0x21, 0x7F)))
FULL_WIDTH = "".join(chr(ord(c) - 0x21 + 0xFF01) for c in HALF_WIDTH)


def load_items(items: DataFrame, max_pages: int = 80) -> DataFrame:
    """Items with text on the first pages, with their right edge and a height."""
    kept = items.where((F.col("page") <= max_pages) & (F.trim("str") != ""))
    return kept.select("doc_id", "page", "item_no", "str", "x", "y", (F.col("x") + F.col("w")).alias("x1"), F.coalesce(F.expr("nullif(abs(h), 0)"), F.lit(8.0)).alias("h"))


def normalize_parser(raw: DataFrame) -> DataFrame:
    """Another parser's items: page at least 1 and whole, blanks instead of nulls."""
    page = F.greatest(F.lit(1), F.floor(F.coalesce("page", F.lit(1.0)) + 0.5)).cast("long")
    return raw.select("doc_id", page.alias("page"), F.coalesce("str", F.lit("")).alias("str"), F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))


def assemble_lines(items: DataFrame) -> DataFrame:
    """Items to lines of a page.

    Items are taken from top to bottom, then left to right. An item joins the last line if it lies within
    max(2.5, h / 2) of that line's first item; a gap over 0.6 h inside a line becomes two blanks, else one.
    """
    item = F.struct((-F.col("y")).alias("down"), "x", "item_no", "str", "y", "x1", "h")
    pages = items.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(item)).alias("items"))
    line = "struct<text:string,x:double,y:double,x1:double,h:double>"
    start = F.struct(F.array().cast(f"array<{line}>").alias("done"), F.lit(None).cast(line).alias("open"))

    def add(acc: Column, it: Column) -> Column:
        old = acc["open"]
        new = F.struct(it["str"].alias("text"), it["x"].alias("x"), it["y"].alias("y"), it["x1"].alias("x1"), it["h"].alias("h"))
        same = old.isNotNull() & (F.abs(old["y"] - it["y"]) < F.greatest(F.lit(2.5), it["h"] * 0.5))
        glue = F.when(it["x"] - old["x1"] > it["h"] * 0.6, "  ").otherwise(" ")
        grown = F.struct(F.concat(old["text"], glue, it["str"]).alias("text"), old["x"].alias("x"), old["y"].alias("y"), F.greatest(old["x1"], it["x1"]).alias("x1"), F.greatest(old["h"], it["h"]).alias("h"))
        closed = F.when(same | old.isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(old)))
        return F.struct(closed.alias("done"), F.when(same, grown).otherwise(new).alias("open"))

    lines = F.aggregate("items", start, add, lambda a: F.concat(a["done"], F.array(a["open"])))
    folded = pages.select("doc_id", "page", F.posexplode(lines).alias("line_no", "l"))
    return folded.select("doc_id", "page", "line_no", clean_line_text(F.col("l.text")).alias("text"), "l.x", "l.y", "l.x1", "l.h")


def clean_line_text(text: Column) -> Column:
    """Three and more blanks become two; ends trimmed."""
    return F.trim(F.regexp_replace(text, r"\s{3,}", "  "))


def sparse_pages(lines: DataFrame, least: int = 20) -> DataFrame:
    """Whether a document has so few lines that it needs recognition."""
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines")).withColumn("needs_ocr", F.col("n_lines") <= least)


def ocr_merge(lines: DataFrame, recognized: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, page, n_lines, status, must_keep): lines per page after recognised ones are appended; a page is never lost.

    wanted: (doc_id, page) that should be recognised, with `failed` where it was tried in vain. Pages still to be
    recognised must be kept by any later choice of pages.
    """
    own = lines.groupBy("doc_id", "page").agg(F.count("*").alias("own"))
    more = recognized.groupBy("doc_id", "page").agg(F.count("*").alias("more"))
    failed = F.col("failed") if "failed" in wanted.columns else F.lit(False)
    want = wanted.groupBy("doc_id", "page").agg(F.bool_or(failed).alias("failed"))
    out = own.join(more, ["doc_id", "page"], "full").join(want, ["doc_id", "page"], "full").na.fill(0, ["own", "more"])
    status = F.when(F.col("failed").isNull(), "not_needed").when(F.col("more") > 0, "done").when(F.col("failed"), "failed").otherwise("pending_no_worker")
    return out.select("doc_id", "page", (F.col("own") + F.col("more")).alias("n_lines"), status.alias("status"), status.isin("failed", "pending_no_worker").alias("must_keep"))


def part_info(lines: DataFrame, links: DataFrame, height: float = 792.0) -> DataFrame:
    """(doc_id, mpn, title, manufacturer): the part number from the link's file name, else from an upper-case token line;
    the title from a line with a category word, both in the top of page 1; the first vendor named on page 1.

    links: (doc_id, url).
    """
    first_page = lines.where(F.col("page") == 1)
    on_top = F.col("y") > height * 0.55
    part = F.when(on_top & matches(F.col("text"), PART_LINE), F.regexp_extract("text", r"^[^\s,]+", 0))
    title = F.when(on_top & (F.length("text") > 25) & (F.length("text") < 160) & matches(F.col("text"), CATEGORY), F.col("text"))
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("line_no")))
    page = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " ")
    found = first_page.groupBy("doc_id").agg(first(part).alias("part"), first(title).alias("title"), F.regexp_extract(page, VENDORS, 1).alias("manufacturer"))
    named = links.groupBy("doc_id").agg(F.upper(F.max(F.regexp_extract("url", r"(?i)([A-Za-z][A-Za-z0-9\-]{4,})\.pdf", 1))).alias("named"))
    out = found.join(named, "doc_id", "left")
    none = F.lit("")
    return out.select("doc_id", F.coalesce(F.nullif(F.col("named"), none), "part", none).alias("mpn"), F.coalesce("title", none).alias("title"), "manufacturer")


def is_column_head(text: Column) -> Column:
    return matches(text, r"\bPIN\b|\bNAME\b") & matches(text, r"(?i)I/O|TYPE")


def pin_region(lines: DataFrame) -> DataFrame:
    """Lines inside a pin table, with what they are: `head` (column heads) or `row`. The state goes on over pages."""
    text = F.col("text")
    head = matches(text, HEAD, True) | (matches(text, r"\bPIN\b") & matches(text, r"(?i)\b(DESCRIPTION|FUNCTION)\b"))
    stop = matches(text, STOP, True)
    event = F.when(stop, 0).when(head, 1)
    before = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    inside = lines.withColumn("on", F.last(event, ignorenulls=True).over(before)).withColumn("stop", stop)
    inside = inside.where("on = 1 and not stop")
    return inside.select("doc_id", "page", "line_no", "text", F.when(is_column_head(text), "head").otherwise("row").alias("part"))


def pin_type(token: Column, name: Column) -> Column:
    """Pin type of a table's token; supply names are power_in whatever the token."""
    return F.when(matches(name, POWER_PIN, True), "power_in").otherwise(first_of(F.upper(token), TYPE_NAMES, F.lit("unspecified")))


def pin_rows(region: DataFrame) -> DataFrame:
    """Pins of the table rows: (doc_id, line_no, set, number, name, type, description). Two-location rows give sets A and B."""
    two, one, num = (lambda k, p=p: F.regexp_extract("text", p, k) for p in (ROW_TWO, ROW_NAME_FIRST, ROW_NUMBER_FIRST))
    rows = region.where("part = 'row'")
    pin = lambda s, number, name, token, text: F.struct(F.lit(s).alias("set"), number.alias("number"), name.alias("name"), token.alias("token"), F.substring(F.trim(text), 1, 160).alias("description"))
    found = (
        F.when(matches(F.col("text"), ROW_TWO), F.array(pin("A", two(2), two(1), two(4), two(5)), pin("B", two(3), two(1), two(4), two(5))))
        .when(matches(F.col("text"), ROW_NAME_FIRST), F.array(pin("A", one(2), one(1), one(3), one(4))))
        .when(matches(F.col("text"), ROW_NUMBER_FIRST), F.array(pin("A", num(1), num(2), num(3), num(4))))
    )
    out = rows.select("doc_id", "line_no", F.explode(found).alias("p")).select("doc_id", "line_no", "p.*")
    return out.select("doc_id", "line_no", "set", "number", "name", pin_type(F.col("token"), F.col("name")).alias("type"), "description")


def pin_column_labels(region: DataFrame) -> DataFrame:
    """Labels of the two number columns from the last column heads of a document."""
    label = lambda k: F.trim(F.regexp_extract("text", "(?i)" + COLUMNS, k))
    heads = region.where((F.col("part") == "head") & matches(F.col("text"), COLUMNS, True))
    return heads.groupBy("doc_id").agg(F.max_by(label(1), "line_no").alias("label_a"), F.max_by(label(2), "line_no").alias("label_b"))


def pin_first_wins(rows: DataFrame) -> DataFrame:
    """The first row of each number of a set."""
    k = F.row_number().over(W.partitionBy("doc_id", "set", "number").orderBy("line_no"))
    return rows.withColumn("_k", k).where("_k = 1").drop("_k")


def pin_ep_rows(region: DataFrame, pins: DataFrame) -> DataFrame:
    """Thermal-pad lines that come once four pins are known: pin max + 1, + 2, ... named EP.

    A pad line counts itself in the next one's maximum, so the k-th pad line adds to the pins before it and to the pads.
    """
    taken = ~matches(F.col("text"), ROW_TWO) & ~matches(F.col("text"), ROW_NAME_FIRST) & ~matches(F.col("text"), ROW_NUMBER_FIRST)
    pads = region.where((F.col("part") == "row") & taken & matches(F.col("text"), EP_LINE)).select("doc_id", "line_no", F.lit(None).cast("int").alias("no"))
    known = pins.where("set = 'A'").select("doc_id", "line_no", F.expr("try_cast(number as int)").alias("no"), F.lit(1).alias("pin"))
    rows = known.unionByName(pads.withColumn("pin", F.lit(0)))
    event = F.struct("line_no", "no", "pin")

    def step(acc: Column, e: Column) -> Column:
        pad = (e["pin"] == 0) & (acc["size"] >= 4)
        top = F.when(pad, acc["top"] + 1).otherwise(F.greatest(acc["top"], F.coalesce(e["no"], F.lit(0))))
        made = F.when(pad, F.concat(acc["made"], F.array(F.struct(e["line_no"].alias("line_no"), (acc["top"] + 1).alias("number"))))).otherwise(acc["made"])
        size = acc["size"] + F.when(pad | (e["pin"] == 1), 1).otherwise(0)
        return F.struct(size.alias("size"), top.alias("top"), made.alias("made"))

    start = F.struct(F.lit(0).alias("size"), F.lit(0).alias("top"), F.array().cast("array<struct<line_no:bigint,number:int>>").alias("made"))
    docs = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(event)).alias("events"))
    folded = docs.select("doc_id", F.explode(F.aggregate("events", start, step)["made"]).alias("m"))
    return folded.select("doc_id", "m.line_no", F.col("m.number").cast("string").alias("number"), F.lit("EP").alias("name"), F.lit("passive").alias("type"))


def pin_confidence(pins: DataFrame) -> DataFrame:
    """high if a set has at least 4 pins numbered from 1 to at least 6 with 80 % of the numbers, else low."""
    no = F.expr("try_cast(number as int)")
    out = pins.groupBy("doc_id", "set").agg(F.count("*").alias("n"), F.count(no).alias("numbered"), F.max(no).alias("top"), F.min(no).alias("low"))
    coverage = F.when(F.col("top") > 0, F.col("numbered") / F.col("top")).otherwise(0.0)
    good = (F.col("n") >= 4) & (F.col("top") >= 6) & (coverage >= 0.8) & (F.col("low") == 1)
    return out.select("doc_id", "set", "n", coverage.alias("coverage"), F.when(good, "high").otherwise("low").alias("confidence"))


def pin_order(pins: DataFrame) -> DataFrame:
    """Position of each pin: numbers by value, then other names by letters and number."""
    no = F.expr("try_cast(number as int)")
    letters, tail = F.regexp_extract("number", r"^(\D*)", 1), F.expr(r"try_cast(regexp_extract(number, '^\\D*(\\d+)', 1) as int)")
    k = F.row_number().over(W.partitionBy("doc_id", "set").orderBy(no.isNull(), no, letters, tail, "number"))
    return pins.select("doc_id", "set", "number", k.cast("long").alias("place"))


def assign_pinsets(packages: DataFrame, labels: DataFrame) -> DataFrame:
    """Package to the first set with a label token among the package's tokens, else the first set (number 0).

    labels: (set_no, label); small, one row per set.
    """
    tokens = labels.select("set_no", F.explode(F.split(F.upper("label"), r"[\s,/]+")).alias("token")).where("token <> ''")
    own = packages.select("package_id", F.explode(F.split(F.upper("type"), "[^A-Z0-9]+")).alias("token")).where("token <> ''")
    hit = own.join(tokens, "token").groupBy("package_id").agg(F.min("set_no").alias("set_no"))
    return packages.select("package_id").join(hit, "package_id", "left").na.fill(0, ["set_no"])


def figure_candidates(lines: DataFrame) -> DataFrame:
    """Captions and bare headings of figures with their kind. Captions of curves are none; bare headings are few kinds."""
    text = F.col("text")
    caption = matches(text, FIGURE, True)
    title = F.trim(F.when(caption, F.regexp_extract(text, "(?i)" + FIGURE, 2)).otherwise(text))

    def kind(title: Column) -> Column:
        """Bound once, so the patterns of the kinds stand in the plan once."""
        bare = (F.length(text) < 60) & ~matches(text, POINTER)
        usable = lambda k: F.when(caption, ~matches(title, CURVE)).otherwise(bare & (k != "pin_configuration") & ((k != "application") | matches(text, BARE_APPLICATION)))
        return F.filter(F.array(first_of(title, FIGURE_KINDS)), usable)

    out = lines.select("doc_id", "page", "line_no", "y", "text").withColumn("title", title)
    out = out.select("doc_id", "page", "line_no", "y", "title", caption.alias("caption"), F.explode_outer(kind(F.col("title"))).alias("kind"))
    return out.where("kind is not null")


def figure_region(lines: DataFrame, height: float = 792.0, h: float = 9.0) -> DataFrame:
    """Top and bottom (from the page's top, 0 to 1) of the figure of each caption and bare heading.

    A caption's figure is above it, up to the nearest substantial line within half a page, else 45 % of a page up. A bare
    heading in the lower part of a page is taken like a caption; one in the upper part has its figure below, down to the
    next substantial line within half a page. Captions end the figure of a caption, but not of a heading.
    """
    text, y = F.col("text"), F.col("y")
    long = (F.length(text) > 60) | matches(text, r"^\d+(\.\d+)*\s+[A-Z]")
    page = W.partitionBy("doc_id", "page").orderBy("line_no")
    before, after = page.rowsBetween(W.unboundedPreceding, -1), page.rowsBetween(1, W.unboundedFollowing)
    near = lambda cond: F.last(F.when(cond, y), ignorenulls=True).over(before)
    marked = lines.select("*", near(long | matches(text, r"^Figure\s+\d+", True)).alias("above"), near(long).alias("above_long"), F.first(F.when(long, y), ignorenulls=True).over(after).alias("below_long"))
    found = figure_candidates(lines).select("doc_id", "line_no", "caption").join(marked, ["doc_id", "line_no"])
    half, up, down = height * 0.5, F.least(F.lit(height * 0.94), y + height * 0.45), F.greatest(F.lit(height * 0.06), y - height * 0.45)
    caption, low = F.col("caption"), y < height * 0.55
    top = F.when(caption, F.when(F.col("above") - y <= half, F.col("above") - h * 1.2).otherwise(up)).when(low, F.when(F.col("above_long") - y <= half, F.least(up, F.col("above_long") - h * 1.2)).otherwise(up)).otherwise(y - h * 0.4)
    bottom = F.when(caption | low, y - h * 1.6).otherwise(F.when(y - F.col("below_long") <= half, F.col("below_long") + h * 0.6).otherwise(down))
    return found.select("doc_id", "page", "line_no", (1 - top / height).alias("y0"), F.least(F.lit(0.98), 1 - bottom / height).alias("y1"))


def figure_finalize(figures: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """Padded and clamped regions; small ones and those too near a kept one of their page and kind go; at most so many a kind."""
    caps = caps or {"block_diagram": 1, "pin_configuration": 8, "package_outline": 2, "application": 3}
    edge = lambda c: F.least(F.lit(0.995), F.greatest(F.lit(0.005), F.round(c, 4)))
    padded = figures.select("doc_id", "page", "kind", "line_no", edge(F.col("y0") - 0.02).alias("y0"), edge(F.col("y1") + 0.02).alias("y1")).where("y1 - y0 >= 0.04")
    rows = padded.groupBy("doc_id", "page", "kind").agg(F.array_sort(F.collect_list(F.struct("line_no", "y0", "y1"))).alias("f"))
    near = lambda acc, x: F.exists(acc, lambda k: F.abs(k["y0"] - x["y0"]) < 0.05)
    kept = F.aggregate("f", F.array().cast("array<struct<line_no:bigint,y0:double,y1:double>>"), lambda acc, x: F.when(near(acc, x), acc).otherwise(F.concat(acc, F.array(x))))
    out = rows.select("doc_id", "page", "kind", F.explode(kept).alias("k")).select("doc_id", "page", "kind", "k.*")
    most = F.element_at(F.create_map(*[F.lit(x) for kv in caps.items() for x in kv]), F.col("kind"))
    place = F.row_number().over(W.partitionBy("doc_id", "kind").orderBy("page", "line_no"))
    return out.withColumn("_k", place).where(F.col("_k") <= most).drop("_k")


def figure_sanitize(figures: DataFrame, most: int = 12) -> DataFrame:
    """Boxes clamped to 0..1, inverted axes swapped, degenerate ones widened by 0.05; the first figures of a document."""
    clip = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    f = figures.select("doc_id", "fig_no", "kind", *(clip(F.col(c)).alias(c) for c in ("x0", "y0", "x1", "y1")))
    f = f.select("doc_id", "fig_no", "kind", F.least("x0", "x1").alias("x0"), F.least("y0", "y1").alias("y0"), F.greatest("x0", "x1").alias("x1"), F.greatest("y0", "y1").alias("y1"))
    widen = lambda a, b: F.when(F.col(b) - F.col(a) < 0.01, F.least(F.lit(1.0), F.col(a) + 0.05)).otherwise(F.col(b)).alias(b)
    k = F.row_number().over(W.partitionBy("doc_id").orderBy("fig_no"))
    return f.withColumn("_k", k).where(F.col("_k") <= most).select("doc_id", "fig_no", F.coalesce("kind", F.lit("other")).alias("kind"), "x0", "y0", widen("x0", "x1"), widen("y0", "y1"))


def relevant_pages(lines: DataFrame, figures: DataFrame) -> DataFrame:
    """Page 1, pages of pin tables and of mechanical data, and pages of figures."""
    text = F.col("text")
    pin = matches(text, PIN_PAGE) | (matches(text, r"\bPIN\b") & matches(text, r"(?i)\bDESCRIPTION\b"))
    pages = lines.groupBy("doc_id", "page").agg(F.bool_or(pin | matches(text, MECHANICAL_PAGE)).alias("hit")).where("hit or page = 1").select("doc_id", "page")
    return pages.union(figures.select("doc_id", "page")).distinct()


# What a page that is worth sending on says, if no page was found relevant.
KEY_PAGE = r"(?i)pin (configuration|functions)|package (outline|option|information)|mechanical|land pattern|dimension|引脚|封装|机械"


def page_strategy(lines: DataFrame, relevant: DataFrame, ocr: DataFrame | None = None, most: float = 0.7, keyed: int = 20, tail: int = 8) -> DataFrame:
    """(doc_id, page, strategy, sliced): the pages to send on, and why these.

    The relevant ones; if there are none, page 1 and those that a keyword is on (the first `keyed` of them), else page 1 and the
    last `tail` pages with text. Pages to be recognised count as pages without text; of these the ones that must be kept go
    with any choice. Where nothing is chosen, or `most` of all pages or more, the document goes whole (sliced is false).
    ocr: (doc_id, page, must_keep) of pages to be recognised.
    """
    pages = lines.groupBy("doc_id", "page").agg(F.bool_or(F.trim("text") != "").alias("written"), F.bool_or(matches(F.col("text"), KEY_PAGE)).alias("key"))
    pages = pages.join(relevant.select("doc_id", "page", F.lit(True).alias("rel")).distinct(), ["doc_id", "page"], "left")
    if ocr is None:
        pages = pages.select("*", F.lit(None).cast("boolean").alias("keep"))
    else:
        pages = pages.join(ocr.groupBy("doc_id", "page").agg(F.bool_or("must_keep").alias("keep")), ["doc_id", "page"], "full").na.fill(False, ["written", "key"])
    text = F.col("written") & F.col("keep").isNull()
    pages = pages.select("doc_id", "page", F.col("rel").isNotNull().alias("rel"), text.alias("text"), (text & F.col("key")).alias("key"), F.col("keep").isNotNull().alias("ocr"), F.coalesce("keep", F.lit(False)).alias("keep"))
    doc = W.partitionBy("doc_id")
    n = lambda c, over=doc: F.count_if(c).over(over)
    first_keyed, back = (F.col("page") == 1) | F.col("key"), doc.orderBy(F.desc("page"))
    strategy = F.when(n(F.col("rel")) > 0, "parser_relevant_pages").when(n(F.col("key")) > 0, "keyword_pages").when(n(F.col("text")) > 0, "first_plus_text_tail").when(n(F.col("ocr")) > 0, "scanned_no_ocr_worker").otherwise("none")
    pages = pages.select("*", strategy.alias("strategy"), n(first_keyed, doc.orderBy("page")).alias("k"), n(F.col("text"), back).alias("t"))
    picked = (
        F.when(F.col("strategy") == "parser_relevant_pages", F.col("rel")).when(F.col("strategy") == "keyword_pages", first_keyed & (F.col("k") <= keyed))
        .when(F.col("strategy") == "first_plus_text_tail", (F.col("page") == 1) | (F.col("text") & (F.col("t") <= tail))).otherwise(False)
    )
    pages = pages.withColumn("picked", picked)
    some = n(F.col("picked")) > 0
    pages = pages.select("*", (F.col("picked") | (F.col("keep") & some)).alias("sent"), F.when(some & (n(F.col("keep")) > 0), "+ocr_must_keep").otherwise("").alias("more"))
    pages = pages.select("*", n(F.col("sent")).alias("n_sent"), F.count("*").over(doc).alias("n"))
    sliced = (F.col("n_sent") > 0) & (F.col("n_sent") < F.col("n") * most)
    return pages.where(~sliced | F.col("sent")).select("doc_id", "page", F.concat("strategy", "more").alias("strategy"), sliced.alias("sliced"))


def remap_pages(figures: DataFrame, mapping: DataFrame) -> DataFrame:
    """Figures of a sliced document back on their original pages; unmapped ones go. mapping: (doc_id, sliced, original)."""
    m = mapping.select(F.col("doc_id").alias("d"), F.col("sliced").alias("s"), "original")
    return figures.join(m, (F.col("doc_id") == F.col("d")) & (F.col("page") == F.col("s"))).select("doc_id", "line_no", F.col("original").alias("page"))


def plain(text: Column) -> Column:
    """Lower-cased, full-width forms as their plain ones, without blanks and punctuation."""
    return F.regexp_replace(F.lower(F.translate(F.coalesce(text, F.lit("")), FULL_WIDTH, HALF_WIDTH)), NO_WORD, "")


def bigrams(text: Column) -> Column:
    """Pairs of neighbouring characters, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(..))"), 1))


def bits(grams: Column, half: int) -> Column:
    """A set as 64 bits, of those of its members whose hashes fall into this half."""
    mine = F.filter(F.transform(grams, lambda g: F.xxhash64(g)), lambda h: F.pmod(h, F.lit(2)) == half)
    return F.aggregate(mine, F.lit(0).cast("long"), lambda b, h: b.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(h, 1), F.lit(64)).cast("int"))))


def caption_match(titles: DataFrame, lines: DataFrame, least: float = 0.58) -> DataFrame:
    """For each title the most similar line of its page, the first of equals: equal 1, contained 0.92, else Dice's share of bigrams.

    A similarity join with filters that lose nothing: sizes that can't reach the least score don't meet, and the bits of a set of
    bigrams bound what two sets share, as each bit that only one has is a bigram that only it has. What passes is compared. Pairs
    stay on one page; keys for each bigram instead take twice the time, as they are more than the pairs of a page.
    Texts under three characters match nothing, those under four are inside no other.
    """
    page = ["doc_id", "page"]

    def keyed(df: DataFrame, own: str, s: str, p: str) -> DataFrame:
        df = df.where(F.length(s) >= 3).withColumn(p + "g", bigrams(F.col(s)))
        return df.select(*page, own, s, p + "g", F.size(p + "g").alias(p + "n"), bits(F.col(p + "g"), 0).alias(p + "0"), bits(F.col(p + "g"), 1).alias(p + "1"))

    t = keyed(titles.select(*page, "title", plain(F.col("title")).alias("a")).distinct(), "title", "a", "t")
    x = keyed(lines.join(titles.select(*page).distinct(), page, "left_semi").select(*page, "line_no", plain(F.col("text")).alias("b")), "line_no", "b", "x")
    n = F.col("tn") + F.col("xn")
    alone = F.expr("bit_count(t0 & ~x0) + bit_count(t1 & ~x1)"), F.expr("bit_count(x0 & ~t0) + bit_count(x1 & ~t1)")
    near = 2.0 * F.least(F.col("tn") - alone[0], F.col("xn") - alone[1]) >= least * n
    inside = (F.length("a") >= 4) & (F.length("b") >= 4) & (((alone[0] == 0) & F.contains("b", "a")) | ((alone[1] == 0) & F.contains("a", "b")))
    score = F.when(F.col("a") == F.col("b"), 1.0).when(inside, 0.92).otherwise(2.0 * F.size(F.array_intersect("tg", "xg")) / n)
    j = t.join(x, page).where(near | inside).select(*page, "title", "line_no", score.alias("score")).where(F.col("score") >= least)
    return j.groupBy(*page, "title").agg(F.max("score").alias("score"), F.max_by("line_no", F.struct("score", -F.col("line_no"))).alias("line_no"))


def page_chrome(lines: DataFrame, height: float = 792.0) -> DataFrame:
    """Lowest header line in the top 8 % and highest footer line in the bottom 8 % of each page."""
    y = F.col("y")
    return lines.groupBy("doc_id", "page").agg(F.min(F.when(y > height * 0.92, y)).alias("header_y"), F.max(F.when(y < height * 0.08, y)).alias("footer_y"))
