"""Ink on page rasters: cells, rows, blocks, and figures fitted to them.

pixels(page_id, x, y, luma), one row per pixel that is drawn; cells of 4 by 4 pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Size of a cell, luma of ink, and parts of a page's width or height
CELL = 4
INK = 236
ROW_INK, MAX_GAP, LEAD_GAP, MAX_BLOCK, MIN_BLOCK, MIN_INK, PAD, CAPTION_SPAN = 0.006, 0.03, 0.055, 0.8, 0.04, 0.003, 0.014, 0.3
BODY_TEXT = 40
CAPTION_BELOW = r"(?i)^\s*(figure|fig\.?|图|圖)\s*\d"
HEADING_ABOVE = r"^\s*\d+(\.\d+)*[\s.、]"


def ink_grid(pixels: DataFrame) -> DataFrame:
    """(page_id, r, c): cells with a dark pixel."""
    return pixels.where(F.col("luma") < INK).select("page_id", F.floor(F.col("y") / CELL).alias("r"), F.floor(F.col("x") / CELL).alias("c")).distinct()


def ink_rows(grid: DataFrame, least: int = 1) -> DataFrame:
    return grid.groupBy("page_id", "r").agg(F.count("*").alias("cells")).where(F.col("cells") >= least)


def ink_blocks(grid: DataFrame, max_gap: int = 2) -> DataFrame:
    """Runs of inked rows with at most max_gap blank rows between, with their ink and rank by it."""
    page = W.partitionBy("page_id").orderBy("r")
    rows = ink_rows(grid).withColumn("new", F.coalesce((F.col("r") - F.lag("r").over(page) - 1 > max_gap).cast("int"), F.lit(1)))
    blocks = rows.withColumn("block", F.sum("new").over(page)).groupBy("page_id", "block").agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.sum("cells").alias("cells"))
    return blocks.select("page_id", "r0", "r1", "cells", F.row_number().over(W.partitionBy("page_id").orderBy(F.desc("cells"), "r0")).cast("long").alias("rank"))


def ink_bounds(grid: DataFrame, ranges: DataFrame) -> DataFrame:
    """Cells, left and right of the ink in each row range (page_id, range_id, r0, r1)."""
    j = ranges.join(grid, "page_id").where("r between r0 and r1")
    return j.groupBy("page_id", "range_id").agg(F.count("*").alias("cells"), F.min("c").alias("c0"), F.max("c").alias("c1"))


def ink_profile(grid: DataFrame, sizes: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """One row a page with its rows from the top: their cells, the cells down to them, ends of their ink, and body text.

    Running sums make the ink of any rows two lookups. They are enough: what a fit weighs is as wide as the page or as the ink.
    sizes: (page_id, w, h) in pixels, and maybe chrome_top and chrome_bottom, between which figures stand; lines: (page_id,
    text, top, bottom). Lines over BODY_TEXT characters are body text, which no figure goes across. Arrays are as long as
    a page is high. A page without ink or without lines has a row too; rows outside the page are left out.
    """
    chrome = lambda c, other: F.coalesce(F.col(c), other) if c in sizes.columns else other
    cells = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / CELL)).cast("int")
    p = sizes.select("page_id", "w", "h", cells("w").alias("gw"), cells("h").alias("gh"), chrome("chrome_top", F.lit(0)).alias("top"), chrome("chrome_bottom", F.col("h")).alias("bottom"))
    share = lambda c, least, part: F.greatest(F.lit(least), half_up(F.col(c) * part))
    p = p.select(
        "page_id", "w", "h", "gw", "gh", row_of(F.col("top")).alias("top"), row_of(F.col("bottom")).alias("bottom"), share("gw", 2, ROW_INK).alias("min_ink"),
        share("gh", 2, MAX_GAP).alias("max_gap"), share("gh", 3, LEAD_GAP).alias("lead_gap"), half_up(F.col("gh") * MAX_BLOCK).alias("max_rows"),
    ).repartition("page_id")
    none, no = F.lit(None).cast("long"), F.lit(False)
    rows = p.select("page_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("gh").cast("long") - 1)).alias("r"), none.alias("c"), no.alias("stop")).union(grid.select("page_id", "r", "c", no))
    if lines is not None:
        long = lines.where(F.length("text") > BODY_TEXT).join(p.select("page_id", "gh"), "page_id")
        top, bottom = row_of(F.col("top")), row_of(F.greatest("top", "bottom"))
        rows = rows.union(long.select("page_id", F.explode(F.sequence(top.cast("long"), bottom.cast("long"))).alias("r"), none.alias("c"), F.lit(True).alias("stop")))
    rows = rows.repartition("page_id").groupBy("page_id", "r").agg(F.count("c").alias("cells"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.bool_or("stop").alias("stop"))
    rows = rows.withColumn("total", F.sum("cells").over(W.partitionBy("page_id").orderBy("r")))
    rows = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("r", "cells", "total", "c0", "c1", "stop"))).alias("rows"))
    return p.join(rows, "page_id").withColumn("rows", F.slice("rows", F.lit(1), F.col("gh")))


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("int")


def row_of(y: Column) -> Column:
    """The row of cells at a height in pixels; heights beyond the page are at its end."""
    return F.greatest(F.lit(0), F.least(F.col("gh") - 1, half_up(y / CELL)))


def at(r: Column) -> Column:
    return F.element_at("rows", r + 1)


def cells_between(r0: Column, r1: Column) -> Column:
    """Cells with ink in the rows r0 to r1, both included."""
    last = F.least(r1, F.col("gh") - 1)
    before = F.when(r0 <= 0, 0).otherwise(at(F.greatest(r0, F.lit(1)) - 1)["total"])
    return F.when((last >= r0) & (last >= 0), at(F.greatest(last, F.lit(0)))["total"] - before).otherwise(0)


def grown(anchor: Column, direction: int, lead: Column) -> Column:
    """The last row of the ink that goes on from an anchor; null where there is none."""
    step = lambda i: anchor + direction * i
    far = F.col("bottom") - anchor if direction > 0 else anchor - F.col("top")
    inside = step(F.lit(1)) >= F.col("top") if direction > 0 else step(F.lit(1)) <= F.col("bottom")
    far = F.least(far, F.col("max_rows") + 1)

    def merge(s: Column, i: Column) -> Column:
        row = at(step(i))
        go, ink = s["open"] & ~row["stop"], row["cells"] >= F.col("min_ink")
        gap = F.when(ink, 0).otherwise(s["gap"] + 1)
        still = ink | (gap <= F.when(s["last"].isNotNull(), F.col("max_gap")).otherwise(lead))
        return F.struct((go & still).alias("open"), gap.alias("gap"), F.when(go & ink, step(i)).otherwise(s["last"]).alias("last"))

    start = F.struct(F.lit(True).alias("open"), F.lit(0).alias("gap"), F.lit(None).cast("int").alias("last"))
    return F.when(inside & (far >= 1), F.aggregate(F.sequence(F.lit(1), far), start, merge, lambda s: s["last"]))


def ink_grow(profile: DataFrame, anchors: DataFrame) -> DataFrame:
    """(page_id, anchor, dir, last): how far ink goes on from an anchor row down (1) or up (-1).

    Growing stops at the page's chrome, at body text, at a blank run longer than lead_gap before the first ink or than max_gap
    after it, and past max_rows. Rows with fewer than min_ink cells are blank. Anchors without such ink, or outside the page, give
    no row. anchors: (page_id, anchor, dir).
    """
    j = anchors.join(profile, "page_id").where((F.col("anchor") >= 0) & (F.col("anchor") < F.col("gh"))).withColumn("from", F.col("anchor").cast("int"))
    last = F.when(F.col("dir") > 0, grown(F.col("from"), 1, F.col("lead_gap"))).otherwise(grown(F.col("from"), -1, F.col("lead_gap")))
    return j.select("page_id", "anchor", "dir", last.cast("long").alias("last")).where("last is not null")


def figure_fit(profile: DataFrame, figures: DataFrame, captions: DataFrame) -> DataFrame:
    """(page_id, fig_no, method, r0, r1, x0, y0, x1, y1): the first candidate that is a figure, its rows and its padded box.

    From the caption to the side its kind tells ("Figure 1" stands under a figure, "7.2 Title" over it, for others the side
    with more ink), then to the other; then the better of the proposed box and its mirror image, trimmed and grown; then the
    page's blocks by ink, where the one that holds the middle of the box counts 1.5 times. A candidate is a figure if its
    height and the share of its ink are within bounds. Figures for which nothing fits give no row.
    figures: (page_id, fig_no, y0, y1), parts of the page's height or null; captions: (page_id, fig_no, text, top, bottom)
    in pixels, one a figure at most, as caption_match finds them.
    """
    figures = figures.select("page_id", "fig_no", F.col("y0").alias("b0"), F.col("y1").alias("b1"))
    caps = captions.select("page_id", "fig_no", F.col("text").alias("cap"), F.col("top").alias("cap_top"), F.col("bottom").alias("cap_bottom"))
    j = figures.join(caps, ["page_id", "fig_no"], "left").join(profile, "page_id")
    has = F.col("cap").isNotNull()
    j = j.withColumns({"q0": F.when(has, row_of(F.col("cap_top"))), "q1": F.when(has, row_of(F.col("cap_bottom"))), "span": half_up(F.col("gh") * CAPTION_SPAN)})
    over = cells_between(F.greatest("top", F.col("q0") - F.col("span")), F.col("q0") - 1)
    under = cells_between(F.col("q1") + 1, F.least("bottom", F.col("q1") + F.col("span")))
    down = F.when(F.col("cap").rlike(CAPTION_BELOW), False).when(F.col("cap").rlike(HEADING_ABOVE), True).otherwise(under > over)
    j = j.withColumns({"down": down, "up_end": grown(F.col("q0"), -1, F.col("lead_gap")), "down_end": grown(F.col("q1"), 1, F.col("lead_gap"))})

    box = F.col("b0").isNotNull() & F.col("b1").isNotNull()
    row = lambda part: F.when(box, row_of(part * F.col("h")))
    j = j.withColumns({"s0": row(F.col("b0")), "s1": row(F.col("b1")), "m0": row(1 - F.col("b1")), "m1": row(1 - F.col("b0"))})
    ratio = lambda a, b: F.when(b >= a, cells_between(a, b) / ((b - a + 1) * F.col("gw"))).otherwise(0.0)
    j = j.withColumns({"own": ratio(F.col("s0"), F.col("s1")), "mirrored": ratio(F.col("m0"), F.col("m1"))})
    turn = F.col("mirrored") > F.col("own")
    seed = lambda a, b: F.when(box, F.when(turn, F.col(b)).otherwise(F.col(a)))
    j = j.withColumns({"g0": seed("s0", "m0"), "g1": seed("s1", "m1"), "seed_method": F.when(turn, "seed_mirror").otherwise("seed_trim"), "seed_ink": F.greatest("own", "mirrored")})
    inked = lambda a, b: F.when(b >= a, F.filter(F.sequence(a, b), lambda r: at(r)["cells"] >= F.col("min_ink")))
    j = j.withColumn("trim", F.when(F.col("seed_ink") >= MIN_INK, inked(F.col("g0"), F.col("g1"))))
    j = j.withColumns({"t0": F.array_min("trim"), "t1": F.array_max("trim"), "half": F.greatest(F.lit(2), half_up(F.col("max_gap") / 2))})
    j = j.withColumns({"t_up": grown(F.col("t0"), -1, F.col("half")), "t_down": grown(F.col("t1"), 1, F.col("half"))})

    j = j.withColumn("inked", F.coalesce(inked(F.col("top"), F.col("bottom")), F.array().cast("array<int>")))
    far = lambda a, b: b - a - 1 > F.col("max_gap")
    first = F.filter("inked", lambda x, i: (i == 0) | far(F.get("inked", i - 1), x))
    last = F.filter("inked", lambda x, i: (i == F.size("inked") - 1) | far(x, F.get("inked", i + 1)))
    j = j.withColumn("blocks", F.arrays_zip(first.alias("r0"), last.alias("r1")))
    mid = (F.col("g0") + F.col("g1")) / 2

    def weighed(b: Column) -> Column:
        n = cells_between(b["r0"], b["r1"])
        return F.struct((-n * F.when((mid >= b["r0"]) & (mid <= b["r1"]), 1.5).otherwise(1.0)).alias("score"), (-n).alias("n"), b["r0"].alias("r0"), b["r1"].alias("r1"))

    j = j.withColumn("blocks", F.array_sort(F.transform("blocks", weighed)))
    a_try = lambda ok, method, a, b: F.when(ok, F.struct(method.alias("method"), a.cast("int").alias("r0"), b.cast("int").alias("r1")))
    up = a_try(F.col("up_end").isNotNull(), F.lit("caption_up"), F.least("up_end", "q0"), F.greatest("q0", "q1"))
    down = a_try(F.col("down_end").isNotNull(), F.lit("caption_down"), F.least("q0", "q1"), F.greatest("down_end", "q1"))
    trimmed = a_try(F.col("t0").isNotNull(), F.col("seed_method"), F.coalesce("t_up", "t0"), F.coalesce("t_down", "t1"))
    blocks = F.transform("blocks", lambda b: F.struct(F.lit("largest_block").alias("method"), b["r0"].alias("r0"), b["r1"].alias("r1")))
    tries = F.concat(F.array(F.when(F.col("down"), down).otherwise(up), F.when(F.col("down"), up).otherwise(down), trimmed), blocks)
    # One row a candidate: a filter on the fit itself would be moved down through every step above and repeat it
    j = j.select("page_id", "fig_no", "w", "h", "gh", "rows", F.posexplode_outer(tries).alias("k", "t")).where("t is not null")
    none = F.expr("named_struct('c0', CAST(NULL AS BIGINT), 'c1', CAST(NULL AS BIGINT))")
    rows = F.slice("rows", F.col("t.r0") + 1, F.col("t.r1") - F.col("t.r0") + 1)
    j = j.select("page_id", "fig_no", "w", "h", "gh", "k", "t.*", cells_between(F.col("t.r0"), F.col("t.r1")).alias("n"), F.aggregate(rows, none, lambda e, x: F.struct(F.least(e["c0"], x["c0"]).alias("c0"), F.greatest(e["c1"], x["c1"]).alias("c1"))).alias("e"))
    high = F.col("r1") - F.col("r0") + 1
    share = F.col("n") / (high * (F.col("e.c1") - F.col("e.c0") + 1))
    j = j.where((high / F.col("gh")).between(MIN_BLOCK, MAX_BLOCK) & (share >= MIN_INK))
    j = j.groupBy("page_id", "fig_no").agg(F.min_by(F.struct("method", "r0", "r1", "e.c0", "e.c1", "w", "h"), "k").alias("fit")).select("page_id", "fig_no", "fit.*")
    edge = lambda cells, size, pad: F.greatest(F.lit(0.0), F.least(F.lit(1.0), cells * CELL / F.col(size) + pad))
    box = [edge(F.col("c0"), "w", -PAD).alias("x0"), edge(F.col("r0"), "h", -PAD).alias("y0"), edge(F.col("c1") + 1, "w", PAD).alias("x1"), edge(F.col("r1") + 1, "h", PAD).alias("y1")]
    return j.select("page_id", "fig_no", "method", F.col("r0").cast("long").alias("r0"), F.col("r1").cast("long").alias("r1"), *box)
