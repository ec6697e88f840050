"""Order-dependent steps, bounded by a page or a design."""

from __future__ import annotations

from collections.abc import Callable
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sheetgraph.functions.rx import matches
from sheetgraph.operators.layout import clean_line_text

# Which titles a kind of figure may have, and which none may.
ALLOWED = {
    "block_diagram": r"(?i)\bblock\s+diagram\b|功能框图|内部框图|方框图|结构框图|框图",
    "application": r"(?i)\b(typical\s+application|application\s+(circuit|schematic|diagram)|simplified\s+schematic)\b|典型应用|应用电路|应用示例",
    "pin_configuration": r"(?i)top\s+view|pin\s+(configuration|connections?|assignment)|引脚配置|引脚排列|管脚排列|顶视图|俯视图",
    "package_outline": r"(?i)package\s+(outline|drawing|information|dimensions)|mechanical\s+(data|drawing)|land\s+pattern|封装信息|封装图|封装外形",
}
FORBIDDEN = r"(?i)\b(curve|curves|waveform|response|characteristic|performance|graph|plot|measurement|histogram|distribution|vs\.?|versus|table)\b|曲线|波形|特性"


def line_boxes(items: DataFrame) -> DataFrame:
    """Items (doc_id, page, item_no, str, left, right, base, h; y down) to lines with their boxes."""
    item = F.struct("base", "left", "item_no", "str", "right", "h")
    pages = items.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(item)).alias("items"))
    line = "struct<text:string,left:double,right:double,base:double,h:double>"
    start = F.struct(F.array().cast(f"array<{line}>").alias("done"), F.lit(None).cast(line).alias("open"))

    def add(acc: Column, it: Column) -> Column:
        old = acc["open"]
        same = old.isNotNull() & (F.abs(old["base"] - it["base"]) < F.greatest(F.lit(2.5), it["h"] * 0.5))
        glue = F.when(it["left"] - old["right"] > it["h"] * 0.6, "  ").otherwise(" ")
        grown = F.struct(F.concat(old["text"], glue, it["str"]).alias("text"), F.least(old["left"], it["left"]).alias("left"), F.greatest(old["right"], it["right"]).alias("right"), old["base"].alias("base"), F.greatest(old["h"], it["h"]).alias("h"))
        new = F.struct(it["str"].alias("text"), it["left"].alias("left"), it["right"].alias("right"), it["base"].alias("base"), it["h"].alias("h"))
        closed = F.when(same | old.isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(old)))
        return F.struct(closed.alias("done"), F.when(same, grown).otherwise(new).alias("open"))

    lines = F.aggregate("items", start, add, lambda a: F.concat(a["done"], F.array(a["open"])))
    out = pages.select("doc_id", "page", F.posexplode(lines).alias("line_no", "l"))
    top, bottom = F.col("l.base") - F.col("l.h"), F.col("l.base") + F.col("l.h") * 0.25
    return out.select("doc_id", "page", "line_no", clean_line_text(F.col("l.text")).alias("text"), "l.left", "l.right", top.alias("top"), bottom.alias("bottom"))


def figure_filter(figures: DataFrame, packages: int = 1) -> DataFrame:
    """(doc_id, fig_no, result): kept, or why not. figures: (doc_id, fig_no, kind, title, page, y0).

    A title must suit its kind; of near places of one kind on a page the first stays; numbered captions come first
    under the caps.
    """
    allowed = F.lit(False)
    for kind, pattern in ALLOWED.items():
        allowed = F.when(F.col("kind") == kind, matches(F.col("title"), pattern)).otherwise(allowed)
    why = F.when(matches(F.col("title"), FORBIDDEN), "blacklist_curve_plot").when(~allowed, "keyword_not_matched")
    f = figures.withColumn("why", why)
    rows = f.where("why is null").groupBy("doc_id", "page", "kind").agg(F.array_sort(F.collect_list(F.struct("fig_no", "y0", "title"))).alias("f"))
    near = lambda acc, x: F.exists(acc, lambda k: F.abs(k["y0"] - x["y0"]) < 0.05)
    kept = F.aggregate("f", F.array().cast("array<struct<fig_no:bigint,y0:double,title:string>>"), lambda acc, x: F.when(near(acc, x), acc).otherwise(F.concat(acc, F.array(x))))
    one = rows.select("doc_id", "page", "kind", F.explode(kept).alias("k")).select("doc_id", "page", "kind", "k.fig_no", "k.title")
    most = F.when(F.col("kind") == "block_diagram", 1).when(F.col("kind") == "application", 3).when(F.col("kind") == "package_outline", max(1, min(packages, 2))).otherwise(max(1, packages))
    numbered = F.when(matches(F.col("title"), r"^figure\s+\d", True), 0).otherwise(1)
    place = F.row_number().over(W.partitionBy("doc_id", "kind").orderBy(numbered, "page", "fig_no"))
    picked = one.withColumn("place", place).where(F.col("place") <= most).select("doc_id", "fig_no", F.lit("kept").alias("ok"))
    out = f.join(picked, ["doc_id", "fig_no"], "left")
    return out.select("doc_id", "fig_no", F.coalesce("ok", "why", F.lit("duplicate_or_over_cap")).alias("result"))


def _merge_anonymous(transitive: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        groups: list[dict | None] = []
        first: dict[tuple, int] = {}  # the first group that has an endpoint
        goes: list[int] = []  # groups that have been merged into an earlier one

        def home_of(g: int) -> int:
            while goes[g] != g:
                goes[g] = g = goes[goes[g]]
            return g

        rows = pdf.dropna(subset=["batch_no", "net_id"]).sort_values(["batch_no", "net_id", "ref", "pin"])
        plain = zip(*(rows[c].tolist() for c in ("batch_no", "net_id", "ref", "pin", "conf_pct")), strict=True)
        for _, net in groupby(plain, key=lambda r: r[:2]):  # a data frame a net costs far more than its rows
            net = list(net)
            ends, conf = [r[2:4] for r in net], int(np.nanmax([r[4] for r in net]))
            if len(ends) < 2:
                continue
            hits = sorted({home_of(first[e]) for e in ends if e in first}) or [len(groups)]
            home = hits[0]
            if home == len(groups):
                groups.append({"ends": {}, "conf": conf})
                goes.append(home)
            for other in hits[1:] if transitive else ():
                groups[home]["ends"] |= groups[other]["ends"]
                groups[home]["conf"] = max(groups[home]["conf"], groups[other]["conf"])
                groups[other], goes[other] = None, home
            groups[home]["ends"] |= dict.fromkeys(ends)
            groups[home]["conf"] = max(groups[home]["conf"], conf)
            for e in ends:
                first[e] = min(first.get(e, home), home)
        rows = [(pdf["design_id"].iat[0], f"N${i}", r, p, g["conf"]) for i, g in enumerate((g for g in groups if g), 1) for r, p in g["ends"]]
        return pd.DataFrame(rows, columns=["design_id", "net", "ref", "pin", "conf_pct"])

    return run


def batch_anonymous_nets(rows: DataFrame, transitive: bool = False) -> DataFrame:
    """Unnamed nets of a design that share an endpoint, merged in one ordered pass, named N$1, N$2, ...

    A net that touches two groups joins the first only, unless transitive. The pass looks its endpoints up in an index of the
    first group that has each, so it is linear in them; a design's unnamed endpoints are one task, without a cap.
    """
    blank = rows.where(F.trim("name") == "")
    return blank.groupBy("design_id").applyInPandas(_merge_anonymous(transitive), "design_id long, net string, ref string, pin string, conf_pct long")


#: What an extractor is told of the source at most: references, labels, and pairs of a reference and its value, and how sure a pair must be.
HINT_REFS, HINT_LABELS, HINT_PAIRS, HINT_SURE = 220, 100, 80, 0.65


def census_hints(refs: DataFrame, labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """(design_id, refs, labels, pairs): what the source shows of a design, in order and bounded, as one row.

    refs: (design_id, ref); labels: (design_id, label); pairs: (design_id, ref, value, confidence), as `ref=value`.
    """
    sure = pairs.where(F.col("confidence") >= HINT_SURE).select("design_id", F.concat_ws("=", "ref", "value").alias("text"))
    out = None
    for df, name, most in ((refs.select("design_id", F.col("ref").alias("text")), "refs", HINT_REFS), (labels.select("design_id", F.col("label").alias("text")), "labels", HINT_LABELS), (sure, "pairs", HINT_PAIRS)):
        place = F.row_number().over(W.partitionBy("design_id").orderBy("text"))
        one = df.distinct().withColumn("place", place).where(F.col("place") <= most).groupBy("design_id").agg(F.array_sort(F.collect_list("text")).alias(name))
        out = one if out is None else out.join(one, "design_id", "full")
    return out


def enrich_batches(batches: DataFrame, extract: Callable[..., list[tuple[str, str]]], most: int = 220, hints: DataFrame | None = None) -> DataFrame:
    """An extractor's (ref, value) rows for each batch of references; a call gets at most `most` references, and a batch
    of more takes several calls. With hints (census_hints) a call also gets what the source shows of the design, as
    {"refs": [...], "labels": [...], "pairs": [...]}.

    batches: (design_id, batch_no, ref). Filter to what needs extraction before this: filters don't pass it.
    """
    place = F.row_number().over(W.partitionBy("design_id", "batch_no").orderBy("ref"))
    part = batches.select("design_id", "batch_no", "ref", F.floor((place - 1) / most).alias("part"))
    grouped = part.groupBy("design_id", "batch_no", "part").agg(F.array_sort(F.collect_list("ref")).alias("refs"))
    if hints is not None:
        grouped = grouped.join(hints.select("design_id", F.struct("refs", "labels", "pairs").alias("hints")), "design_id", "left")

    told = hints is not None

    def run(frames):
        for pdf in frames:
            rows = []
            for r in pdf.itertuples():
                more = () if not told else ({k: list((r.hints or {}).get(k) if (r.hints or {}).get(k) is not None else []) for k in ("refs", "labels", "pairs")},)
                rows += [(r.design_id, r.batch_no, ref, value) for ref, value in extract(list(r.refs), *more)]
            yield pd.DataFrame(rows, columns=["design_id", "batch_no", "ref", "value"])

    return grouped.mapInPandas(run, "design_id long, batch_no long, ref string, value string")


def figure_image_bind(figures: DataFrame, uploads: DataFrame) -> DataFrame:
    """Uploads (upload_id, fig_id, expected_revision, sha) bound to figures (fig_id, revision), or why not.

    A bound image makes the figure's approval lapse.
    """
    j = uploads.join(figures.select("fig_id", "revision"), "fig_id", "left")
    result = F.when(F.col("revision").isNull(), "unknown_figure").when(F.col("expected_revision") != F.col("revision"), "revision_conflict").otherwise("bound")
    return j.select("upload_id", "fig_id", result.alias("result"), F.when(result == "bound", F.concat(F.lit("figure:"), F.col("fig_id").cast("string"))).alias("lapsed"))
