"""Mixing sources to target weights, with DataFrame functions only.

Sizes are words. Every source gets a share of all words by its weight, at most `cap` times its own words; what a
capped source can't take is shared again by weight. A document is emitted floor(rate) times, and once more with
the probability of the fraction, decided by a hash of the seed and its id, so reruns agree.

Defined cases: null text has size 0; a null source is a source of its own, last in order; a source without words
has target 0 and its documents are not emitted; rows with equal ids are decided alike; an empty table gives an
empty result. Columns of the input are kept; the added ones replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sheetgraph.llm.common import WORD, cut, table, whole_rows

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"
#: A table of sources up to this many characters of names and keys is broadcast; a larger one is joined by shuffle.
BROADCAST_CHARS = 4_000_000
SALTS = 32


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size) -> the same and target, rate.

    With sources in order of cap * size / weight, the capped ones come first. lam, the words for one unit of
    weight, is the largest of (words left) / (weight left) over the prefixes: it rises while sources are capped and
    falls after. One row per source, so the unpartitioned windows are as small as the list of sources.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    k = F.row_number().over(by_name)
    w = F.element_at(F.array(*map(F.lit, weights)), (k - 1) % len(weights) + 1)
    t = sizes.select("source", "source_size", k.alias("k"), w.cast("long").alias("w"))
    before = W.orderBy(F.col("source_size") * cap / F.col("w"), "k").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0))
    weight = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))
    t = t.withColumn("lam", left.cast("double") / weight.cast("double"))
    most = (F.col("source_size") * cap).cast("double")
    t = t.withColumn("target", F.least(most, F.max("lam").over(every) * F.col("w")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return t.select("source", "source_size", "target", rate.alias("rate"))


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number from 0 to 1 (not 1) by the md5 of seed and id."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


def mix_plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """docs and size, source_size, target, copies, taken."""
    added = ("size", "source_size", "target", "copies", "taken")
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in added]
    return _planned(docs, weights, cap, seed).select(*kept, *added)


def _planned(docs: DataFrame, weights: Sequence[int], cap: int, seed: str) -> DataFrame:
    """(row, size, source_size, target, copies, taken)."""
    d = whole_rows(docs, "doc_id", "source", "text").withColumn("size", words(F.col("text"))).drop("text")
    targets = cut(source_targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap))
    t = targets.withColumnRenamed("source", "s")
    chars = targets.agg(F.sum(F.length(F.coalesce("source", F.lit(""))) + 32)).first()[0] or 0
    if chars <= BROADCAST_CHARS:
        out = d.join(F.broadcast(t), F.col("source").eqNullSafe(F.col("s")), "left")
    else:
        t = t.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        d = d.withColumn("own_salt", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)).cast("int"))
        out = d.join(t, F.col("source").eqNullSafe(F.col("s")) & (F.col("own_salt") == F.col("salt")), "left")
    whole = F.floor("rate").cast("long")
    more = (draw(F.col("doc_id"), seed) < F.col("rate") - whole).cast("long")
    copies = F.least(whole + more, F.lit(cap).cast("long"))
    out = out.select("row", "size", "source_size", "target", copies.alias("copies"))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The mixture: every document as often as the plan says, with the columns of docs."""
    plan = _planned(docs, weights, cap, seed).where("copies > 0")
    return plan.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM {docs}),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
k AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM s),
w AS (SELECT *, CASE (k - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM k),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER b, 0))::DOUBLE
    / (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::DOUBLE AS lam
  FROM w WINDOW b AS (ORDER BY source_size * 3 / w::DOUBLE, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least((source_size * 3)::DOUBLE, max(lam) OVER () * w) AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t)
SELECT d.doc_id, d.size, r.source_size, r.target, d.size * c.copies AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source,
LATERAL (SELECT least(floor(r.rate)::BIGINT + CASE WHEN ('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 8))::BIGINT / 4294967296.0
  < r.rate - floor(r.rate) THEN 1 ELSE 0 END, 3) AS copies) c
"""


def query(spark, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
