"""Exact top-k inner products with an impact-ordered index, score at a time.

Vectors become integers floor(256 x). Blocks of vectors are indexed: in each dimension the values are quantised to
LEVELS levels, and a posting segment lists the rows of one level. A segment's impact for a query is the weight times
the better end of its level. A query processes a block's segments by descending impact, in rounds, adding to the rows'
accumulators. After a round the bounds are drawn: a row adds, in each dimension whose segment with it has not come
yet, at most the next impact there. The best rows by bound are scored exactly, which gives a threshold; processing
stops only when the rows whose bound reaches the threshold are few enough to score them all, or no segment is left.
Those possible members are then scored exactly, and every other row is proved to be below the k-th score. The best k
of the blocks are merged by a window.

Queries meet vectors in blocks of bounded size (a stated query set against all rows), so a task's memory is bounded.
Vectors of like width share blocks, and wider ones have fewer rows a block.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor rows without an id;
shorter vectors count as padded with zeros; scores are exact whatever the components' size: where a block's products might
pass 63 bits they are summed as whole numbers without a bound, and a result beyond the long range raises an error, as does a
component of 2^62 or more after scaling; a query's own rows are all rows of its id; repeated rows of an id are candidates each but one query; ties go to the smaller id; fewer than k other rows give fewer results; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sheetgraph.llm.common import table

SCALE = 256
LEVELS = 32
#: Rounds of descending impact; bounds are drawn after each from the half on.
ROUNDS = 10
BLOCK = 16_384
QUERY_BLOCK = 4096
#: Vectors of up to this width have BLOCK rows a block; from there on, rows times width stay below their product.
WIDE = 1024
#: Components from here on have no integer form.
LIMIT = 1 << 62
#: A query stops for a block when this share of its rows, or fewer, may still be members.
POSSIBLE = 0.05
OUT = "query_id long, vec_id long, score long"


def quantised(embedding: Column) -> Column:
    scaled = lambda x: F.lit(SCALE) * x.cast("double")
    return F.transform(embedding, lambda x: F.when(F.abs(scaled(x)) < float(LIMIT), F.floor(scaled(x))).otherwise(F.raise_error(F.lit("a component is beyond the long range"))))


def finite(embedding: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    return embedding.isNotNull() & ~F.exists(embedding, bad)


def matrix(vectors: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims), np.int64)
    for i, v in enumerate(vectors):
        out[i, : min(len(v), dims)] = v[:dims]
    return out


def exact_scores(vectors: np.ndarray, q: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of the rows by whole numbers without a bound, and their scores."""
    scores = vectors[rows].astype(object) @ q.astype(object)
    best = sorted(range(len(rows)), key=lambda i: (-scores[i], ids[rows[i]]))[:k]
    if any(not -(1 << 63) <= scores[i] < 1 << 63 for i in best):
        raise OverflowError("a score is beyond the long range")
    return rows[best], np.array([int(scores[i]) for i in best], np.int64)


class Index:
    """Posting segments of a block of vectors."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        low, high = vectors.min(0), vectors.max(0)
        self.low, self.width = low, np.maximum(1, -(-(high - low + 1) // LEVELS))
        self.level = ((vectors - low) // self.width).astype(np.int8)
        self.ids, self.values, self.cuts = [], [], []
        for d in range(vectors.shape[1]):
            order = np.argsort(self.level[:, d], kind="stable")
            self.ids.append(order)
            self.values.append(vectors[order, d])
            self.cuts.append(np.searchsorted(self.level[order, d], np.arange(LEVELS + 1)))

    def possible(self, q: np.ndarray, k: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that may be among the k best (own rows aside), and their exact scores."""
        n, dims = self.vectors.shape
        up = q > 0
        # What a level adds at most: the weight times its better end; levels counted from the better end of a dimension.
        far = np.arange(LEVELS)[None, :]
        level = np.where(up[:, None], LEVELS - 1 - far, far)
        most = q[:, None] * (self.low[:, None] + self.width[:, None] * (level + up[:, None]) - up[:, None])
        most[q == 0] = 0
        impacts = np.sort(most[q != 0], axis=None)[::-1]
        passed, added, floor_, rows = np.zeros(dims, np.int64), np.zeros(n, np.int64), None, np.arange(n)
        for r in range(1, ROUNDS + 1) if len(impacts) else ():
            least = impacts[len(impacts) * r // ROUNDS - 1]
            now = np.where(q != 0, (most >= least).sum(1), LEVELS)
            for d in np.flatnonzero((now > passed) & (q != 0)):
                c = self.cuts[d]
                a, b = (c[LEVELS - now[d]], c[LEVELS - passed[d]]) if up[d] else (c[passed[d]], c[now[d]])
                added[self.ids[d][a:b]] += q[d] * self.values[d][a:b]
            passed = now
            if 2 * r < ROUNDS:
                continue
            # A row whose level in a dimension has not come yet adds at most the next level's impact there.
            rest = np.where(passed < LEVELS, most[np.arange(dims), np.minimum(passed, LEVELS - 1)], 0).astype(np.float32)
            slack = float(np.abs(rest).sum(dtype=np.float64)) * dims * 2.0**-22  # more than float32 can round off
            edge = np.where(up, LEVELS - passed, passed).astype(np.int8)
            unseen = (self.level < edge) == up
            bound = added + unseen.astype(np.float32) @ rest
            bound[own] = -np.inf
            top = np.argpartition(-bound, min(4 * k, n - 1))[: 4 * k]
            top = top[~own[top]]
            if len(top) >= k:
                kth = int(np.partition(self.vectors[top] @ q, len(top) - k)[len(top) - k])
                floor_ = kth if floor_ is None else max(floor_, kth)
            if floor_ is not None:
                rows = np.flatnonzero(bound >= floor_ - 1 - slack)
                if len(rows) <= max(4 * k, POSSIBLE * n):
                    break
        rows = rows[~own[rows]]
        return rows, self.vectors[rows] @ q


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(vec_id, v) against (query_id, q), both with integer arrays: each query's k best rows with another id."""
    vectors, queries = vectors.where("vec_id is not null"), queries.where("query_id is not null")
    wide = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.size("v"), F.lit(1)) / F.lit(WIDE)))).cast("int")  # 0, or doublings beyond WIDE
    counts = vectors.groupBy(wide.alias("wide")).agg(F.count("*").alias("n")).collect()  # 32 at most
    blocks = {r["wide"]: max(1, -(-r["n"] // max(1, BLOCK >> r["wide"]))) for r in counts} or {0: 1}
    query_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    part = lambda c, m: F.pmod(F.xxhash64(c), m).cast("int")
    own = F.element_at(F.create_map(*[F.lit(x) for kv in blocks.items() for x in kv]), F.col("wide"))
    every = F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))
    left = vectors.withColumn("wide", wide).select((F.col("wide") * F.lit(1 << 24) + part("vec_id", own)).alias("vb"), every.alias("qb"), "vec_id", "v")
    all_blocks = F.explode(F.flatten(F.array(*(F.sequence(F.lit(w << 24), F.lit((w << 24) + m - 1)) for w, m in blocks.items()))))
    right = queries.select(all_blocks.alias("vb"), part("query_id", F.lit(query_blocks)).alias("qb"), "query_id", "q")

    def meet(_key, vs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        if vs.empty or qs.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        dims = max(vs["v"].map(len).max(), 1)  # beyond it every product is zero
        all_rows, ids = matrix(vs["v"], dims), vs["vec_id"].to_numpy()
        largest, index, out = np.abs(all_rows).max(0).astype(np.float64), None, []
        for qid, q in zip(qs["query_id"], matrix(qs["q"], dims), strict=True):
            if largest @ np.abs(q.astype(np.float64)) >= 2.0**60:  # sums of products may pass 63 bits
                rows, scores = exact_scores(all_rows, q, np.flatnonzero(ids != qid), ids, k)
                out.append(pd.DataFrame({"query_id": qid, "vec_id": ids[rows], "score": scores}))
                continue
            index = index or Index(all_rows)
            rows, scores = index.possible(q, k, ids == qid)
            best = np.lexsort((ids[rows], -scores))[:k]
            out.append(pd.DataFrame({"query_id": qid, "vec_id": ids[rows[best]], "score": scores[best]}))
        return pd.concat(out)

    met = left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInPandas(meet, OUT)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").where(finite(F.col("embedding")) & F.col("vec_id").isNotNull())
    vectors = e.select("vec_id", quantised(F.col("embedding")).alias("v"))
    queries = vectors.where("vec_id % 50 = 0").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("q"))
    return search(vectors, queries)


ORACLE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id, list_inner_product(q.v::DOUBLE[], e.v::DOUBLE[])::BIGINT AS score
  FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
