"""Embedding near-duplicates by spherical-cap filters.

A filter is a direction; a vector passes it when its inner product with the direction reaches a threshold, so what passes
lies in a cap of the sphere. Two vectors at a small angle share many caps, others share few. The directions form a random
product code: after a seeded rotation the components are cut into blocks, each block has a codebook of Gaussian words, and
every combination of one word a block is a direction. A vector's list of filters is decoded block by block: a partial
sum is dropped as soon as the best words of the blocks to come cannot lift it to the threshold. Inner products with such
directions are exactly normal for unit vectors, so the number of filters follows from the least cosine, and the
threshold from the number of vectors: caps keep about BUCKET vectors each, and each pair at the least cosine shares COMMON
caps on average. The directions of one code share words, which makes a pair's shared caps uneven; REPEATS independent
codes even them out.

Vectors meet in their filters (equal vectors as one, with their number) and every meeting is verified in double
precision. A pair counts in the first filter that both pass, so the links of a vector can be summed, and only sums and a
spanning forest of each filter's links leave a task, never all pairs. A filter with more than BLOCK vectors is split
into pairs of blocks over several tasks: nothing is dropped.

Defined cases: vectors that are null, empty, all zero, or hold null or non-finite components link with nothing and are
their own component; shorter vectors count as padded with zeros; each row is a vector, also if ids repeat; a row without
an id may link, and is named by the smallest id of its component (null if there is none; it is kept then); equal vectors
link with each other; an empty table gives an empty result; columns but vec_id and embedding are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetgraph.llm.common import cut, join_counted, table
from sheetgraph.llm.graph import components
from sheetgraph.llm.topk import finite

COSINE = 0.9
#: Vectors a cap holds on average, if vectors are spread evenly.
BUCKET = 48
#: Caps that two vectors at COSINE share on average.
COMMON = 12
#: Independent codes.
REPEATS = 16
BLOCKS = 2
#: Vectors of one filter that meet in a task.
BLOCK = 2048
#: Bounds of the threshold; at the highest there are some 2^24 filters.
LOWEST, HIGHEST = 2.0, 4.4
SEED = 20_011


def tail(a: float) -> float:
    """The chance that a standard normal number is above a."""
    return math.erfc(a / math.sqrt(2)) / 2


def both_tails(a: float, rho: float) -> float:
    """The chance that two standard normal numbers of correlation rho are both above a."""
    z = np.linspace(a, a + 8, 4001)
    f = np.exp(-z * z / 2) / math.sqrt(2 * math.pi) * np.array([tail((a - rho * x) / math.sqrt(1 - rho * rho)) for x in z])
    return float(np.sum((f[1:] + f[:-1]) / 2) * (z[1] - z[0]))


@dataclass(frozen=True)
class Code:
    """Which directions there are: `repeats` times `blocks` codebooks of `words` words, for vectors of `dims` components."""

    dims: int
    words: int
    threshold: float
    repeats: int = REPEATS
    blocks: int = BLOCKS

    @property
    def side(self) -> int:
        """Components of a block, a power of two."""
        return 1 << max(0, math.ceil(math.log2(max(1, self.dims) / self.blocks)))


def code_for(n: int, dims: int, cosine: float = COSINE) -> Code:
    """The code for n vectors."""
    low, high = LOWEST, HIGHEST
    for _ in range(40):  # the threshold that about BUCKET of n vectors reach
        mid = (low + high) / 2
        low, high = (mid, high) if n * tail(mid) > BUCKET else (low, mid)
    directions = COMMON / both_tails(low, cosine) / REPEATS
    return Code(dims, math.ceil(directions ** (1 / BLOCKS)), low)


class Decoder:
    """Lists the filters of vectors by one of the codes."""

    def __init__(self, code: Code, repeat: int):
        rng = np.random.default_rng([SEED, repeat])
        self.code, self.first = code, repeat * code.words**code.blocks
        width = code.blocks * code.side
        self.signs = rng.choice([-1.0, 1.0], (3, width))
        self.order = rng.permutation(width)
        self.books = rng.standard_normal((code.blocks, code.side, code.words))

    def rotated(self, unit: np.ndarray) -> np.ndarray:
        """Signs and Hadamard transforms of blocks, three times, with a fixed shuffle of the components in between."""
        side = self.code.side
        x = np.zeros((len(unit), self.code.blocks * side))
        x[:, : unit.shape[1]] = unit
        for s in self.signs:
            x = (x * s)[:, self.order].reshape(-1, side)
            h = 1
            while h < side:
                y = x.reshape(-1, side // (2 * h), 2, h)
                x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(-1, side) / math.sqrt(2)
                h *= 2
            x = x.reshape(len(unit), -1)
        return x

    def filters(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, filters) of unit vectors."""
        n, k, m = len(unit), self.code.words, self.code.blocks
        x = self.rotated(unit).reshape(n, m, self.code.side)
        scores = [x[:, b] @ self.books[b] for b in range(m)]
        ranked = [np.argsort(-s, axis=1) for s in scores]
        falling = [np.take_along_axis(s, r, 1) for s, r in zip(scores, ranked, strict=True)]
        rows, sums, names = np.arange(n), np.zeros(n), np.zeros(n, np.int64)
        for b in range(m):
            to_come = sum((falling[c][:, 0][rows] for c in range(b + 1, m)), np.zeros(len(rows)))
            need = self.code.threshold - sums - to_come
            # How many of a row's words reach what is needed: the rows, one after another, make one rising sequence.
            step = 4 * float(np.abs(falling[b]).max(initial=1.0) + np.abs(need).max(initial=1.0))
            rising = (np.arange(n)[:, None] * step - falling[b]).ravel()
            take = np.searchsorted(rising, rows * step - need, side="right") - rows * k
            at = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
            rows, sums, names = np.repeat(rows, take), np.repeat(sums, take), np.repeat(names, take)
            sums = sums + falling[b][rows, at]
            names = names * k + ranked[b][rows, at]
        return rows, self.first + names


def unit_rows(flat: np.ndarray, lengths: np.ndarray, dims: int) -> np.ndarray:
    """Vectors one after another as rows of length one."""
    out = np.zeros((len(lengths), dims))
    out[np.arange(dims)[None, :] < lengths[:, None]] = flat
    out /= np.abs(out).max(1, keepdims=True)  # squares neither overflow nor vanish
    return out / np.sqrt((out * out).sum(1, keepdims=True))


def vectors_of(column: pa.Array, dims: int) -> np.ndarray:
    return unit_rows(np.asarray(column.flatten()).astype(np.float64), np.asarray(pc.list_value_length(column)), dims)


def decode(code: Code):
    """Batches of (node, embedding) -> (filter, node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoders = [Decoder(code, r) for r in range(code.repeats)]
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                unit, nodes = vectors_of(part.column(1), code.dims), np.asarray(part.column(0))
                for d in decoders:
                    rows, names = d.filters(unit)
                    yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.array(nodes[rows])], ["filter", "node"])

    return run


def shared_before(lists: list[np.ndarray], name: int) -> np.ndarray:
    """Which pairs of rows share a filter before `name`; lists: each row's filters, rising."""
    before = [x[: np.searchsorted(x, name)] for x in lists]
    names, at, times = np.unique(np.concatenate(before), return_inverse=True, return_counts=True)
    keep = np.flatnonzero(times > 1)  # what one row alone passes is not shared
    column = np.full(len(names), -1)
    column[keep] = np.arange(len(keep))
    rows = np.repeat(np.arange(len(lists)), [len(x) for x in before])
    cols = column[at]
    passes = np.zeros((len(lists), len(keep)), np.float32)
    passes[rows[cols >= 0], cols[cols >= 0]] = 1
    return passes @ passes.T > 0


def forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of a symmetric matrix of links."""
    a, b, left = [], [], np.ones(len(near), bool)
    for start in range(len(near)):
        if not left[start]:
            continue
        left[start] = False
        frontier = [start]
        while frontier:
            at = frontier.pop()
            found = np.flatnonzero(near[at] & left)
            left[found] = False
            a += [at] * len(found)
            b += found.tolist()
            frontier += found.tolist()
    return np.array(a, np.int64), np.array(b, np.int64)


def verify(code: Code, cosine: float):
    """Batches sorted by (filter, p, q) -> (0, node, links) for sums of links and (1, node, node) for a forest of them."""

    def links_of(name: int, p: int, q: int, nodes: np.ndarray, ns: np.ndarray, own: np.ndarray, lists: list[np.ndarray], unit: np.ndarray):
        near = unit @ unit.T >= cosine
        np.fill_diagonal(near, False)
        if p != q:
            near &= own[:, None] != own[None, :]
        some = np.flatnonzero(near.any(1))
        if not len(some):
            return None
        near = near[np.ix_(some, some)] & ~shared_before([lists[i] for i in some], name)
        sums = near @ ns[some]
        a, b = forest(near)
        hit = sums > 0
        return np.concatenate([np.zeros(hit.sum(), np.int32), np.ones(len(a), np.int32)]), np.concatenate([nodes[some][hit], nodes[some][a]]), np.concatenate([sums[hit], nodes[some][b]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None

        def close(parts: list[pa.RecordBatch], k: tuple):
            t = pa.Table.from_batches(parts)
            if t.num_rows < 2:
                return None
            col = lambda c: t.column(c).combine_chunks()
            lists = col("filters")
            ends = np.cumsum(np.asarray(pc.list_value_length(lists)))
            return links_of(*k, np.asarray(col("node")), np.asarray(col("n")), np.asarray(col("own")), np.split(np.asarray(lists.flatten()), ends[:-1]), vectors_of(col("embedding"), code.dims))

        for batch in batches:
            if not batch.num_rows:
                continue
            ks = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(3)], 1)
            cuts = [0, *(np.flatnonzero(np.any(ks[1:] != ks[:-1], axis=1)) + 1), batch.num_rows]
            found = []
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if (k := tuple(int(x) for x in ks[s])) != key:
                    if held:
                        found.append(close(held, key))
                    held, key = [], k
                held.append(batch.slice(s, e - s))
            if found := [x for x in found if x is not None]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["kind", "a", "b"])
        if held and (x := close(held, key)) is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in x], ["kind", "a", "b"])

    return run


def links(classes: DataFrame, code: Code, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """(node, embedding, n) of unlike vectors -> (kind, a, b): kind 0: node a has b linked vectors in one filter; 1: a link of a forest."""
    keys = cut(classes.select("node", "embedding").mapInArrow(decode(code), "filter int, node long"))
    total = keys.count()
    sizes = keys.groupBy("filter").agg(F.count("*").alias("rows")).where("rows > 1").withColumn("blocks", F.ceil(F.col("rows") / block))
    met = join_counted(keys, cut(sizes.withColumn("met", F.col("rows"))), "filter", "rows", total)
    lists = keys.groupBy("node").agg(F.array_sort(F.collect_list("filter")).alias("filters"))
    full = classes.select(F.col("node").alias("_node"), "embedding", "n").join(lists, F.col("_node") == F.col("node")).drop("node")
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    pairs = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pairs = pairs.select("filter", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "node", "own")
    rows = pairs.join(full, F.col("node") == F.col("_node")).select("filter", "p", "q", "node", "own", "n", "filters", "embedding")
    return rows.repartition("filter", "p", "q").sortWithinPartitions("filter", "p", "q").mapInArrow(verify(code, cosine), "kind int, a long, b long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """(vec_id, embedding) -> (vec_id, n_links, component_id, kept), one row per row."""
    e = vectors.select("vec_id", "embedding")
    good = finite(F.col("embedding")) & F.exists("embedding", lambda x: x != 0)
    marked = e.withColumn("good", F.coalesce(good, F.lit(False)))
    found = marked.where("good").groupBy("embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    classes = cut(found.withColumn("node", F.monotonically_increasing_id()))
    size = classes.agg(F.count("*").alias("n"), F.sum("n").alias("rows"), F.max(F.size("embedding")).alias("dims")).first()
    alone = marked.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not size["n"]:
        return alone
    out = cut(links(classes, code_for(size["n"], size["dims"], cosine), cosine, block))
    sums = out.where("kind = 0").groupBy(F.col("a").alias("s_node")).agg(F.sum("b").alias("others"))
    roots = components(out.where("kind = 1").select("a", "b")).select(F.col("node").alias("r_node"), "root")
    named = classes.join(sums, F.col("node") == F.col("s_node"), "left").join(roots, F.col("node") == F.col("r_node"), "left")
    named = cut(named.select("embedding", "n", "least", F.coalesce("root", "node").alias("root"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")))
    lowest = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    of_class = join_counted(named.select("embedding", "n", "n_links", "root"), lowest, "root", "members", size["n"]).drop("root")
    rows = join_counted(marked.where("good").select("vec_id", "embedding"), cut(of_class), "embedding", "n", size["rows"])
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull())
    return rows.select("vec_id", "n_links", "component_id", kept.alias("kept")).union(alone)


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE e AS (SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
g AS (SELECT * FROM e WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.k AS a, b.k AS b FROM g a JOIN g b ON a.k <> b.k WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
r AS (SELECT k, k AS seen FROM e UNION SELECT r.k, l.b FROM r JOIN l ON r.seen = l.a),
c AS (SELECT r.k, min(e.vec_id) AS component_id FROM r JOIN e ON r.seen = e.k GROUP BY r.k),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, coalesce(vec_id = component_id, component_id IS NULL) AS kept
FROM e JOIN c USING (k) LEFT JOIN n ON n.a = e.k
"""
