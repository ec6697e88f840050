"""Benchmark decontamination by spaced seeds.

Tokens are runs of letters and digits, lower-cased. A mask picks five of the tokens in a window and ignores the rest,
so a substituted token spoils only the windows where it is picked. The hashes of all masked windows of the test items
fill a bitmap of fixed size, which is broadcast; training documents are hashed in batches, and only windows whose bit
is set go on, gathered into regions of nearby windows. Their hashes join the test hashes; each hit names an item and
an alignment. A hit is verified on the tokens around it: on that alignment, some stretch of at least MIN_TOKENS tokens
(or the whole item, if it is shorter) that begins and ends with equal tokens must agree in at least SIMILARITY of
its tokens. A stretch reaches to the ends of the item or of the document's region, which ends where GAP tokens pass without
a hit. Insertions change the alignment, and either side of one is verified by itself.

Items of fewer than MIN_TOKENS tokens have masks of their own, for each such length that the test set has: the whole
item where no substitution is tolerated, else the unions of all but as many segments of it as substitutions are, so
one of them misses every substitution.

The bitmap has 2^BITMAP_BITS bits whatever the test set, made by a grouped bit_or; a larger test set only lets more
windows through to the exact join. Hashes that very many test windows share are split by item over SALTS tasks.

Defined cases: null texts, and texts without tokens, match nothing, and items without tokens are never matched;
repeated items are separate items; rows of one id (null, too) are told apart by a hash of their texts, and rows alike
in both are reported once; empty tables give an empty report; other columns may have any names.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetgraph.llm.common import cut, table, text_chunks, text_key, whole_rows

#: Offsets of the picked tokens.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 3, 5, 6), (0, 2, 3, 4, 7), (0, 1, 4, 6, 8))
SPAN = 1 + max(m[-1] for m in MASKS)
SIMILARITY = 0.8
MIN_TOKENS = 13
BITMAP_BITS = 24
#: Windows this near each other are one region.
GAP = 64
TOKEN = re.compile(r"[^\W_]+")
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], dtype=np.uint64)


#: A hash with more test windows than this and than 1/HOT_SHARE of all is split over SALTS tasks.
HOT_LEAST, HOT_SHARE, SALTS = 64, 4096, 16


def short_masks(n: int) -> list[tuple[int, ...]]:
    """Offsets picked in an item of n tokens, n under MIN_TOKENS, so that any tolerated substitutions spare one mask."""
    swaps = n - math.ceil(SIMILARITY * n - 1e-9)
    if not swaps:
        return [tuple(range(n))]
    parts = 2 * swaps + (swaps == 1)  # one: two of three segments, two: two of four
    edges = [n * k // parts for k in range(parts + 1)]
    kept = itertools.combinations(range(parts), parts - swaps)
    return [tuple(o for k in own for o in range(edges[k], edges[k + 1])) for own in kept]


class Masks:
    """Masks by number: first those of long items, then those of each short length."""

    def __init__(self, lengths: list[int]):
        self.all: list[tuple[int, ...]] = list(MASKS)
        self.of: dict[int, range] = {}
        for n in sorted(lengths):
            first = len(self.all)
            self.all += short_masks(n)
            self.of[n] = range(first, len(self.all))

    def of_item(self, n: int) -> range:
        return self.of.get(n, range(0)) if n < MIN_TOKENS else range(len(MASKS))


class Tokens:
    """Token hashes, remembered up to a bound."""

    def __init__(self, most: int = 200_000):
        self.known: dict[str, int] = {}
        self.most = most

    def __call__(self, text: str) -> np.ndarray:
        words = TOKEN.findall(text.lower())
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(known) > self.most:
                known.clear()
            out = np.empty(len(words), np.uint64)
            for i, w in enumerate(words):
                h = known.get(w)
                if h is None:
                    known[w] = h = xxhash.xxh64_intdigest(w)
                out[i] = h
            return out


def window_hashes(tokens: np.ndarray, mask: tuple[int, ...], number: int) -> np.ndarray:
    """The hash of each window that a mask fits in."""
    n = len(tokens) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, number + 1, np.uint64)
    for k, o in enumerate(mask):
        h ^= tokens[o : o + n] * _K[k % len(_K)]
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return h


def agrees(a: np.ndarray, b: np.ndarray, shift: int, at: int) -> int:
    """The most tokens of a stretch of b over position `at` that agrees with a[i + shift] well enough, else 0.

    The stretch may reach as far as both go. With one more for an equal token and SIMILARITY less for every token, a stretch is
    good if its sum is not below zero; of beginnings only those with a lower sum than all before, of ends the last one
    high enough matter, so it is one search over running sums.
    """
    lo, hi = max(0, -shift), min(len(b), len(a) - shift)
    same = a[lo + shift : hi + shift] == b[lo:hi]
    hits = np.flatnonzero(same)
    if not len(hits):
        return 0
    sums = np.concatenate([[0], np.cumsum(1000 * same - round(1000 * SIMILARITY))])
    first, last = hits[hits <= at - lo + SPAN], hits[hits >= at - lo]
    if not len(first) or not len(last):
        return 0
    highest = np.maximum.accumulate(sums[last + 1][::-1])[::-1]  # of this end and all later ones
    end = len(last) - np.searchsorted(highest[::-1], sums[first], side="left") - 1
    found = end >= 0
    length = (last[end] - first + 1)[found]
    return int(length[length >= min(MIN_TOKENS, len(b))].max(initial=0))


def _lengths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        n = {len(TOKEN.findall(t.lower())) for t in pdf["text"]}
        yield pd.DataFrame({"n": sorted(k for k in n if 0 < k < MIN_TOKENS)}, dtype="int32")


def _item_windows(masks: Masks):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = Tokens()
        for pdf in batches:
            for item, text in zip(pdf["item_id"], pdf["text"], strict=True):
                t = tokens(text or "")
                for k in masks.of_item(len(t)):
                    h = window_hashes(t, masks.all[k], k)
                    yield pd.DataFrame({"hash": h.view(np.int64), "item_id": item, "item_at": np.arange(len(h))})

    return run


def bitmap_of(hashes: DataFrame) -> np.ndarray:
    """Bit h mod 2^BITMAP_BITS is set for each hash h; the words of the bitmap are few whatever their number."""
    bit = F.col("hash").bitwiseAND((1 << BITMAP_BITS) - 1)
    words = hashes.groupBy((F.shiftright(bit, 6)).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(hash & 63 as int))")).alias("b")).toPandas()
    out = np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
    out[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).view(np.uint64)
    return out


def _regions(shared, masks: Masks):
    """Per document the regions around windows whose bit is set: (doc_id, th, first, hashes, ats, tokens)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, bitmap, low = Tokens(), shared.value, np.uint64((1 << BITMAP_BITS) - 1)
        for pdf in batches:
            ids, keys, rows = pdf["doc_id"].tolist(), pdf["th"].tolist(), []
            for first, chunk in text_chunks(pdf["text"].tolist()):
                each = [tokens(t) for t in chunk]
                starts = np.cumsum([0] + [len(t) for t in each])
                flat = np.concatenate(each)
                found = []
                for number, mask in enumerate(masks.all):
                    h = window_hashes(flat, mask, number)
                    bit = h & low
                    at = np.flatnonzero(bitmap[(bit >> np.uint64(6)).astype(np.intp)] >> (h & np.uint64(63)) & np.uint64(1))
                    doc = np.searchsorted(starts, at, side="right") - 1
                    whole = at + mask[-1] < starts[doc + 1]
                    found.append((doc[whole], at[whole], h[at[whole]]))
                doc, at, h = (np.concatenate([f[i] for f in found]) for i in range(3))
                order = np.lexsort((at, doc))
                doc, at, h = doc[order], at[order], h[order]
                cuts = np.flatnonzero((np.diff(doc) != 0) | (np.diff(at) > GAP)) + 1
                for a, b in zip([0, *cuts], [*cuts, len(at)], strict=True) if len(at) else ():
                    d = doc[a]
                    lo, hi = max(starts[d], at[a] - GAP), min(starts[d + 1], at[b - 1] + SPAN + GAP)
                    rows.append((ids[first + d], keys[first + d], int(lo - starts[d]), h[a:b].view(np.int64), (at[a:b] - lo).astype(np.int32), flat[lo:hi].view(np.int64)))
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "th", "first", "hashes", "ats", "tokens"]).astype({"doc_id": "Int64"})

    return run


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, th, item_id, at, n_tokens): verified overlaps of documents with test items, `at` counting tokens.

    One row per document, item and region, with the longest stretch.
    """
    items = benchmark.select("item_id", "text").where("text is not null")
    masks = Masks([r["n"] for r in items.mapInPandas(_lengths, "n int").distinct().collect()])  # MIN_TOKENS - 1 at most
    windows = cut(items.mapInPandas(_item_windows(masks), "hash long, item_id long, item_at long"))
    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of(windows))
    schema = "doc_id long, th long, first int, hashes array<long>, ats array<int>, tokens array<long>"
    texts = docs.select("doc_id", text_key(F.col("text")).alias("th"), "text").where("text is not null")
    regions = texts.mapInPandas(_regions(shared, masks), schema)
    name = F.concat(F.hex(F.xxhash64("tokens", "ats", "hashes")), F.hex(F.xxhash64(F.lit(1), "hashes", "tokens", "ats")))
    regions = cut(regions.withColumn("region", name))
    # Copies of a document have equal regions: each different one is verified once.
    distinct = regions.groupBy("region").agg(F.first("hashes").alias("hashes"), F.first("ats").alias("ats"), F.first("tokens").alias("tokens"))
    hits = distinct.select("region", F.explode(F.arrays_zip("hashes", "ats")).alias("w")).select("region", F.col("w.hashes").alias("hash"), F.col("w.ats").cast("long").alias("at"))
    joined = _meet(hits, windows).groupBy("region", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).agg(F.sort_array(F.collect_set("item_at")).alias("item_ats"))
    texts = items.select(F.col("item_id").alias("i"), F.col("text").alias("item_text"))
    pairs = joined.join(distinct.select(F.col("region").alias("r"), "tokens"), F.col("region") == F.col("r")).join(texts, F.col("item_id") == F.col("i"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = Tokens()
        for pdf in batches:
            best = []
            for t, text, shift, ats in zip(pdf["tokens"], pdf["item_text"], pdf["shift"], pdf["item_ats"], strict=True):
                a, b, n, done = np.asarray(t, np.int64).view(np.uint64), tokens(text), 0, -1
                for at in ats:
                    if at > done:  # the next hit is tried unless the stretch found covers it
                        n = max(n, agrees(a, b, int(shift), int(at)))
                        done = at + SPAN if n else at
                best.append(n)
            out = pdf[["region", "item_id"]].assign(n_tokens=best)
            yield out[out["n_tokens"] > 0]

    good = pairs.select("region", "item_id", "shift", "item_ats", "tokens", "item_text").mapInPandas(verify, "region string, item_id long, n_tokens int")
    good = cut(good.groupBy(F.col("region").alias("r"), "item_id").agg(F.max("n_tokens").alias("n_tokens")))
    out = regions.select("doc_id", "th", "first", "region").join(good, F.col("region") == F.col("r"))
    return out.groupBy("doc_id", "th", "item_id", F.col("first").alias("at")).agg(F.max("n_tokens").alias("n_tokens"))


def _meet(hits: DataFrame, windows: DataFrame) -> DataFrame:
    """hits (region, hash, at) and test windows of the same hash. Hashes of many test windows are few (each has over
    1/HOT_SHARE of all), so their list is broadcast; their windows are dealt out by item, and the hits go to each part."""
    counts = windows.groupBy("hash").agg(F.count("*").alias("n"))
    hot = F.broadcast(counts.where(F.col("n") > max(HOT_LEAST, windows.count() // HOT_SHARE)).select(F.col("hash").alias("hot")))
    own = F.when(F.col("hot").isNotNull(), F.pmod(F.xxhash64("item_id"), F.lit(SALTS)).cast("int")).otherwise(0)
    each = F.when(F.col("hot").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    w = windows.join(hot, F.col("hash") == F.col("hot"), "left").select(F.col("hash").alias("h"), own.alias("part"), "item_id", "item_at")
    d = hits.join(hot, F.col("hash") == F.col("hot"), "left").select("region", "hash", "at", F.explode(each).alias("p"))
    return d.join(w, (F.col("hash") == F.col("h")) & (F.col("p") == F.col("part"))).select("region", "at", "item_id", "item_at")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, th, item_ids, n_tokens) for each contaminated document, known by id and hash of its text: its items in
    order, and the longest stretch."""
    found = matches(docs, benchmark)
    return found.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("n_tokens").alias("n_tokens"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated documents."""
    bad = cut(report(docs, benchmark).select(F.col("doc_id").alias("d"), F.col("th").alias("h")))
    own = whole_rows(docs, "doc_id", "text").select("row", "doc_id", text_key(F.col("text")).alias("th"))
    return own.join(bad, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")), "left_anti").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = report(docs, table(spark, sf_dir, "benchmark")).withColumnsRenamed({"doc_id": "d", "th": "h"})
    own = docs.select("doc_id", text_key(F.col("text")).alias("th"))
    out = own.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")), "left")
    none = F.array().cast("array<long>")
    return out.select("doc_id", F.col("h").isNotNull().alias("contaminated"), F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))
