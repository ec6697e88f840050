"""Near-duplicate documents: 64-bit SimHash linked by Golay-code fuzzy hashing.

A fingerprint is cut into three segments of 22, 21 and 21 bits, each padded with zeros to a 23-bit word. The
perfect binary Golay code (23, 12, 7) decodes every such word to the index of the one codeword within three bits.
Two words that differ in at most two bits have a word in the middle, one bit or less from either; the index of that
word is among the indices of both words' one-bit neighbours. So the keys of a segment are those few indices.

Four differing bits fall on three segments in one of two ways:
* a segment has none: of the other two, one has at most two. Key: (equal segment, an index of the other), for each
  ordered pair of segments; about 33 bits tell keys apart.
* each has at least one: two segments have just one each. Key: (index, index) of each pair of segments. Of two words
  one bit apart just one has even parity, so even words need their own index only, odd ones those of all neighbours.

So fingerprints within four bits share a key. Rows of a key meet in one sorted run; within a run links are found by
breadth-first search over the fingerprints not yet reached, which emits a spanning forest (at most one link for each
fingerprint, never all pairs), and every link is checked on the fingerprints. A run of more than RUN fingerprints is
handed back and split into pairs of blocks over further tasks, so a task holds a bounded number. Exact copies have
one fingerprint and take part once. Components come from iterative joins.

Defined cases: a text without words (null or empty) has fingerprint zero and links like any other; fewer than four
words make one shingle; a null doc_id is kept, and its component is that of its fingerprint; repeated rows are kept
(all but one in `keep_one`); other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetgraph.llm.common import cut, join_counted, table, text_key, whole_rows
from sheetgraph.llm.graph import components

SHINGLE = 4
BITS = 4
SEED = 42
#: Fingerprints of one key that a task takes at once.
RUN = 1 << 17
#: (shift, bits) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def fingerprint(text: str | None) -> int:
    """SimHash of the text's word shingles as an unsigned integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words) - SHINGLE + 1
    if not words:
        return 0
    if n < 2:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    first, last = [0, *ends[: n - 1].tolist()], (ends[SHINGLE - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(line[a:b], SEED) for a, b in zip(first, last, strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 14):
        part = h[k : k + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(text: Column) -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf("long")
    def udf(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    return udf(text)


_index: np.ndarray | None = None


def golay_index() -> np.ndarray:
    """The index of the nearest codeword for each of the 2^23 words."""
    global _index
    if _index is None:
        words = np.zeros(1 << 12, np.uint32)
        for k in range(12):
            words ^= np.where(np.arange(1 << 12) >> k & 1, np.uint32(GENERATOR << k), np.uint32(0)).astype(np.uint32)
        one = np.uint32(1) << np.arange(23, dtype=np.uint32)
        i, j = np.triu_indices(23, 1)
        two = one[i] ^ one[j]
        three = np.unique((two[:, None] ^ one).ravel())
        three = three[np.bitwise_count(three) == 3]
        index = np.empty(1 << 23, np.uint16)
        for e in np.concatenate([np.zeros(1, np.uint32), one, two, three]):
            index[words ^ e] = np.arange(1 << 12, dtype=np.uint16)
        _index = index
    return _index


def segment_keys(word: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted indices of the word and its one-bit neighbours, (n, bits + 1), and which are the first of their value."""
    flips = np.concatenate([np.zeros(1, np.uint32), np.uint32(1) << np.arange(bits, dtype=np.uint32)])
    keys = np.sort(golay_index()[word[:, None] ^ flips], axis=1)
    first = np.ones(keys.shape, bool)
    first[:, 1:] = keys[:, 1:] != keys[:, :-1]
    return keys, first


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, positions in fp) for unsigned fingerprints."""
    words = [((fp >> np.uint64(s)) & np.uint64((1 << b) - 1)).astype(np.uint32) for s, b in SEGMENTS]
    all_keys = [segment_keys(w, b) for w, (_, b) in zip(words, SEGMENTS, strict=True)]
    out, rows, kind = [], [], 0
    for a in range(3):
        for b in range(3):
            if a != b:
                keys, first = all_keys[b]
                i, k = np.nonzero(first)
                out.append((kind << 40) | (words[a][i].astype(np.int64) << 12) | keys[i, k])
                rows.append(i)
                kind += 1
    near = []  # for one bit: own index of even words, all of odd ones
    for (keys, first), w in zip(all_keys, words, strict=True):
        even = np.bitwise_count(w) % 2 == 0
        own = golay_index()[w]
        near.append((keys, first & (~even[:, None] | (keys == own[:, None]))))
    for a in range(3):
        for b in range(a + 1, 3):
            (ka, fa), (kb, fb) = near[a], near[b]
            i, k = np.nonzero(fa)
            j, m = np.nonzero(fb[i])
            out.append((kind << 40) | (ka[i[j], k[j]].astype(np.int64) << 12) | kb[i[j], m])
            rows.append(i[j])
            kind += 1
    return np.concatenate(out), np.concatenate(rows)


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = np.asarray(batch.column(0)).astype(np.int64)
        for k in range(0, len(fp), 4096):
            part = fp[k : k + 4096]
            keys, rows = keys_of(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], ["key", "fp"])


def forest(fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of a spanning forest of the fingerprints (unsigned, distinct) that differ in at most BITS bits."""
    links, left = [], fp
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            near = np.bitwise_count(left ^ at) <= BITS
            if near.any():
                found = left[near]
                links.append((np.full(len(found), at), found))
                frontier.extend(found)
                left = left[~near]
    return links


def _link_runs(most: int | None, n_keys: int):
    """Over batches sorted by key: (0, fp, fp) for links, (1, key, fp) for rows of runs longer than `most`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, key, over = 0, None, False
        out: list[tuple[int, np.ndarray, np.ndarray]] = []

        def batch() -> pa.RecordBatch:
            kinds = np.concatenate([np.full(len(a), k, np.int32) for k, a, _ in out])
            cols = [kinds, *(np.concatenate([x[i].view(np.int64) for x in out]) for i in (1, 2))]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["kind", "a", "b"])

        def close() -> None:
            if over:
                return
            fps = np.unique(np.concatenate(held)) if held else np.zeros(0, np.uint64)
            out.extend((0, a, b) for a, b in forest(fps))

        def spill(fps: np.ndarray) -> None:
            out.append((1, np.full(len(fps), key[0], np.int64), fps))

        for rb in batches:
            if not rb.num_rows:
                continue
            ks = np.stack([np.asarray(rb.column(i)).astype(np.int64) for i in range(n_keys)], 1)
            fp = np.asarray(rb.column(n_keys)).astype(np.int64).view(np.uint64)
            cuts = np.flatnonzero(np.any(ks[1:] != ks[:-1], axis=1)) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(fp)]])
            lengths = ends - starts
            inner = (starts > 0) & (ends < len(fp))
            two = starts[inner & (lengths == 2)]  # most runs with more than one row
            near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= BITS]
            near = near[fp[near] != fp[near + 1]]
            if len(near):
                out.append((0, fp[near], fp[near + 1]))
            for s, e in zip(starts[~inner | (lengths > 2)], ends[~inner | (lengths > 2)], strict=True):
                k = tuple(ks[s])
                if k != key:
                    close()
                    held, size, key, over = [], 0, k, False
                size += e - s
                if over:
                    spill(fp[s:e])
                else:
                    held.append(fp[s:e])
                    if most is not None and size > most:
                        over = True
                        for x in held:
                            spill(x)
                        held = []
                if len(out) > 2000 or over and out:
                    yield batch()
        close()
        if out:
            yield batch()

    return run


def links(fps: DataFrame, run: int = RUN) -> DataFrame:
    """(a, b) links between distinct fingerprints (one long column), enough to connect every component."""
    keys = fps.mapInArrow(_emit_keys, "key long, fp long")
    runs = keys.repartition("key").sortWithinPartitions("key")
    found = cut(runs.mapInArrow(_link_runs(run, 1), "kind int, a long, b long"))
    near = found.where("kind = 0").select("a", "b")
    over = found.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    if not over.isEmpty():
        blocks = over.groupBy("key").agg(F.ceil(F.count("*") / run).alias("n"))  # as many rows as long runs: few
        own = F.pmod(F.xxhash64("fp"), F.col("n"))
        pairs = over.join(blocks, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        pairs = pairs.select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "fp")
        pairs = pairs.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
        near = near.union(pairs.mapInArrow(_link_runs(None, 3), "kind int, a long, b long").select("a", "b"))
    return near


def components_of(marked: DataFrame, run: int = RUN) -> DataFrame:
    """(fp, ...) -> (fp, root, n): for each different fingerprint a fingerprint that names its group, and its rows."""
    fps = cut(marked.groupBy("fp").agg(F.count("*").alias("n")))
    roots = components(links(fps.select("fp"), run))
    return fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "n")


def _first_of_group(marked: DataFrame, groups: DataFrame, first: Column, rows: int) -> DataFrame:
    """(fp, n, first): the least `first` of any row of the fingerprint's group."""
    least = marked.groupBy("fp").agg(F.min(first).alias("least"))
    grouped = cut(groups.join(least, "fp"))
    lowest = grouped.groupBy("root").agg(F.min("least").alias("first"), F.count("*").alias("members"))
    return join_counted(grouped.select("fp", "n", "root"), lowest, "root", "members", rows).drop("root")


def near_duplicates(docs: DataFrame, run: int = RUN) -> DataFrame:
    """(doc_id, text) -> (doc_id, fp, component_id): the smallest doc_id that links lead to."""
    marked = cut(docs.select("doc_id", fingerprints(F.col("text")).alias("fp")))
    rows = marked.count()
    named = cut(_first_of_group(marked, components_of(marked, run), F.col("doc_id"), rows))
    return join_counted(marked, named, "fp", "n", rows).select("doc_id", "fp", F.col("first").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """Of every group of near-duplicates the row with the smallest doc_id stays; null ids come last, and rows of one id
    are ordered by a hash of their texts. Of rows alike in both one stays.

    Texts are shuffled once at most: rows to drop are found by id and hash, and only rows that repeat are put together.
    """
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")
    marked = cut(docs.select("doc_id", text_key(F.col("text")).alias("th"), fingerprints(F.col("text")).alias("fp")))
    rows = marked.count()
    named = cut(_first_of_group(marked, components_of(marked), key, rows))
    keys = join_counted(marked, named, "fp", "n", rows).groupBy("doc_id", "th").agg(F.first("first").alias("first"), F.count("*").alias("rows"))
    keys = cut(keys.select(F.col("doc_id").alias("d"), F.col("th").alias("h"), (F.col("first") == key).alias("keep"), "rows"))
    own = whole_rows(docs, "doc_id", "text").select("row", "doc_id", text_key(F.col("text")).alias("th"))
    on = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h"))
    out = own.join(keys.where("not keep").select("d", "h"), on, "left_anti")
    again = keys.where("keep and rows > 1").select("d", "h")
    if not again.isEmpty():
        once = out.join(again, on, "left_semi").groupBy("doc_id", "th").agg(F.first("row").alias("row"))
        out = out.join(again, on, "left_anti").select("row").union(once.select("row"))
    return out.select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
