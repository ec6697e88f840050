"""Alignment of two tokenizers over a corpus, counted by runs on the way.

A text is cut where a space follows anything but white space. Neither tokenizer has a token over such a place, so the units
between the cuts are encoded, aligned and written out once in a task's memory and looked up afterwards. Within a unit, offsets where
tokens of both end cut groups, and each stretch between two neighbouring ends is one link of the tokens over it.

What is counted corpus-wide are pair-document records: (A id, B id, document, times). A task turns about RUN characters of
documents into one run: records sorted side-major, by A id, then B id, as zstd blocks. A run's heads, which are its pairs with the
number of documents of each, are radix-partitioned by the A id; the records stay with the run. For each
radix a k-way heap merge over the blocks of all heads adds up the documents of each pair; since all pairs of an A
id come together, its highest count is known as soon as the id ends, and counts and marks of the best go back to the
runs they came from. Beyond FAN runs the merge takes levels of at most about FAN runs a task, up and down again. Blocks
are held one a run, so a merge's memory does not depend on how often a pair occurs.

Defined cases: texts that are null, empty, or not given back byte by byte by the tokens of either tokenizer have no tokens:
zeros and an empty groups_sha256; every row counts as a document, also if ids repeat or are null; strings of special tokens
are plain text; an empty table gives an empty result; columns but doc_id and text are not read. A text is encoded in one
task, whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetgraph.llm.common import cut, table, text_chunks

#: Where the vocabularies are, on every executor.
TOKENIZERS = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of the documents of a run, about.
RUN = 1 << 21
#: Units that a worker keeps between runs, and their characters.
KEPT_UNITS, KEPT_CHARS = 300_000, 4_000_000
RADIX = 32
#: Runs of a merge, about, and pairs of a block.
FAN, PAIRS = 1024, 8192
#: More than any B id, so that a pair is one number.
SIDE = 1 << 20
# How byte-level vocabularies split texts before merging.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CUT, _ODD = re.compile(r"(?<=\S)(?= )"), re.compile(r"\s ")
DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Bytes of each id."""

    def __init__(self, tokens: list[bytes]):
        self.lengths = np.array([len(t) for t in tokens])
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of tokens, one after another."""
        n = self.lengths[ids]
        return self.bytes[np.repeat(self.offsets[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


@lru_cache(2)
def tokenizers(folder: str):
    """(encode, vocabulary) of A and of B; encode takes units, which begin with a space."""
    import sentencepiece
    import tiktoken

    with open(f"{folder}/{A_FILE}") as f:
        stored = json.load(f)
    letters, special = byte_alphabet(), {t["id"] for t in stored["added_tokens"]}
    ids = {i: t for t, i in stored["model"]["vocab"].items()}
    spelled = {i: bytes(letters[c] for c in t) for i, t in ids.items() if i not in special}
    a = tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks={t: i for i, t in spelled.items()}, special_tokens={})
    b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{B_FILE}")
    byte = re.compile(r"<0x([0-9A-F]{2})>")
    pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
    b_bytes = [bytes([int(m[1], 16)]) if (m := byte.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
    lone = [b.piece_to_id("▁")]  # B puts a space before a text, but none before nothing
    return (
        (lambda units: [a.encode_ordinary(u) for u in units], Vocabulary([spelled.get(i, b"") for i in range(max(ids) + 1)])),
        (lambda units: [x if u != " " else lone for u, x in zip(units, b.encode([u[1:] for u in units], num_threads=1), strict=True)], Vocabulary(b_bytes)),
    )


def units_of(text: str) -> list[str]:
    """A space and the text, cut before every space that does not follow white space."""
    if _ODD.search(text) or text[:1] == " ":
        return _CUT.split(" " + text)
    return [" " + w for w in text.split(" ")]


def flattened(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter((x for one in lists for x in one), np.int64, int(sizes.sum())), sizes


def align(units: list[str], folder: str):
    """Of each unit: (n_a, n_b, n_groups, n_links, whether its tokens give it back), all links one after another, its groups."""
    (encode_a, voc_a), (encode_b, voc_b) = tokenizers(folder)
    (a, n_a), (b, n_b) = flattened(encode_a(units)), flattened(encode_b(units))
    sizes = np.array([len(u.encode()) for u in units])
    unit_a, unit_b = np.repeat(np.arange(len(units)), n_a), np.repeat(np.arange(len(units)), n_b)
    good = np.ones(len(units), bool)
    for voc, ids, of in ((voc_a, a, unit_a), (voc_b, b, unit_b)):
        good &= np.bincount(of, voc.lengths[ids], len(units)).astype(np.int64) == sizes
    good &= sizes > 0
    for voc, ids, of in ((voc_a, a, unit_a), (voc_b, b, unit_b)):
        meant = np.frombuffer("".join(u for u, g in zip(units, good, strict=True) if g).encode(), np.uint8)
        wrong = np.flatnonzero(voc.spelled(ids[good[of]]) != meant)
        fine = np.flatnonzero(good)
        good[fine[np.unique(np.searchsorted(np.cumsum(sizes[fine]), wrong, side="right"))]] = False
    a, b, unit_a, unit_b = a[good[unit_a]], b[good[unit_b]], unit_a[good[unit_a]], unit_b[good[unit_b]]
    end_a, end_b = np.cumsum(voc_a.lengths[a]), np.cumsum(voc_b.lengths[b])
    both = np.intersect1d(end_a, end_b, assume_unique=True)
    last_a, last_b = np.searchsorted(end_a, both), np.searchsorted(end_b, both)  # a group's last tokens
    ends = np.union1d(end_a, end_b)
    link_a, link_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
    count = lambda of: np.bincount(of, minlength=len(units))
    facts = np.stack([count(unit_a), count(unit_b), count(unit_a[last_a]), count(unit_a[link_a]), good], 1)
    # Written out: group by group A's ids, then B's.
    closes_a, closes_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    closes_a[last_a] = closes_b[last_b] = True
    group_a, group_b = np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b
    at_a = np.arange(len(a)) + np.concatenate([[0], last_b + 1])[group_a]
    at_b = np.arange(len(b)) + (last_a + 1)[group_b]
    words = np.empty(len(a) + len(b), object)
    words[at_a] = [f"{i}{'|' if c else ','}" for i, c in zip(a.tolist(), closes_a.tolist(), strict=True)]
    words[at_b] = [f"{i}{';' if c else ','}" for i, c in zip(b.tolist(), closes_b.tolist(), strict=True)]
    stops = np.cumsum(facts[:, 0] + facts[:, 1])
    words, groups, begin = words.tolist(), [], 0
    for stop in stops.tolist():
        groups.append("".join(words[begin:stop])[:-1])
        begin = stop
    return facts, pair_of(a[link_a], b[link_b]), groups


def pair_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A pair as one number: the radix of the A id, the A id, the B id."""
    return ((a % RADIX * SIDE) + a // RADIX) * SIDE + b


class Units:
    """The units a worker knows."""

    def __init__(self, folder: str):
        self.folder = folder
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.facts, self.links, self.chars = np.zeros((0, 5), np.int64), np.zeros(0, np.int64), 0

    def learn(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(units of the texts one after another, how many each has)."""
        if len(self.index) > KEPT_UNITS or self.chars > KEPT_CHARS:
            self.forget()
        known, index = len(self.index), self.index
        cut_up = [units_of(t) if t else [] for t in texts]
        ids = np.array([index.setdefault(u, len(index)) for us in cut_up for u in us], np.int64)
        new = list(index)[known:] if len(index) > known else []
        for k in range(0, len(new), 1 << 15):
            part = new[k : k + (1 << 15)]
            facts, links, groups = align(part, self.folder)
            self.facts, self.links = np.concatenate([self.facts, facts]), np.concatenate([self.links, links])
            self.groups += [g.encode() for g in groups]
            self.chars += sum(map(len, part))
        return ids, np.array([len(us) for us in cut_up], np.int64)


def blocks(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    """Columns of one length as blocks of PAIRS rows: (rows, size) and zstd."""
    z, out = zstandard.ZstdCompressor(level=1), []
    for k in range(0, len(keys), PAIRS):
        part = [np.ascontiguousarray(c[k : k + PAIRS], np.int64) for c in (keys, *columns)]
        first = part[0][:1].copy()
        part[0] = np.diff(part[0], prepend=part[0][:1])
        raw = z.compress(b"".join(x.tobytes() for x in (first, *part)))
        out.append(np.array([len(part[0]), len(raw)], np.int64).tobytes() + raw)
    return b"".join(out)


def read_blocks(blob: bytes) -> Iterator[np.ndarray]:
    """Blocks as (columns, rows)."""
    z, at = zstandard.ZstdDecompressor(), 0
    while at < len(blob):
        n, size = np.frombuffer(blob, np.int64, 2, at)
        raw = np.frombuffer(z.decompress(blob[at + 16 : at + 16 + size]), np.int64)
        out = raw[1:].reshape(-1, n).copy()
        out[0] = raw[0] + np.cumsum(out[0])
        yield out
        at += 16 + int(size)


def all_blocks(blob: bytes, columns: int) -> np.ndarray:
    return np.concatenate([np.zeros((columns, 0), np.int64), *read_blocks(blob)], 1)


def merged(blobs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]]:
    """K-way heap merge of heads: (pairs, documents, [(run, its pairs of these)]), rising.

    The heap holds the last pair of each run's block: up to the smallest of them nothing is missing.
    """
    streams = [read_blocks(b) for b in blobs]
    now: dict[int, np.ndarray] = {}
    heap: list[tuple[int, int]] = []

    def load(r: int) -> None:
        if (block := next(streams[r], None)) is not None:
            now[r] = block
            heapq.heappush(heap, (int(block[0, -1]), r))
        else:
            now.pop(r, None)

    for r in range(len(blobs)):
        load(r)
    while heap:
        bound = heap[0][0]
        parts = []
        for r, block in now.items():
            k = int(np.searchsorted(block[0], bound, side="right"))
            if k:
                parts.append((r, block[:, :k]))
                now[r] = block[:, k:]
        pairs = np.concatenate([p[0] for _, p in parts])
        order = np.argsort(pairs, kind="stable")
        pairs, docs = pairs[order], np.concatenate([p[1] for _, p in parts])[order]
        starts = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
        yield pairs[starts], np.add.reduceat(docs, starts), [(r, p[0]) for r, p in parts]
        while heap and heap[0][0] <= bound:
            load(heapq.heappop(heap)[1])


def with_best(stream) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]]:
    """What merged() yields, A id by A id, with marks of the pairs whose count is their A id's highest."""
    pairs, docs, parts = np.zeros(0, np.int64), np.zeros(0, np.int64), []

    def marked(p: np.ndarray, d: np.ndarray) -> np.ndarray:
        starts = np.flatnonzero(np.concatenate([[True], p[1:] // SIDE != p[:-1] // SIDE]))
        return d == np.repeat(np.maximum.reduceat(d, starts), np.diff(np.append(starts, len(p))))

    for p, d, runs in stream:
        pairs, docs, parts = np.concatenate([pairs, p]), np.concatenate([docs, d]), parts + runs
        whole = pairs[-1] // SIDE * SIDE  # the last A id may go on
        k = int(np.searchsorted(pairs, whole))
        if k:
            split = [(r, x, int(np.searchsorted(x, whole))) for r, x in parts]
            yield pairs[:k], docs[:k], marked(pairs[:k], docs[:k]), [(r, x[:j]) for r, x, j in split if j]
            pairs, docs, parts = pairs[k:], docs[k:], [(r, x[j:]) for r, x, j in split if j < len(x)]
    if len(pairs):
        yield pairs, docs, marked(pairs, docs), parts


def encode(folder: str, run_chars: int):
    """Batches of (doc_id, text) -> runs: documents, records, heads by radix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, number = Units(folder), TaskContext.get().partitionId() << 32
        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, texts in text_chunks(batch.column(1).to_pylist(), run_chars):
                seen, n = units.learn(texts)
                doc = np.repeat(np.arange(len(texts)), n)
                has = np.bincount(doc, units.facts[seen, 4] == 0, len(texts)) == 0  # every unit is given back
                has &= n > 0
                sums = np.stack([np.bincount(doc, units.facts[seen, c], len(texts)).astype(np.int64) * has for c in range(4)], 1)
                stops, hashes, flat = np.cumsum(n), [], seen.tolist()
                for k, (stop, size) in enumerate(zip(stops.tolist(), n.tolist(), strict=True)):
                    hashes.append(hashlib.sha256(b";".join(map(units.groups.__getitem__, flat[stop - size : stop]))).hexdigest() if has[k] else "")
                # (unit, document) once with its times, then its links.
                key, times = np.unique((seen * len(texts) + doc)[has[doc]], return_counts=True)
                unit, doc = key // len(texts), key % len(texts)
                size = units.facts[unit, 3]
                begin = (np.cumsum(units.facts[:, 3]) - units.facts[:, 3])[unit]
                at = np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)
                pairs, pair = np.unique(units.links[at], return_inverse=True)
                record = pair * len(texts) + np.repeat(doc, size)
                order = np.argsort(record, kind="stable")
                record, times = record[order], np.repeat(times, size)[order]
                starts = np.flatnonzero(np.concatenate([[True], record[1:] != record[:-1]])) if len(record) else np.zeros(0, np.int64)
                record, times = record[starts], np.add.reduceat(times, starts) if len(starts) else times
                docs_of = np.bincount(record // len(texts), minlength=len(pairs)).astype(np.int64)
                small = np.uint16 if len(texts) <= 1 << 16 else np.uint32
                many = np.uint8 if times.max(initial=0) < 1 << 8 else np.uint32
                body = z.compress(docs_of.astype(np.uint32).tobytes()), z.compress((record % len(texts)).astype(small).tobytes()), z.compress(times.astype(many).tobytes())
                edges = np.searchsorted(pairs, np.arange(RADIX + 1) * SIDE * SIDE)
                heads = [{"radix": r, "blob": blocks(pairs[s:e], docs_of[s:e])} for r, (s, e) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if e > s]
                docs = [dict(zip(("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"), (ids[first + k], *sums[k].tolist(), h), strict=True)) for k, h in enumerate(hashes)]
                row = {"run": number, "docs": docs, "body": list(body), "kinds": [np.dtype(small).str, np.dtype(many).str], "heads": heads}
                yield pa.RecordBatch.from_pylist([row], schema=RUNS_ARROW)
                number += 1

    return run


RUNS = (
    "run long, docs array<struct<doc_id: long, n_a: long, n_b: long, n_groups: long, n_links: long, groups_sha256: string>>, "
    "body array<binary>, kinds array<string>, heads array<struct<radix: int, blob: binary>>"
)
_DOC_ARROW = pa.struct([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())])
_HEAD_ARROW = pa.struct([("radix", pa.int32()), ("blob", pa.binary())])
RUNS_ARROW = pa.schema([("run", pa.int64()), ("docs", pa.list_(_DOC_ARROW)), ("body", pa.list_(pa.binary())), ("kinds", pa.list_(pa.string())), ("heads", pa.list_(_HEAD_ARROW))])
HEADS = pa.schema([("radix", pa.int32()), ("id", pa.int64()), ("blob", pa.binary())])


def add_up(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """(radix, id, above, blob) of one radix and parent -> the parent's head."""
    out = [(p, d) for p, d, _ in merged(rows["blob"].to_pylist())]
    blob = b"".join(blocks(p, d) for p, d in out)
    return pa.Table.from_pylist([{"radix": key[0].as_py(), "id": key[1].as_py(), "blob": blob}], schema=HEADS)


def counted(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """(radix, id, above, blob), all of one radix -> for each head its pairs with corpus-wide counts and marks of the best."""
    ids, out = rows["id"].to_pylist(), [[] for _ in range(rows.num_rows)]
    for pairs, docs, best, parts in with_best(merged(rows["blob"].to_pylist())):
        for r, own in parts:
            at = np.searchsorted(pairs, own)
            out[r].append(blocks(own, docs[at], best[at]))
    return pa.Table.from_pylist([{"radix": key[0].as_py(), "id": i, "blob": b"".join(o)} for i, o in zip(ids, out, strict=True)], schema=HEADS)


def handed_down(key: tuple[pa.Scalar, ...], parents: pa.Table, rows: pa.Table) -> pa.Table:
    """A parent's counts and marks -> those of the heads it was made of."""
    out = []
    if parents.num_rows:
        pairs, docs, best = all_blocks(parents["blob"][0].as_py(), 3)
        for i, blob in zip(rows["id"].to_pylist(), rows["blob"].to_pylist(), strict=True):
            own = all_blocks(blob, 2)[0]
            at = np.searchsorted(pairs, own)
            out.append({"radix": key[0].as_py(), "id": i, "blob": blocks(own, docs[at], best[at])})
    return pa.Table.from_pylist(out, schema=HEADS)


OUT_ARROW = pa.schema([*_DOC_ARROW, ("n_best", pa.int64()), ("count_sum", pa.int64())])


def summed(_key: tuple[pa.Scalar, ...], runs: pa.Table, counts: pa.Table) -> pa.Table:
    """A run with the counts of its pairs -> its documents."""
    out = []
    for r in runs.to_pylist():
        z, kinds = zstandard.ZstdDecompressor(), ["<u4", *r["kinds"]]
        docs_of, doc, times = (np.frombuffer(z.decompress(b), k).astype(np.int64) for b, k in zip(r["body"], kinds, strict=True))
        by_radix = [all_blocks(x["blob"], 3) for x in sorted(counts.to_pylist(), key=lambda x: x["radix"])]
        _, docs, best = np.concatenate([np.zeros((3, 0), np.int64), *by_radix], 1)
        pair = np.repeat(np.arange(len(docs_of)), docs_of)
        n_best, count_sum = np.zeros(len(r["docs"]), np.int64), np.zeros(len(r["docs"]), np.int64)
        np.add.at(n_best, doc, times * best[pair])
        np.add.at(count_sum, doc, times * docs[pair])
        out += [d | {"n_best": b, "count_sum": s} for d, b, s in zip(r["docs"], n_best.tolist(), count_sum.tolist(), strict=True)]
    return pa.Table.from_pylist(out, schema=OUT_ARROW)


def aligned(docs: DataFrame, folder: str = TOKENIZERS, run_chars: int = RUN, fan: int = FAN) -> DataFrame:
    """(doc_id, text) -> one row a row: tokens, groups, links, and how often the links' pairs occur in the corpus."""
    runs = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode(folder, run_chars), RUNS))
    head, n = "radix int, id long, blob binary", runs.count()
    levels = [runs.select(F.col("run").alias("id"), F.explode("heads").alias("h")).select("h.radix", "id", "h.blob")]
    while n > fan:
        n = -(-2 * n // fan)  # parents; about half of fan below each
        levels[-1] = levels[-1].withColumn("above", F.pmod(F.xxhash64("id"), F.lit(n)))
        levels.append(cut(levels[-1].groupBy("radix", "above").applyInArrow(add_up, head)))
    counts = levels[-1].groupBy("radix").applyInArrow(counted, head)
    for below in levels[-2::-1]:
        parents = counts.withColumnRenamed("id", "above")
        counts = parents.groupBy("radix", "above").cogroup(below.groupBy("radix", "above")).applyInArrow(handed_down, head)
    out = runs.select("run", "docs", "body", "kinds").groupBy("run").cogroup(counts.withColumnRenamed("id", "run").groupBy("run"))
    return out.applyInArrow(summed, f"{DOC}, n_best long, count_sum long")


def query(spark, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"))
