"""The trie of conversation prefixes.

Turns become 128-bit ids of role and text before anything is shuffled, so texts stay where they are read. A conversation
is the bytes of its turn ids, one after another; Spark deals them out in ranges of these bytes and the conversation's
id, so many equal conversations are several shards. A shard is one numpy task: its turn ids become small numbers, rows
are padded to a matrix of WIDTH columns at a time and sorted by lexsort; where a row differs from the one above in a
column, or in any column before it (masks accumulated by "or"), a node starts, and reduceat over the starts sums up every depth from
the deepest to the root.

Nodes that hold a shard's first or last row may go on in other shards. For these the shard gives what it knows of
them along its first and last row; one pass over these paths (two a shard), in order of the shards, keeps a stack of open nodes and
closes a node once a path leaves it. Nodes below them get their parent's smallest member by a join.

Defined cases: a null role or text counts as empty; rows of one turn follow each other by role and the text's hash; repeated
rows are turns of their own; rows without a conv_id take no part; c % 100 has the sign of c; a conversation whose turns are
all replaced by those of an absent one is a member of the root only; an empty table gives no node; columns but conv_id,
turn, role and text are not read. A conversation is a row of 24 bytes a turn, so it must fit in a task; the members that
end at one node are hashed in order of their ids, which no method can split, so their ids pass through the one task in
pieces of PIECE.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetgraph.llm.common import cut, join_counted, table

#: Bytes of a turn's id, and columns of a padded matrix.
ID, WIDTH = 16, 16
#: Turns of a shard, about.
SHARD = 500_000
#: Ids in one piece of what a shard's open node hashes.
PIECE = 50_000
#: Conversations of one family share up to SHARED - 1 turns of their first one, FAMILY ids apart.
FAMILY, SHARED = 100, 6
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: side: 0 for a node, 1 and 2 for the paths of a shard's first and last row, and depth and piece for ids that end at an open node.
SHARDS = f"{NODE}, parent_key binary, key binary, side int, path binary, sums array<long>, piece long"
SUMS = ("n", "low", "children", "leaves", "saved", "chars", "ends")


def turn_id(role: Column, text: Column) -> Column:
    """128 bits of role and text; null counts as empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(" "), role, text).cast("binary")))


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> (conv_id, turns): each conversation's turns in order, as (id, chars)."""
    rows = turns.where("conv_id is not null").select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), turn_id(F.col("role"), F.col("text")).alias("id"), F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("chars")).alias("t"))
    kept = F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["id"].alias("id"), t["chars"].alias("chars")))  # nulls first
    return rows.groupBy("conv_id").agg(kept.alias("turns"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """Each conversation begins with some turns of its family's first one: `h` of them, by the hash of its id."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("int")
    first = convs.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("f"), F.slice("turns", 1, SHARED - 1).alias("begin"))
    joined = convs.join(first, F.col("conv_id") - F.col("conv_id") % FAMILY == F.col("f"), "left")
    begin = F.when(h > 0, F.slice(F.coalesce("begin", F.array().cast(convs.schema["turns"].dataType)), 1, h)).otherwise(F.array().cast(convs.schema["turns"].dataType))
    rest = F.filter("turns", lambda _, i: i >= h)
    return joined.select("conv_id", F.concat(begin, rest).alias("turns"))


def small_numbers(ids: np.ndarray) -> np.ndarray:
    """ids (n, 2) big-endian halves -> numbers from 1 in the order of the ids."""
    order = np.lexsort((ids[:, 1], ids[:, 0]))
    new = np.ones(len(ids), bool)
    new[1:] = np.any(ids[order[1:]] != ids[order[:-1]], axis=1)
    out = np.empty(len(ids), np.int64)
    out[order] = np.cumsum(new)
    return out


def padded(codes: np.ndarray, begins: np.ndarray, lengths: np.ndarray, rows: np.ndarray, at: int) -> np.ndarray:
    """WIDTH columns from column `at` of the rows' codes, zero beyond a row's end."""
    left = np.clip(lengths[rows] - at, 0, WIDTH)
    out = np.zeros((len(rows), WIDTH), codes.dtype)
    inside = np.arange(WIDTH)[None, :] < left[:, None]
    i, j = np.nonzero(inside)
    out[i, j] = codes[begins[rows][i] + at + j]
    return out


def sorted_rows(codes: np.ndarray, begins: np.ndarray, lengths: np.ndarray, convs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of their turns and then of conv_id, and how many first turns each has in common with the one above.

    Only rows that agree with a neighbour in all columns so far go on to the next WIDTH columns.
    """
    n = len(convs)
    order, common, at = np.argsort(convs, kind="stable"), np.full(n, -1), 0
    runs = np.zeros(n, np.int64)  # of rows at each place of `order`: the place where rows alike so far begin
    places = np.arange(n)  # which are still to be sorted
    while len(places):
        rows = order[places]
        m = padded(codes, begins, lengths, rows, at)
        by = np.lexsort((convs[rows], lengths[rows] > at + WIDTH, *m.T[::-1], runs[places]))  # of equal columns, rows that end come first
        rows, m = rows[by], m[by]
        order[places] = rows
        differs = np.logical_or.accumulate(m[1:] != m[:-1], axis=1)  # node starts, column by column
        alike = runs[places][1:] == runs[places][:-1]
        equal = np.minimum((~differs).sum(1), np.maximum(0, np.minimum(lengths[rows[1:]], lengths[rows[:-1]]) - at))
        common[places[1:][alike]] = at + equal[alike]
        full = alike & ~differs[:, -1] & (lengths[rows[1:]] > at + WIDTH) & (lengths[rows[:-1]] > at + WIDTH)
        begin = ~np.concatenate([[False], full])
        goes_on = np.concatenate([full, [False]]) | ~begin
        new_runs = places[np.maximum.accumulate(np.where(begin, np.arange(len(places)), 0))]
        runs[places] = new_runs
        places, at = places[goes_on], at + WIDTH
    common[0] = -1
    return order, common


def keys_along(path: bytes) -> list[bytes]:
    """Names of the nodes along a path, from the root: hashes of their turns' ids."""
    h = hashlib.md5()
    out = [h.digest()]
    for k in range(0, len(path), ID):
        h.update(path[k : k + ID])
        out.append(h.digest())
    return out


class Shard:
    """Sums of the nodes of one shard."""

    def __init__(self, convs: np.ndarray, flat: bytes | memoryview, chars: np.ndarray, lengths: np.ndarray):
        begins = np.cumsum(lengths) - lengths
        halves = np.frombuffer(flat, ">u8").reshape(-1, 2).astype(np.uint64)
        order, self.common = sorted_rows(small_numbers(halves), begins, lengths, convs)
        self.convs, self.lengths, self.begins, self.chars, self.flat = convs[order], lengths[order], begins[order], chars, flat

    def path(self, row: int) -> bytes:
        return bytes(self.flat[self.begins[row] * ID : (self.begins[row] + self.lengths[row]) * ID])

    def nodes(self):
        """By depth from the deepest: (depth, first rows, sums, open; then the parents' smallest members, first rows, open)."""
        n = len(self.convs)
        leaves, saved, count = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        below: tuple | None = None
        by_length = np.argsort(self.lengths, kind="stable")
        cuts = np.searchsorted(self.lengths[by_length], np.arange(self.lengths.max() + 1))
        for d in range(int(self.lengths.max()), -1, -1):
            rows = np.sort(by_length[cuts[d] :])  # all rows of at least d turns; those of a node stand together
            starts = np.flatnonzero(self.common[rows] < d)
            first, ends = rows[starts], np.append(starts[1:], len(rows))
            s = {"n": ends - starts, "low": np.minimum.reduceat(self.convs[rows], starts)}
            s |= {k: np.add.reduceat(v[rows], starts) for k, v in (("children", count), ("leaves", leaves), ("saved", saved))}
            s["chars"] = self.chars[self.begins[first] + d - 1] if d else np.zeros(1, np.int64)
            s["ends"] = np.add.reduceat((self.lengths[rows] == d).astype(np.int64), starts)
            open_ = (first == 0) | (rows[ends - 1] == n - 1)
            if below is not None:
                b_depth, b_first, b_sums, b_open = below
                up = np.searchsorted(first, b_first, side="right") - 1
                yield b_depth, b_first, b_sums, b_open, s["low"][up], first[up], open_[up]
            leaves[rows] = saved[rows] = count[rows] = 0
            shut = ~open_
            s["leaves"] = np.where(shut & (s["children"] == 0), 1, s["leaves"])
            s["saved"] = s["saved"] + np.where(shut, (s["n"] - 1) * s["chars"], 0)
            at = first[shut]
            leaves[at], saved[at], count[at] = s["leaves"][shut], s["saved"][shut], 1
            below = d, first, s, open_
        yield *below, None, None, None


def joined_ids(convs: np.ndarray) -> str:
    return ",".join(map(str, convs.tolist()))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


NO_ENDS = sha("")


def batch(columns: dict, n: int, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if columns.get(f.name) is not None else pa.nulls(n, f.type) for f in schema], schema=schema)


def arrow_schema(spark_ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(a, kinds[b]) for a, b in (x.split(" ") for x in spark_ddl.split(", "))])


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, conv_id, ids, chars) of one shard -> rows of SHARDS and the shard's number."""
    schema = arrow_schema(f"{SHARDS}, shard long")
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    t = pa.Table.from_batches(parts)
    number = t.column(0)[0].as_py()
    # Offsets of long, as a shard's bytes may pass 2 GiB if one conversation is very long.
    ids, chars = t.column(2).cast(pa.large_binary()).combine_chunks(), t.column(3).cast(pa.large_list(pa.int64())).combine_chunks()
    lengths = np.asarray(pc.binary_length(ids)) // ID
    flat = np.frombuffer(ids.buffers()[2], np.uint8)[np.frombuffer(ids.buffers()[1], np.int64)[ids.offset] :] if lengths.sum() else np.zeros(0, np.uint8)
    s = Shard(np.asarray(t.column(1)), memoryview(flat[: int(lengths.sum()) * ID]), np.asarray(chars.flatten()), lengths.astype(np.int64))
    ends = (0, len(s.convs) - 1)
    paths = [s.path(r) for r in ends]
    keys = [keys_along(p) for p in paths]
    along = [[[0] * len(SUMS) for _ in k] for k in keys]  # sums of open nodes; those both rows share stand in the first
    open_ends = []
    for depth, first, sums, open_, low, up_first, up_open in s.nodes():
        for i in np.flatnonzero(open_):
            side = 0 if first[i] == 0 else 1
            along[side][depth] = [int(sums[k][i]) for k in SUMS]
            if sums["ends"][i]:
                open_ends.append((side, depth, int(first[i]), int(sums["ends"][i])))
        shut = np.flatnonzero(~open_)
        for k in range(0, len(shut), 1 << 16):
            at = shut[k : k + (1 << 16)]
            n_ends = sums["ends"][at]
            hashes = [sha(joined_ids(s.convs[a : a + e])) if e else NO_ENDS for a, e in zip(first[at].tolist(), n_ends.tolist(), strict=True)]
            parent_open, holds_first = up_open[at], up_first[at] == 0
            parent_key = [keys[0 if f else 1][depth - 1] if o else None for o, f in zip(parent_open.tolist(), holds_first.tolist(), strict=True)]
            cols = {"conv_id": sums["low"][at], "depth": np.full(len(at), depth), "parent_conv_id": pa.array(low[at], mask=parent_open), "n_convs": sums["n"][at], "n_children": sums["children"][at], "n_leaves": sums["leaves"][at], "saved_tokens": sums["saved"][at], "ends_sha256": hashes, "parent_key": parent_key, "side": np.zeros(len(at)), "shard": np.full(len(at), number)}
            yield batch(cols, len(at), schema)
    for side in (0, 1):
        yield batch({"side": [side + 1], "path": [paths[side]], "sums": [[x for row in along[side] for x in row]], "shard": [number], "depth": [0], "piece": [-1]}, 1, schema)
    for side, depth, at, n in open_ends:
        for k in range(0, n, PIECE):
            yield batch({"side": [side + 1], "depth": [depth], "piece": [k // PIECE], "ends_sha256": [joined_ids(s.convs[at + k : at + min(n, k + PIECE)])], "shard": [number]}, 1, schema)


class Open:
    """A node of the stack."""

    def __init__(self, key: bytes):
        self.key, self.n, self.low, self.children, self.leaves, self.saved, self.chars, self.hash, self.any = key, 0, None, 0, 0, 0, 0, hashlib.sha256(), False

    def add(self, n: int, low: int, children: int, leaves: int, saved: int, chars: int, _ends: int) -> None:
        if n:
            self.low = low if self.low is None else min(low, self.low)
            self.n, self.children, self.leaves, self.saved, self.chars = self.n + n, self.children + children, self.leaves + leaves, self.saved + saved, chars

    def end(self, ids: str) -> None:
        self.hash.update((("," if self.any else "") + ids).encode())
        self.any = True


def recombined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths and pieces in the order of shards -> the nodes they hold."""
    schema = arrow_schema(f"{NODE}, parent_key binary, key binary")
    stack: list[Open] = []
    path = b""
    done: list[dict] = []

    def close(depth: int) -> None:
        while len(stack) > depth:
            x = stack.pop()
            leaves, saved = x.leaves + (x.children == 0), x.saved + (x.n - 1) * x.chars
            if stack:
                stack[-1].children, stack[-1].leaves, stack[-1].saved = stack[-1].children + 1, stack[-1].leaves + leaves, stack[-1].saved + saved
            done.append({"conv_id": x.low, "depth": len(stack), "n_convs": x.n, "n_children": x.children, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": x.hash.hexdigest(), "parent_key": stack[-1].key if stack else None, "key": x.key})

    def made() -> Iterator[pa.RecordBatch]:
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=schema)
            done.clear()

    for b in batches:
        for r in b.to_pylist():
            if r["piece"] >= 0:
                stack[r["depth"]].end(r["ends_sha256"])
                continue
            new, k = r["path"], 0
            most = min(len(new), len(path))
            while k < most and new[k : k + ID] == path[k : k + ID]:
                k += ID
            if stack:
                close(k // ID + 1)
            path = new
            keys = keys_along(path)
            stack.extend(Open(key) for key in keys[len(stack) :])
            for depth, x in enumerate(stack):
                x.add(*r["sums"][depth * len(SUMS) : (depth + 1) * len(SUMS)])
        yield from made()
    close(0)
    yield from made()


def trie(convs: DataFrame, shard: int = SHARD) -> DataFrame:
    """(conv_id, turns: array of (id, chars)), one row a conversation -> one row a node."""
    spark = convs.sparkSession
    ids = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), ""))
    flat = cut(convs.select("conv_id", ids.alias("ids"), F.col("turns.chars").alias("chars")))
    turns = flat.agg(F.sum(F.size("chars") + 1)).first()[0] or 0
    n = max(spark.sparkContext.defaultParallelism, -(-turns // shard))
    dealt = flat.repartitionByRange(n, "ids", "conv_id").select(F.spark_partition_id().cast("long").alias("shard"), "conv_id", "ids", "chars")
    found = cut(dealt.mapInArrow(shards, f"{SHARDS}, shard long"))
    names = arrow_schema(NODE).names
    edges = found.where("side > 0").select("shard", "side", "piece", "depth", "path", "sums", "ends_sha256")
    top = cut(edges.repartition(1).sortWithinPartitions("shard", "side", "piece", "depth").mapInArrow(recombined, f"{NODE}, parent_key binary, key binary"))
    whole = found.where("side = 0").select(*names, "parent_key").unionByName(top.select(*names, "parent_key"))
    below = whole.where("parent_key is not null")
    counted = below.groupBy("parent_key").agg(F.count("*").alias("below"))
    parents = top.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent")).join(counted, "parent_key")
    named = join_counted(below, cut(parents), "parent_key", "below", below.count())
    named = named.withColumn("parent_conv_id", F.col("parent")).select(*names)
    return whole.where("parent_key is null").select(*names).union(named)


def query(spark, sf_dir: str) -> DataFrame:
    return trie(rebuilt(sequences(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))))


_CRC = "xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"
ORACLE = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, length(coalesce(text, '')) AS chars,
    md5(length(coalesce(role, '')) || ' ' || coalesce(role, '') || coalesce(text, '')) AS id FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({{'id': id, 'chars': chars}} ORDER BY turn NULLS FIRST, role, id) AS turns, (any_value({_CRC}) % {SHARED})::BIGINT AS h FROM t GROUP BY conv_id),
r AS (SELECT c.conv_id, list_concat(list_slice(coalesce(f.turns, []), 1, c.h), list_slice(c.turns, c.h + 1, len(c.turns))) AS turns
  FROM c LEFT JOIN c f ON f.conv_id = c.conv_id - c.conv_id % {FAMILY}),
p AS (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS depth FROM r),
m AS (SELECT conv_id, depth, array_to_string(list_transform(list_slice(turns, 1, depth), lambda x: x.id), '') AS path,
  CASE depth WHEN 0 THEN 0 ELSE turns[depth].chars END AS chars, depth = len(turns) AS last FROM p),
n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM m GROUP BY path, depth),
k AS (SELECT left(path, 32 * (depth - 1)) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
u AS (SELECT n.path, n.depth, (n_convs - 1) * chars AS saved, (k.path IS NULL)::BIGINT AS leaf FROM n LEFT JOIN k ON k.path = n.path),
s AS (SELECT left(path, 32 * d) AS path, sum(saved)::BIGINT AS saved_tokens, sum(leaf)::BIGINT AS n_leaves FROM (SELECT *, unnest(range(depth + 1)) AS d FROM u) GROUP BY 1)
SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM n JOIN s ON s.path = n.path LEFT JOIN k ON k.path = n.path LEFT JOIN n q ON n.depth > 0 AND q.path = left(n.path, 32 * (n.depth - 1)) AND q.depth = n.depth - 1
"""
