"""Prefix tries, cross-tokenizer alignment and spherical caps against brute force."""

import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict
from itertools import pairwise

import duckdb
import numpy as np
import pytest

from sheetgraph.llm import align, caps, trie
from sheetgraph.llm.graph import components

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
needs_tokenizers = pytest.mark.skipif(not os.path.isdir(align.TOKENIZERS), reason="no vocabularies")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def brute_trie(seqs):
    """{conv_id: [(turn, chars)]} -> rows of the nodes."""
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    out = []
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        parents = {q[:-1] for q in members if q}
        ends = sorted(c for c in cs if len(seqs[c]) == len(p))
        saved = sum((len(members[q]) - 1) * (q[-1][1] if q else 0) for q in below)
        leaves = sum(q not in parents for q in below)
        children = sum(len(q) == len(p) + 1 for q in below)
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), children, leaves, saved, sha(",".join(map(str, ends)))))
    return sorted(out, key=repr)


def brute_rebuilt(turns):
    """(conv_id, turn, role, text) -> {conv_id: [(turn, chars)]}."""
    own = defaultdict(list)
    for c, t, r, x in turns:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", hashlib.md5(f"{len(r or '')} {r or ''}{x or ''}".encode()).digest(), x or ""))
    seqs = {c: [((r, x), len(x)) for *_, r, _, x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, s in seqs.items():
        h = zlib.crc32(str(c).encode()) % 6
        rest = abs(c) % 100 * (1 if c >= 0 else -1)
        out[c] = seqs.get(c - rest, [])[:h] + s[h:]
    return out


def test_trie(spark):
    rng = random.Random(4)
    texts = ["a", "b", "é\U0001f600", "", None, "longer text", "a\nb"]
    turns = []
    for c in [*range(0, 260), 1000, 1001, 5000, 5099, -1, -100, -150]:
        for t in range(rng.choice([1, 2, 3, 6, 9])):
            turns.append((c, rng.choice([t, t, t, None, 3]), rng.choice(["user", "assistant", None]), rng.choice(texts)))
    turns += [(77, 1, "user", "a")] * 3 + [(None, 1, "user", "a")]
    turns += [(c, t, "user", str(t)) for c in (600, 601, 650) for t in range(40)]  # beyond one matrix
    turns += [(c, 0, "user", "same") for c in range(2000, 2100)]
    df = spark.createDataFrame([(*r, 1) for r in turns], "conv_id long, turn long, role string, text string, depth int")
    convs = trie.rebuilt(trie.sequences(df))
    want = brute_trie(brute_rebuilt(turns))
    for shard in (trie.SHARD, 40):
        assert sorted((tuple(r) for r in trie.trie(convs, shard).collect()), key=repr) == want
    assert trie.trie(convs.limit(0)).count() == 0


def test_trie_of_a_turnless_conversation(spark):
    """A conversation of the hash's turns or fewer, in a family without a first one, is a member of the root only."""
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 2)
    df = spark.createDataFrame([(c, 0, "user", "a"), (c, 1, "user", "b")], "conv_id long, turn long, role string, text string")
    assert rows(trie.trie(trie.rebuilt(trie.sequences(df)))) == [(c, 0, None, 1, 0, 1, 0, sha(str(c)))]


def test_pieces_of_ends(spark, monkeypatch):
    """Ids that end at an open node are hashed in pieces, over shards."""
    monkeypatch.setattr(trie, "PIECE", 7)
    df = spark.createDataFrame([(c, [(b"0" * 16, 3)]) for c in range(500)], "conv_id long, turns array<struct<id: binary, chars: long>>")
    ends = ",".join(map(str, range(500)))
    assert rows(trie.trie(df, 50)) == [(0, 0, None, 500, 1, 1, 499 * 3, sha("")), (0, 1, 0, 500, 0, 1, 499 * 3, sha(ends))]


def test_sorted_rows():
    rng = np.random.default_rng(3)
    for width in (1, 2, 16):
        lengths = rng.choice([0, 1, 2, 3, 20, 33], 300)
        codes = rng.integers(1, 3, lengths.sum()).astype(np.int64)
        codes[rng.random(len(codes)) < 0.9] = 1
        begins, convs = np.cumsum(lengths) - lengths, rng.permutation(300)
        before, trie.WIDTH = trie.WIDTH, width
        order, common = trie.sorted_rows(codes, begins, lengths, convs)
        trie.WIDTH = before
        seq = [(tuple(codes[b : b + n]), c) for b, n, c in zip(begins, lengths, convs, strict=True)]
        assert [seq[i] for i in order] == sorted(seq)
        for (i, j), k in zip(pairwise(order), common[1:], strict=True):
            a, b = seq[i][0], seq[j][0]
            assert k == next((x for x in range(min(len(a), len(b))) if a[x] != b[x]), min(len(a), len(b)))


@needs_tables
@pytest.mark.parametrize("module", [trie, caps])
def test_against_sql(spark, module):
    c = duckdb.connect()
    for t in ("conversations", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.sql(module.ORACLE)
    got = module.query(spark, SF).select(*want.columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))


def brute_alignment(texts):
    """Rows of documents by tokens of whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{align.TOKENIZERS}/{align.A_FILE}")
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=f"{align.TOKENIZERS}/{align.B_FILE}")
    letters = align.byte_alphabet()
    out, linked = [], []
    for text in texts:
        ta, tb = [], []
        if text:
            ta = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
            for i in b.encode(text):
                p = b.id_to_piece(i)
                tb.append((i, bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()))
            if any(b"".join(x for _, x in t) != (" " + text).encode() for t in (ta, tb)):
                ta, tb = [], []
        spans = []
        for t in (ta, tb):
            ends = np.cumsum([len(x) for _, x in t]).tolist()
            spans.append([(i, s, e) for (i, _), s, e in zip(t, [0, *ends], ends, strict=False)])
        links = [(x, y) for x, s, e in spans[0] for y, u, v in spans[1] if max(s, u) < min(e, v)]
        cuts = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups = [[[str(i) for i, s, e in side if lo <= s and e <= hi] for side in spans] for lo, hi in zip([0, *cuts], cuts, strict=False)]
        said = ";".join(",".join(x) + "|" + ",".join(y) for x, y in groups)
        out.append((len(ta), len(tb), len(groups), len(links), sha(said) if ta else ""))
        linked.append(links)
    count = Counter(p for links in linked for p in set(links))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return [(*o, sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links)) for o, links in zip(out, linked, strict=True)]


ODD = [" ", "  ", "\n", "\t", "a", "B", "é", "▁", "'s", "’", "12", "<s>", "</s>", "<|endoftext|>", "<0x41>", " ", "　", "👍", "\x1c", "\x85", "é", "ﬁ", "\r", "word", " the", "the "]


@needs_tokenizers
@pytest.mark.parametrize("run,fan", [(align.RUN, align.FAN), (200, 4)])
def test_alignment(spark, run, fan, monkeypatch):
    """Small runs and fans take several levels up and down; small blocks cut heads."""
    monkeypatch.setattr(align, "PAIRS", 16)
    rng = random.Random(8)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randrange(25))) for _ in range(150)]
    texts += [None, "", " ", "  ", "The cat sat on the mat.", "The cat sat on the mat.", "word " * 300, "x" * 3000, "internationalisation " * 3]
    df = spark.createDataFrame([(i % 150 or None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, radix int").repartition(3)
    got = rows(align.aligned(df, run_chars=run, fan=fan).selectExpr("coalesce(doc_id, -1)", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"))
    assert got == sorted((i % 150 or -1, *r) for i, r in enumerate(brute_alignment(texts)))
    assert align.aligned(df.limit(0)).count() == 0


@needs_tokenizers
@needs_tables
def test_alignment_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = [(r["doc_id"], r["text"]) for r in docs.orderBy("n_chars").limit(60).collect()]
    got = rows(align.aligned(spark.createDataFrame(some, "doc_id long, text string")).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"))
    assert got == sorted((i, *r) for (i, _), r in zip(some, brute_alignment([t for _, t in some]), strict=True))


@needs_tokenizers
def test_units_are_forgotten(monkeypatch):
    monkeypatch.setattr(align, "KEPT_UNITS", 3)
    u = align.Units(align.TOKENIZERS)
    for text in ("one two three four", "five six", "one two"):
        ids, n = u.learn([text])
        assert n.tolist() == [len(text.split())] and all(u.facts[i, 4] for i in ids)
    assert len(u.index) == 4  # forgotten once, before the second run


def test_merge_of_heads(monkeypatch):
    monkeypatch.setattr(align, "PAIRS", 5)
    rng = np.random.default_rng(6)
    runs = [np.unique(rng.integers(0, 60, 40)) for _ in range(9)]
    keys = [align.pair_of(r // 10, r % 10) for r in runs]
    keys = [np.sort(k) for k in keys]
    want = Counter(int(k) for ks in keys for k in ks)
    top = defaultdict(int)
    for k, n in want.items():
        top[k // align.SIDE] = max(top[k // align.SIDE], n)
    got = {}
    for pairs, docs, best, parts in align.with_best(align.merged([align.blocks(k, np.ones(len(k), np.int64)) for k in keys])):
        assert sorted(np.concatenate([p for _, p in parts]).tolist()) == sorted(k for p in pairs.tolist() for k in [p] * want[p])
        got |= {p: (n, b) for p, n, b in zip(pairs.tolist(), docs.tolist(), best.tolist(), strict=True)}
    assert got == {k: (n, n == top[k // align.SIDE]) for k, n in want.items()}


def test_decoded_filters():
    """Decoding lists exactly the directions that reach the threshold."""
    rng = np.random.default_rng(1)
    code = caps.Code(dims=10, words=9, threshold=1.5, repeats=2)
    x = caps.unit_rows(rng.standard_normal(70), np.full(7, 10), 10)
    for repeat in range(2):
        d = caps.Decoder(code, repeat)
        turned = d.rotated(x)
        assert np.allclose((turned * turned).sum(1), 1) and np.allclose(turned @ turned.T, x @ x.T)
        want = set()
        for i, v in enumerate(turned.reshape(7, 2, -1)):
            for a in range(9):
                for b in range(9):
                    if v[0] @ d.books[0][:, a] + v[1] @ d.books[1][:, b] >= 1.5:
                        want.add((i, d.first + 9 * a + b))
        got = list(zip(*(x.tolist() for x in d.filters(x)), strict=True))
        assert len(got) == len(set(got)) and set(got) == want


def planted(rng, n, dims):
    """Vectors, groups of near ones and copies among them."""
    x = rng.standard_normal((n, dims))
    for i in range(0, n // 2, 5):
        for k in range(1, 5):
            x[i + k] = x[i] / np.linalg.norm(x[i]) + rng.standard_normal(dims) * rng.uniform(0.01, 0.6) / np.sqrt(dims)
    x[n // 2 : n // 2 + 60] = x[n // 2] / np.linalg.norm(x[n // 2]) + rng.standard_normal((60, dims)) * 0.2 / np.sqrt(dims)
    x[n - 20 :] = x[n - 20]
    return x


def brute_links(x):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= caps.COSINE
    np.fill_diagonal(near, False)
    return near


@pytest.mark.parametrize("block", [caps.BLOCK, 8])
def test_caps(spark, block):
    """block = 8 splits every larger filter into pairs of blocks."""
    rng = np.random.default_rng(9)
    x = planted(rng, 600, 24)
    df = spark.createDataFrame([(i, [float(v) for v in r], 1) for i, r in enumerate(x)], "vec_id long, embedding array<double>, node int").repartition(3)
    got = {r["vec_id"]: r for r in caps.near_duplicates(df, block=block).collect()}
    near = brute_links(x)
    n = np.array([got[i]["n_links"] for i in range(600)])
    assert (n <= near.sum(1)).all() and n.sum() >= 0.98 * near.sum()
    for i in range(600):
        c = got[i]["component_id"]
        assert got[i]["kept"] == (i == c) and c <= i
        assert {got[int(j)]["component_id"] for j in np.flatnonzero(near[i])} <= {c} or n[i] < near[i].sum()


def test_recall_of_caps():
    """Pairs at exactly the least cosine share a filter nearly always, at every size."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((600, 48))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = rng.standard_normal((600, 48))
    z -= (z * x).sum(1)[:, None] * x
    y = caps.COSINE * x + np.sqrt(1 - caps.COSINE**2) * z / np.linalg.norm(z, axis=1)[:, None]
    for n in (500, 50_000, 3_000_000):
        code, hit = caps.code_for(n, 48), np.zeros(600, bool)
        for r in range(code.repeats):
            d = caps.Decoder(code, r)
            a, b = (set(zip(*(v.tolist() for v in d.filters(w)), strict=True)) for w in (x, y))
            hit[[i for i, _ in a & b]] = True
        assert hit.mean() >= 0.97


def test_caps_of_odd_vectors(spark):
    v = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [None, 1.0]), (9, [float("inf"), 0.0])]
    v += [(None, [1.0, 0.01]), (None, [0.0, 5.0]), (10, [0.0, -1.0]), (11, [1e-200, 1e-200]), (12, [1e200, 1e200]), (10, [0.0, -1.0]), (10, [-1.0, 0.0]), (13, [-0.0, 0.0])]
    got = sorted(map(repr, map(tuple, caps.near_duplicates(spark.createDataFrame(v, "vec_id long, embedding array<double>")).collect())))
    want = [(i, 3, 1, i == 1) for i in (1, 2, 3)] + [(None, 3, 1, False)] + [(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 13)]
    want += [(None, 0, None, True), (11, 1, 11, True), (12, 1, 11, False)] + [(10, 1, 10, True)] * 2 + [(10, 0, 10, True)]
    assert got == sorted(map(repr, want))
    nothing = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert caps.near_duplicates(nothing).count() == 0


def test_components_of_a_star(spark, monkeypatch):
    """A hub of many links and a component of many nodes are hot keys."""
    from sheetgraph.llm import common

    monkeypatch.setattr(common, "HOT_LEAST", 10)
    edges = spark.createDataFrame([(7, 100 + i) for i in range(60)] + [(100 + i, 1000 + i) for i in range(60)] + [(1, 2)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert set(got.values()) == {1, 7} and got[1059] == 7 and got[2] == 1 and len(got) == 123
    assert components(edges.limit(0)).count() == 0
