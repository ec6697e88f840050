"""SimHash groups, decontamination and top-k search against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sheetgraph.llm import decontam, simhash, topk
from sheetgraph.llm.graph import components


def slow_fingerprint(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint():
    for t in (None, "", " \t\n", "one", "One two three", "a b c d", "a b c d e f g " * 9, "é ü ß x y z " * 40):
        assert simhash.fingerprint(t) == slow_fingerprint(t)


def test_golay_code():
    index = simhash.golay_index()
    assert len(index) == 1 << 23 and np.bincount(index).tolist() == [2048] * 4096  # perfect


def test_close_fingerprints_share_a_key():
    rng = random.Random(1)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 4)):
            b ^= 1 << bit
        keys, rows = simhash.keys_of(np.array([a, b], np.uint64))
        assert set(keys[rows == 0]) & set(keys[rows == 1])


def brute_components(fps):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("run", [simhash.RUN, 3])
def test_near_duplicates(spark, run, monkeypatch):
    """run = 3 sends nearly every run of keys through the split into blocks."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(150)]
        for k in range(rng.choice([1, 2, 6])):
            t = list(base)
            for _ in range(k % 3):
                t[rng.randrange(len(t))] = "changed"
            rows.append((100 * g + k, " ".join(t)))
    rows += [(5000, None), (5001, ""), (5002, "   "), (5003, "one word"), (5003, "one word")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), run).collect()
    want = brute_components({i: simhash.fingerprint(t) for i, t in rows})
    assert len(got) == len(rows)
    assert all(r["component_id"] == want[r["doc_id"]] for r in got)
    kept = simhash.keep_one(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int"))
    assert kept.columns == ["doc_id", "text", "fp"]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def test_near_duplicates_of_nothing(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def passage(rng, n):
    return [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.randrange(500)}" for _ in range(n)]


def test_decontamination(spark):
    rng = random.Random(3)
    items = [passage(rng, 40), passage(rng, 20), passage(rng, 15), passage(rng, 6)]
    clean = passage(rng, 300)
    swapped = list(items[0])
    for i in (7, 15, 23, 31):
        swapped[i] = "swapped"
    half = [w if i % 2 else f"x{i}" for i, w in enumerate(items[0])]
    docs = [
        (1, " ".join(clean[:50] + items[0] + clean[50:])), (2, " ".join(clean[:80] + swapped + clean[80:])), (3, " ".join(clean)), (4, " ".join(clean[:20] + half + clean[20:])),
        (5, " ".join(w.upper() + "," for w in clean[:9] + items[1])), (6, None), (7, ""), (8, " ".join(items[0][:9] + clean)), (9, " ".join(items[3] + clean)), (1, " ".join(clean)),
    ]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, tokens string")
    b = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(9, None), (10, "")], "item_id long, text string")
    got = {r["doc_id"]: (r["item_ids"], r["n_tokens"]) for r in decontam.report(d, b).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: [0], 2: [0], 5: [1], 9: [3]}
    assert got[1][1] == 40 and got[2][1] == 40
    kept = decontam.clean(d, b)
    assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 6, 7, 8]  # the other row of id 1 is clean
    assert decontam.report(d.limit(0), b).count() == 0 and decontam.report(d, b.limit(0)).count() == 0


def test_stretches_reach_their_ends():
    """Runs of 1,000 equal tokens count whole; substitutions as far as the similarity allows; brute force on random runs."""
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 60, 1000).astype(np.uint64)
    assert decontam.agrees(a, a.copy(), 0, 500) == 1000 and decontam.agrees(a, a[200:900], 200, 0) == 700
    b = a.copy()
    b[5::10] = 7
    assert decontam.agrees(a, b, 0, 300) == 1000
    for _ in range(300):
        n = int(rng.integers(13, 60))
        x = rng.integers(0, 1 << 60, n).astype(np.uint64)
        y = np.where(rng.random(n) < rng.choice([0.1, 0.3, 0.5]), np.uint64(1), x)
        at = int(rng.integers(0, n))
        same = x == y
        best = 0
        for i in np.flatnonzero(same):
            for j in np.flatnonzero(same):
                if i <= at + decontam.SPAN and j >= at and j - i + 1 >= 13 and same[i : j + 1].sum() * 10 >= 8 * (j - i + 1):
                    best = max(best, j - i + 1)
        assert decontam.agrees(x, y, 0, at) == best


def test_large_components_score_exactly(spark):
    """No component is held to a bound; a score or component beyond the long range raises an error."""
    v = [(50, [1, 0, 3]), (1, [70_000 << 8, 0, 0]), (2, [90_000 << 8, 0, 0]), (3, [(1 << 61) + 1, 1, -1]), (4, [(1 << 61) + 1, 0, -1])]
    vectors = spark.createDataFrame(v, "vec_id long, v array<bigint>")
    queries = vectors.where("vec_id = 50").selectExpr("vec_id as query_id", "v as q")
    got = [(r["rank"], r["vec_id"], r["score"]) for r in topk.search(vectors, queries).collect()]
    assert sorted(got) == [(1, 3, (1 << 61) - 2), (2, 4, (1 << 61) - 2), (3, 2, 90_000 << 8), (4, 1, 70_000 << 8)]
    far = vectors.union(spark.createDataFrame([(5, [(1 << 61), 0, 1 << 61])], vectors.schema))
    with pytest.raises(Exception, match="long range"):
        topk.search(far, far.where("vec_id = 50").selectExpr("vec_id as query_id", "array(3L, 0L, 3L) as q")).collect()
    with pytest.raises(Exception, match="long range"):
        spark.createDataFrame([([1e30],)], "e array<double>").select(topk.quantised(F.col("e"))).collect()


def test_search(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v = rng.integers(-130, 130, size=(700, 12))
    v[100:140] = v[3]  # ties
    rows = [(i, [int(x) for x in r]) for i, r in enumerate(v)] + [(900, [1, 2])]
    vectors = spark.createDataFrame(rows, "vec_id long, v array<bigint>")
    queries = vectors.where("vec_id % 50 = 0").selectExpr("vec_id as query_id", "v as q")
    monkeypatch.setattr(topk, "BLOCK", 200)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    got = {}
    for r in topk.search(vectors, queries).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    full = {i: np.array(x + [0] * (12 - len(x))) for i, x in rows}
    for q in (i for i in full if i % 50 == 0):
        best = sorted(((-int(full[q] @ x), i) for i, x in full.items() if i != q))[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]


def test_search_leaves_out_odd_vectors(spark, tmp_path):
    rows = [(0, [0.5, -0.25]), (1, None), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, [float("inf"), 0.0]), (5, [0.001, 0.5]), (50, [1.0, 1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.query(spark, str(tmp_path)).collect())
    assert got == [(0, 1, 50, 128 * 256 - 64 * 256), (0, 2, 5, 0 - 64 * 128), (50, 1, 5, 256 * 128), (50, 2, 0, 256 * 64)]
