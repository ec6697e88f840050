"""Classifiers and the language model: held-out accuracy on the given tables, and odd rows."""

import math
import os
from collections import Counter

import pytest

from sheetgraph.llm import langid, lm_mixing, quality, toxicity
from sheetgraph.llm.common import fold, text_chunks

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
BIG = os.environ.get("TEST_BIG_SF_DIR", "/root/testdata/sf0.1")
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "x" * 200_000), (5, "word " * 60_000), (6, "42 !!"), (6, "42 !!"), (7, "ünïcödé 漢字 😀")]


def odd(spark):
    return spark.createDataFrame([(i, t, "a", 1.0) for i, t in ODD], "doc_id long, text string, _tox_x string, features double")


@pytest.fixture(scope="module")
def tables(spark):
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    return {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")}


def auc(rows):
    rank = {s: i for i, s in enumerate(sorted({r[0] for r in rows}))}
    pos, neg = [rank[s] for s, y in rows if y], [rank[s] for s, y in rows if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_text_chunks():
    assert list(text_chunks(["a", None, "bb", "ccc"], 3)) == [(0, ["a", "", "bb"]), (3, ["ccc"])]
    assert list(text_chunks([])) == []


def test_language_id(spark, tables):
    out = langid.query(spark, SF).toPandas().merge(tables["documents"].select("doc_id", "lang").toPandas(), on="doc_id")
    held = out[out.held_out]
    assert len(out) == tables["documents"].count() and (held.lang_pred == held.lang).mean() > 0.97


def test_language_id_odd_rows(spark):
    train = spark.createDataFrame([("the and of", "en"), ("der und die", "de"), (None, "en"), ("le", None)], "text string, lang string")
    m = langid.fit(train)
    assert m.langs == ["de", "en"]
    docs = odd(spark)
    got = [(r["doc_id"], r["p"]["lang_pred"], r["p"]["score"]) for r in docs.select("doc_id", langid.predict(docs, m).alias("p")).collect()]
    assert all(p == "und" and s == 0 for i, p, s in got if i in (1, 2, 3, 6)) and all(p in m.langs and 0 < s <= 1 for i, p, s in got if i in (4, 5, 7))
    none = langid.fit(train.limit(0))
    assert {r[0]["lang_pred"] for r in docs.select(langid.predict(docs, none)).collect()} == {"und"}


@pytest.mark.parametrize("module, label, folder", [(toxicity, "toxic", BIG), (quality, "quality", SF)])
def test_classifiers(spark, tables, module, label, folder):
    """sf0.01 has under 40 toxic rows to learn stems of four languages from, so that model is held against sf0.1."""
    if not os.path.isdir(folder):
        pytest.skip("no tables")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    out = module.query(spark, folder).join(labels, "doc_id").where("held_out").select("score", label, "predicted").collect()
    assert auc([(r["score"], r[label]) for r in out]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)


def test_classifiers_odd_rows(spark, tables):
    docs, held = odd(spark), fold(tables["labels"]["doc_id"], 4) == 0
    few = tables["labels"].where(held)
    q = quality.fit(tables["documents"], few)
    got = docs.select("doc_id", quality.score(docs, q).alias("s")).collect()
    assert len(got) == len(ODD) and all(0 <= r["s"] <= 1 for r in got)
    t = toxicity.with_score(docs, toxicity.fit(tables["documents"], few))
    assert t.columns == [*docs.columns, "score"] and t.count() == len(ODD) and t.where("score between 0 and 1").count() == len(ODD)
    for empty in (few.limit(0), few.where("toxic = 0 and quality = 1")):
        assert toxicity.with_score(docs, toxicity.fit(tables["documents"], empty)).where("score = 0").count() == len(ODD)
        assert docs.where(quality.score(docs, quality.fit(tables["documents"], empty)).isin(0.0, 1.0)).count() == len(ODD)


def test_forward_backward():
    """Marginals of a short chain against all labelings."""
    import itertools

    import numpy as np

    score, trans = np.array([0.3, -1.2, 2.0, 0.5]), np.array([[0.4, -0.3], [0.1, 0.9]])
    good, log_z, pairs = quality.marginals(score, np.array([3, 1]), trans)
    weight = {}
    for y in itertools.product((0, 1), repeat=3):
        weight[y] = math.exp(sum(score[i] * y[i] for i in range(3)) + trans[y[0], y[1]] + trans[y[1], y[2]])
    z = sum(weight.values())
    assert math.isclose(log_z[0], math.log(z))
    for i in range(3):
        assert math.isclose(good[i], sum(w for y, w in weight.items() if y[i]) / z)
    assert math.isclose(pairs[0, 1], sum(w * ((y[0], y[1]) == (0, 1)) + w * ((y[1], y[2]) == (0, 1)) for y, w in weight.items()) / z)
    assert math.isclose(good[3], 1 / (1 + math.exp(-0.5)))


def test_base_score(spark, monkeypatch):
    monkeypatch.setattr(lm_mixing, "FREQUENT", 2)  # the others go through the join
    rows = [(i, t) for i, t in enumerate(["The cat the", "cat\tdog", None, "", "THE cat é", "unseen dog dog", "the end"])] + [(20 + i, "the cat sat") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", fold_of())
    m, counts = lm_mixing.fit(docs.where("not held_out"))
    assert len(m.lexicon.words) <= 2
    got = {(r["doc_id"]): r for r in lm_mixing.score(docs, m, counts).collect()}
    held = {r["doc_id"]: r["held_out"] for r in docs.collect()}
    words = {i: (t or "").lower().split() + ["\n"] for i, t in rows}
    c = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    assert len(got) == len(rows)
    for i, ws in words.items():
        want = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        r = got[i]
        assert math.isclose(r["base_score"], want, abs_tol=1e-9) and r["n_tokens"] == len(ws) and r["n_known"] == sum(c[w] > 0 for w in ws) and r["train_tokens"] == n
        assert r["score"] < 0 and math.isfinite(r["score"])


def fold_of():
    from pyspark.sql import functions as F

    return fold(F.col("doc_id"), 10) == 0


def test_probabilities_sum_to_one(spark):
    """Every tree is full, so the chances of its decisions multiply to a distribution over words and an escape, or over
    the next bytes and an escape."""
    import numpy as np

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["abc abd abc xyz", "abd ab", "zz abc q", "once"] * 5 + ["other rare words"])], "doc_id long, text string")
    m, _ = lm_mixing.fit(docs)
    t = m.trees
    assert (t.escape_start >= 0).any()
    for ctx in np.flatnonzero(t.escape_start >= 0):
        ways = [t.size[ctx * 256 + s] for s in range(256) if t.start[ctx * 256 + s] >= 0] + [t.escape_size[ctx]]
        assert math.isclose(sum(2.0 ** -int(n) for n in ways), 1.0)
    lex = m.lexicon
    assert len(lex.size) == len(lex.words) + 1 and math.isclose(sum(2.0 ** -int(n) for n in lex.size), 1.0)
    chance = {}
    for k in range(len(lex.size)):
        path = range(lex.start[k], lex.start[k] + lex.size[k])
        chance[k] = math.prod(1 / (1 + math.exp(-lex.odds[lex.node[i]] * (1 if lex.bit[i] else -1))) for i in path)
    assert math.isclose(sum(chance.values()), 1.0, rel_tol=1e-5)
    learnt = Counter(w for r in docs.collect() for w in [*lm_mixing.split_words(pa_array([r["text"]]))[0].to_pylist()])
    assert chance[lex.words.index(b"abc")] > chance[lex.words.index(b"ab")] and learnt["abc"] == 15  # by how often they are learnt


def pa_array(texts):
    import pyarrow as pa

    return pa.array(texts, pa.string())


def test_split_words():
    texts = ["", None, " a  B\tc ", "\x0bÉé\x1fx\x0c", "one\n", "\u00a0 y"]
    words, n = lm_mixing.split_words(pa_array(texts))
    want = [(t or "").encode().lower().split() for t in texts]
    assert n.tolist() == [len(w) for w in want] and [w.encode() for w in words.to_pylist()] == [x for w in want for x in w]


def test_model_beats_words_on_held_out_text(spark, tables):
    out = lm_mixing.query(spark, SF).where("held_out").toPandas()
    assert out.score.sum() > 0.9 * out.base_score.sum() and (out.score < 0).all()


def test_lm_without_training(spark):
    docs = odd(spark).select("doc_id", "text")
    m, counts = lm_mixing.fit(docs.limit(0))
    from pyspark.sql import functions as F

    got = lm_mixing.score(docs.withColumn("held_out", F.lit(True)), m, counts).collect()
    assert len(got) == len(ODD) and all(r["n_known"] == 0 and r["score"] < 0 for r in got)


def test_lm_reads_the_order_of_words(spark):
    """Two held-out texts of the same words: the one in an order of the corpus scores better."""
    import random

    fluent = "the quick brown fox jumps over a lazy dog while seven grey wolves watch from that hill"
    words, rng = fluent.split(), random.Random(3)
    rows = [(i, fluent) for i in range(200)]
    shuffled = [" ".join(rng.sample(words, len(words))) for _ in range(20)]
    m, counts = lm_mixing.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    ask = spark.createDataFrame([(1000 + i, t, True) for i, t in enumerate([fluent, *shuffled])], "doc_id long, text string, held_out boolean")
    got = {r["doc_id"]: r["score"] for r in lm_mixing.score(ask, m, counts).collect()}
    best = got.pop(1000)
    assert all(s < 1.2 * best for s in got.values())


def test_lm_own_counts_of_long_texts():
    """Texts' own counts are those of a dict, however many contexts they have."""
    import numpy as np

    rng = np.random.default_rng(5)
    context, bit = rng.integers(0, 1 << 32, 60_000, dtype=np.uint32)[rng.integers(0, 60_000, 200_000)], rng.integers(0, 2, 200_000)
    for texts in (1, 3, 1000):
        text = rng.integers(0, texts, 200_000)
        n0, n1 = lm_mixing.own_counts(context, bit, text)
        seen = Counter()
        for k, (c, b, t) in enumerate(zip(context.tolist(), bit.tolist(), text.tolist(), strict=True)):
            assert (n0[k], n1[k]) == (seen[t, c, 0], seen[t, c, 1])
            seen[t, c, b] += 1


def test_lm_mixes_decision_by_decision():
    """Chances of texts mixed side by side against a plain loop over each text alone; short ones move weights too."""
    import numpy as np

    rng, sizes = np.random.default_rng(9), np.array([70, 1, 300, 128, 1000])
    n = sizes.sum()
    x = rng.normal(scale=2, size=(lm_mixing.INPUTS, n)).astype(np.float32)
    gate, bit = rng.integers(0, lm_mixing.GATES, n), (rng.random(n) < 0.8).astype(np.uint8)
    w0 = rng.normal(size=(lm_mixing.INPUTS, lm_mixing.GATES)).astype(np.float32)
    m0 = np.tile(1 / (1 + np.exp(12 - np.arange(lm_mixing.STEPS))), lm_mixing.GATES).astype(np.float32)
    span = 50
    place = np.concatenate([np.arange(k) for k in sizes])
    text = np.repeat(np.arange(len(sizes)), sizes)
    at = np.lexsort((text, place // span))
    ends, logs = np.cumsum(np.bincount(place // span)), np.empty(n)
    logs[at] = lm_mixing.mix(x[:, at], gate[at], bit[at], text[at], ends, w0.copy(), m0.copy())
    at = 0
    for size in sizes.tolist():
        w, m = w0.astype(float), m0.astype(float)
        for k in range(at, at + size, span):
            dw, dm = np.zeros_like(w), np.zeros_like(m)
            for i in range(k, min(k + span, at + size)):
                dot = min(max(w[:, gate[i]] @ x[:, i], -11.4), 11.4)
                p, key = 1 / (1 + math.exp(-dot)), round(dot) + 12 + gate[i] * 24
                mixed = max((p + m[key]) / 2 if bit[i] else 1 - (p + m[key]) / 2, 1e-5)
                assert math.isclose(logs[i], math.log(mixed), rel_tol=1e-2, abs_tol=1e-3)
                dw[:, gate[i]] += lm_mixing.RATE * (bit[i] - p) * x[:, i]
                dm[key] += lm_mixing.MAP_RATE * (bit[i] - m[key])
            w, m = w + dw, m + dm
        at += size


def test_lm_inputs_begin_at_the_training_words(spark):
    """A context that the document hasn't seen says what the training words say."""
    import numpy as np

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["the cat sat on the mat", "a dog sat", "the dog ran off"] * 9)], "doc_id long, text string")
    m, _ = lm_mixing.fit(docs)
    reader, coder = lm_mixing.Reader(m.lexicon), lm_mixing.Coder(m)
    ids, n, rare = reader(pa_array(["the dog sat unheard", "the"]))
    c = lm_mixing.texts_of(ids, n, coder(rare), reader.end)
    x, gate = lm_mixing.inputs_of(c, m.tables[-1])
    seen, first = set(), []
    for k in zip(c.lane.tolist(), c.context.tolist(), strict=True):
        first.append(k not in seen)
        seen.add(k)
    first = np.array(first)
    assert np.allclose(x[2][first], x[0][first], atol=1e-3) and not np.allclose(x[2], x[0], atol=1e-2) and gate.max() < lm_mixing.GATES


def test_lm_turns():
    """SPAN words of each text in turn, the longest first; every decision once, after the right word."""
    import numpy as np

    size = np.array([2, 1, 0, 3])
    c = lm_mixing.Coded(np.cumsum(size) - size, size, *(np.arange(6, dtype=t) for t in (np.float32, np.float32, np.uint32, np.uint8)), np.arange(4, dtype=np.int32) + 10, None, None)
    rng = np.random.default_rng(1)
    words = np.array([3, 40, 1, 17])
    ids = rng.integers(0, 4, words.sum())
    ids[np.cumsum(words) - 1] = 0  # the end mark
    t = lm_mixing.texts_of(ids, words, c, 0)
    text = np.repeat(np.arange(4), words)
    place = np.concatenate([np.arange(k) for k in words])
    rank = np.array([2, 0, 3, 1])
    want = sorted(range(len(ids)), key=lambda k: (place[k] // lm_mixing.SPAN, rank[text[k]], place[k]))
    assert t.order.tolist() == want
    starts = [0, 2, 3, 3]
    assert t.context.tolist() == [starts[ids[k]] + i for k in want for i in range(size[ids[k]])]
    assert t.lane.tolist() == [rank[text[k]] for k in want for _ in range(size[ids[k]])]
    assert t.before.tolist() == [10 + (ids[k - 1] if place[k] else 0) for k in want for _ in range(size[ids[k]])]
    assert t.ends[-1] == len(t.odds) and len(t.ends) == 5


def test_text_runs():
    got = [(k, t.to_pylist()) for k, t in lm_mixing.text_runs(pa_array(["a", None, "bb", "ccc", "", "dddddd", "e"]), 3)]
    assert got == [(0, ["a", None, "bb"]), (3, ["ccc", ""]), (5, ["dddddd"]), (6, ["e"])] and list(lm_mixing.text_runs(pa_array([]), 3)) == []


def test_lm_reader():
    """Leaves of the lexicon, then words in no leaf; only A-Z are lower-cased."""
    import numpy as np

    n = np.array([5.0, 3.0, 1.0, 9.0])
    reader = lm_mixing.Reader(lm_mixing.lexicon_of([b"the", b"cat", "é".encode(), b"\n"], n, n, 2.0))
    ids, sizes, rare = reader(pa_array(["The cat x", "", " é É y x"]))
    assert ids.tolist() == [0, 1, 4, 3, 3, 2, 5, 6, 4, 3] and sizes.tolist() == [4, 1, 5] and rare == [b"x", "É".encode(), b"y"]


def words_and_sizes(texts):
    import numpy as np

    return np.concatenate([lm_mixing.hashes_of(t) for t in texts]), np.array([len(t) for t in texts])


def test_passages():
    """Passages of texts taken together are those of each alone, bounded, and cut alike wherever they stand."""
    import random

    import numpy as np

    from sheetgraph.llm import passages

    rng = random.Random(8)
    vocabulary = [f"w{k}".encode() for k in range(300)]
    core = [rng.choice(vocabulary) for _ in range(400)]
    texts = [core + [b"\n"], [rng.choice(vocabulary) for _ in range(77)] + core + [b"\n"], [b"\n"], [b"a"] * 500 + [b"\n"], core[:100] * 3 + [b"\n"]]
    pair, prev, times, follows, again, cuts, n = passages.passages_of(*words_and_sizes(texts))
    assert n.sum() == len(pair) and (np.diff(cuts) <= passages.MOST).all()
    ends = np.cumsum(n)
    for k, t in enumerate(texts):
        p, q, c, f, a, _, m = passages.passages_of(*words_and_sizes([t]))
        own = slice(ends[k] - n[k], ends[k])
        assert m[0] == n[k] and (pair[own] == p).all() and (prev[own] == q).all() and (times[own] == c).all() and (follows[own] == f).all() and np.array_equal(again[own], a, equal_nan=True)
        seen, first, count, goes = Counter(), Counter(), Counter(p.tolist()), Counter(q.tolist())
        for x, y, z, v, w in zip(p.tolist(), q.tolist(), c.tolist(), f.tolist(), a.tolist(), strict=True):
            assert z == (0 if seen[x] else count[x]) and v == goes[y]
            assert math.isnan(w) if not first[y] else w == -math.inf if not seen[x] else math.isclose(w, math.log(seen[x] / first[y]), abs_tol=1e-5)
            seen[x] += 1
            first[y] += 1
    assert len(set(pair[: n[0]]) & set(pair[n[0] : n[0] + n[1]])) > 0.8 * n[0]


@pytest.mark.parametrize("least", [1000, 1])
def test_passages_seen_elsewhere(spark, monkeypatch, least):
    """Counts elsewhere against a plain loop; a hot pair is broadcast and gives the same."""
    import random

    from sheetgraph.llm import common, passages

    monkeypatch.setattr(common, "HOT_LEAST", least)
    rng = random.Random(4)
    rows = []
    for row in range(60):
        passed, p = [], int(passages.START)
        for _ in range(rng.randint(1, 9)):
            q = rng.randint(10, 14)
            passed.append((p, q))
            p = q
        n, seen, goes, parts = Counter(passed), set(), Counter(x for x, _ in passed), ([], [], [], [])
        for a in passed:
            for part, v in zip(parts, (a[0] * 100 + a[1], a[0], 0 if a in seen else n[a], goes[a[0]]), strict=True):
                part.append(v)
            seen.add(a)
        rows.append((row, row % 7 == 0, *parts))
    df = spark.createDataFrame(rows, "row long, held_out boolean, pair array<long>, prev array<long>, own array<int>, follows array<int>")
    got = {}
    for r in passages.seen_elsewhere(df).collect():
        got[r["row"], r["pair"]] = max(got.get((r["row"], r["pair"]), -math.inf), r["log_p"])
    total, after = Counter(), Counter()
    for _, held, pair, _, own, _ in rows:
        for a, k in zip(pair, own, strict=True):
            total[a] += 0 if held else k
            after[a // 100] += 0 if held else k
    want = {}
    for row, held, pair, prev, own, follows in rows:
        for a, q, k, m in zip(pair, prev, own, follows, strict=True):
            of = after[q] - (0 if held else m)
            if k and of > 0:
                here = total[a] - (0 if held else k)
                want[row, a] = math.log(here / of) if here else -math.inf
    assert got.keys() == want.keys() and all(got[k] == want[k] or math.isclose(got[k], want[k], abs_tol=1e-5) for k in want)


def test_chances_of_passages_add_up_to_one(spark):
    """Ten texts go on in ten ways after the same passage: whichever a text takes, its chance is a tenth, and the ten add up to one;
    so do all ways after a passage that is known elsewhere and earlier."""
    import numpy as np

    from sheetgraph.llm import passages

    start, layout = int(passages.START), "row long, held_out boolean, pair array<long>, prev array<long>, own array<int>, follows array<int>"
    train = [(k, False, [5, 1000 + k], [start, 50], [1, 1], [1, 1]) for k in range(10)]
    held = [(100 + k, True, [5, 1000 + k], [start, 50], [1, 1], [1, 1]) for k in range(12)]
    got = {}
    for r in passages.seen_elsewhere(spark.createDataFrame(train + held, layout)).collect():
        got[r["row"], r["pair"]] = max(got.get((r["row"], r["pair"]), -math.inf), r["log_p"])
    chances = [math.exp(got[100 + k, 1000 + k]) for k in range(12)]
    assert all(math.isclose(c, 0.1, abs_tol=1e-6) for c in chances[:10]) and chances[10:] == [0.0, 0.0] and math.isclose(sum(chances), 1, abs_tol=1e-5)
    assert math.exp(got[3, 5]) == 1.0 and got[3, 1003] == -math.inf  # its own place doesn't count

    # Elsewhere {B: .5, C: .5}, earlier {D: 1}; words spell B, C and D with .2 each at most and anything else with the rest.
    sums = {}
    for where in ([0.5, 0.0], [0.5, 0.0], [0.0, 1.0], [0.0, 0.0]):
        log = np.log(np.array(where), where=np.array(where) > 0, out=np.full(2, -np.inf))
        nats = np.array([3.0, -math.log(0.2)])
        both = passages.follow(nats, np.array([np.nan, log[0]]), np.array([np.nan, log[1]]), np.array([2]))[0]
        sums[len(sums)] = math.exp(-(both - 3.0))
    assert sums[0] + sums[1] + sums[2] + 2 * sums[3] <= 1 + 1e-9 and sums[2] > sums[0] > sums[3]


def test_follow():
    """Nats of texts taken together against a plain loop over each."""
    import numpy as np

    from sheetgraph.llm import passages

    rng = np.random.default_rng(2)
    sizes = np.array([3, 1, 40, 12])
    n = sizes.sum()
    nats, log_p = rng.uniform(5, 200, n), np.where(rng.random(n) < 0.6, -rng.random(n), np.where(rng.random(n) < 0.5, -np.inf, np.nan))
    again = np.where(rng.random(n) < 0.2, -rng.random(n), np.where(rng.random(n) < 0.5, -np.inf, np.nan))
    got, at = passages.follow(nats, log_p, again, sizes), 0
    for total, size in zip(got, sizes.tolist(), strict=True):
        tables, weights = [t.ravel().astype(float).copy() for t in (passages.BY_LAST, passages.BY_RUN, passages.BY_SHARE)], [0.45] * 3
        last = before = run = ones = 0
        want = 0.0
        for t in range(size):
            known = [v for v in (log_p[at + t], again[at + t]) if not math.isnan(v)]
            if not known:
                want += nats[at + t]
                continue
            share = 0 if ones == 0 else 1 + min(4 * ones // (t + 1), 3)
            keys = (3 * last + before, 4 * (last == 2) + min(run, 3), share)
            x = [math.log(tb[k] / (1 - tb[k])) for tb, k in zip(tables, keys, strict=True)]
            p = min(max(1 / (1 + math.exp(-sum(a * b for a, b in zip(x, weights, strict=True)))), 1e-4), 1 - 1e-4)
            there = p * sum(math.exp(v) for v in known) / len(known)
            chance = there + (1 - p) * math.exp(-nats[at + t])
            want -= math.log(chance)
            bit = there / chance
            weights = [w + 0.02 * (bit - p) * a for w, a in zip(weights, x, strict=True)]
            for tb, k in zip(tables, keys, strict=True):
                tb[k] = min(max(tb[k] + 0.1 * (bit - tb[k]), 1e-4), 1 - 1e-4)
            one = bit > 0.5
            run = run + 1 if (last == 2) == one else 0
            before, last = last, 2 if one else 1
            ones += one
        assert math.isclose(total, want, rel_tol=1e-6)
        at += size


def test_lm_knows_a_text_that_stands_twice(spark):
    """A text with a copy elsewhere in the corpus is cheap, one that stands once is not, held out or not."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(6)
    words = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("n", "r", "st", "x")]
    texts = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, texts[i]) for i in range(5)] + [(200, texts[30])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", F.col("doc_id").isin(40, 41, 200))
    m, counts = lm_mixing.fit(docs.where("not held_out"))
    got = {r["doc_id"]: r["bits_per_byte"] for r in lm_mixing.score(docs, m, counts).collect()}
    twice = {*range(5), *range(100, 105), 200}  # 30 is only repeated in a held-out row
    assert max(got[i] for i in twice) < 0.3 < 1 < min(got[i] for i in got if i not in twice)


def test_coding_a_chunk_copies_no_lexicon():
    """Every chunk copied what the lexicon says of its leaves' decisions; now a chunk holds those of its own rare words."""
    import numpy as np
    import pandas as pd

    words = [f"w{k:05}".encode() for k in range(3000)]
    n = np.arange(3000, 0, -1)
    lex = lm_mixing.lexicon_of(words, n, n.astype(float), 10.0)
    wide = [*(1 << bits for bits in lm_mixing.TABLE_BITS), lm_mixing.CLASSES * (lm_mixing.TOP + 1)]
    tables = [np.zeros(w, np.int8) for w in wide]
    trees = lm_mixing.trees_of(pd.DataFrame({"key": [ord("x")], "n": [3]}))
    m = lm_mixing.Model(lex, trees, tables, np.full((lm_mixing.ORDERS, lm_mixing.BYTE_GATES), 0.3, np.float32), None, None, 1, 1)
    coder = lm_mixing.Coder(m)
    c = coder([b"xyz", b"x"])
    at = np.concatenate([np.arange(50), np.arange(len(lex.node) - 5, len(lex.node) + 20)])
    assert c.odds.own is coder.odds and c.context.own is coder.context and c.state.own is coder.state
    assert np.shares_memory(coder.context, lex.node)
    assert max(len(c.odds.more), len(c.context.more), len(c.state.more)) == c.size[-2:].sum() < 1000
    for both, own in ((c.odds, lex.odds[lex.node]), (c.context, lex.node.astype(np.uint32))):
        assert (both.take(at) == np.concatenate([own, both.more]).take(at)).all()
    assert (c.prior.take(at) == lm_mixing.prior_of(c.odds.take(at))).all()
    escape = slice(lex.start[-1], lex.start[-1] + lex.size[-1])
    assert (c.context.take(np.arange(c.start[-1], c.start[-1] + lex.size[-1])) == lex.node[escape]).all()


def test_lm_finds_leaves_without_a_new_hash_table(monkeypatch):
    """Every chunk of texts hashed the whole lexicon to look up its words. Words are found by their kept hashes now, and compared."""
    import numpy as np
    import pyarrow as pa

    n = np.array([5, 3, 1, 9, 2])
    lex = lm_mixing.lexicon_of([b"the", b"cat", "é".encode(), b"\n", b"a" * 70], n, n.astype(float), 2.0)
    monkeypatch.setattr(lm_mixing.pc, "index_in", None)
    texts = ["The cat x", None, "", " é É y x " + "a" * 70, "a" * 69 + " cat"]
    words = [w for t in texts for w in (t or "").encode().lower().split()]
    array = pa.array([w.decode() for w in ["-".encode(), *words]], pa.large_string())
    assert (lm_mixing.hashes_in(array.slice(1)) == lm_mixing.hashes_of(words)).all() and len(lm_mixing.hashes_in(array[:0])) == 0
    reader, known = lm_mixing.Reader(lex), {w: k for k, w in enumerate(lex.words)}
    want = [known.get(w, 5) for t in texts for w in [*(t or "").encode().lower().split(), b"\n"]]
    assert reader.leaves(pa_array(texts)).tolist() == want
    ids, _, rare = reader(pa_array(texts))
    assert np.minimum(ids, 5).tolist() == want and rare == [b"x", "É".encode(), b"y", b"a" * 69]
    lex.whole[:] = lex.whole[0]  # words of one hash: never the wrong leaf
    leaves = lm_mixing.Reader(lex).leaves(pa_array(texts))
    assert all(a in (b, 5) for a, b in zip(leaves.tolist(), want, strict=True))
