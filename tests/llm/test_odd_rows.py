"""Odd rows and columns of every stage, and brute force where SQL can't tell."""

import math
import os
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sheetgraph.llm import common, decontam, langid, mixing, quality, simhash, topk, toxicity, url_filter
from sheetgraph.llm import queries as llm

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
CLASHES = ["y", "rate", "_row", "_source", "_id", "_bad", "row", "_toxicity", "fp", "th", "d", "h", "size", "target", "copies", "score", "features", "_tox_row", "a.b", "Weight"]


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark")}


def odd_docs(tables):
    """The documents with clashing columns, null rows, repeated rows, unlike texts of one id and a long text."""
    docs = tables["documents"]
    extra = docs.limit(1).selectExpr("doc_id", "'another text of the same id, with words of its own' AS text", "lang", "source", "n_chars")
    null = docs.limit(1).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "CAST(NULL AS STRING) AS text", "CAST(NULL AS STRING) AS lang", "CAST(NULL AS STRING) AS source", "n_chars")
    long = docs.limit(1).selectExpr("9999999L AS doc_id", "repeat('long words here ', 40000) AS text", "lang", "source", "n_chars")
    out = docs.select("doc_id", "text", "lang", "source", "n_chars").union(extra).union(null).union(null).union(long).union(docs.limit(3).select("doc_id", "text", "lang", "source", "n_chars"))
    for c in CLASHES:
        out = out.withColumn(c, F.lit(1.5))
    return out


@needs_tables
def test_stages_keep_every_column(spark, tables):
    """No name clashes; clean rows stay as they are, and an empty table stays empty."""
    docs = common.cut(odd_docs(tables))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert name and sorted(c for c in out.columns if c != "n_chars")[:3] and set(docs.columns) <= set(out.columns)
        rows = out.select("doc_id", "text", "`a.b`").collect()
        assert len(rows) > 0.4 * docs.count() and all(r["a.b"] == 1.5 for r in rows)
        empty = stage(spark, docs.limit(0), SF)
        assert empty.count() == 0 and empty.columns == out.columns


@needs_tables
def test_pipeline_by_brute_force(spark, tables):
    """Every stage of the pipeline against its rule on its own input."""
    docs = tables["documents"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = common.cut(stage(spark, docs, SF))
        kept = Counter(map(tuple, docs.collect()))
        if name == "simhash_dedup":
            fps = [simhash.fingerprint(r["text"]) for r in before]
            group = list(range(len(before)))
            for i in range(len(before)):
                for j in range(i):
                    if (fps[i] ^ fps[j]).bit_count() <= 4:
                        a, b = group[i], group[j]
                        group = [b if g == a else g for g in group]
            best = {}
            for r, g in zip(before, group, strict=True):
                best[g] = min(best.get(g, r), r, key=lambda x: x["doc_id"])
            assert kept == Counter(tuple(r) for r in best.values())
        if name == "decontamination":
            items = [set(zip(*(t[k:] for k in range(13)), strict=False)) for r in tables["benchmark"].collect() for t in [decontam.TOKEN.findall((r["text"] or "").lower())]]
            for r in before:  # 13 equal tokens in a row are never kept
                t = decontam.TOKEN.findall((r["text"] or "").lower())
                if any(set(zip(*(t[k:] for k in range(13)), strict=False)) & i for i in items):
                    assert tuple(r) not in kept
    plan = {(r["doc_id"], r["text"]): r["copies"] for r in mixing.mix_plan(docs).collect()}
    got = Counter((r["doc_id"], r["text"]) for r in mixing.mix(docs).collect())
    assert {k: n for k, n in plan.items() if n} == dict(got)


def test_one_row_of_a_group_stays(spark):
    """Rows of one id with unlike texts both stay; copies go, with or without an id; of equal rows one stays."""
    text = " ".join(f"word{k}" for k in range(60))
    other = " ".join(f"else{k}" for k in range(60))
    rows = [(1, text), (1, other), (2, text), (None, text), (None, "all alone here with five words"), (None, "all alone here with five words"), (7, None), (8, ""), (9, other), (3, "one of its kind"), (3, "one of its kind")]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter([(1, text), (1, other), (None, "all alone here with five words"), (7, None), (3, "one of its kind")])


def test_hot_keys_are_split(spark, monkeypatch):
    """Groups and joins give the same whether their keys count as hot or not."""
    rows = [(i, f"same text for all of them {i % 3 == 0}") for i in range(60)] + [(100 + i, None) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, simhash.near_duplicates(docs).collect()))
    monkeypatch.setattr(common, "HOT_LEAST", 1)
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect())) == want
    monkeypatch.setattr(decontam, "HOT_LEAST", 0)
    prompt = "please answer the following question about the history of this old town"
    items = spark.createDataFrame([(i, f"{prompt} number{i} alpha{i} beta{i} gamma{i}") for i in range(40)], "item_id long, text string")
    asks = spark.createDataFrame([(i, f"x y z {prompt} number{i} alpha{i} beta{i} gamma{i} and so on") for i in range(0, 40, 7)], "doc_id long, text string")
    got = {r["doc_id"]: r["item_ids"] for r in decontam.report(asks, items).collect()}
    assert got.keys() == set(range(0, 40, 7)) and all(k in v for k, v in got.items())


@pytest.mark.parametrize("n", range(1, 13))
def test_short_items(spark, n):
    """Items under MIN_TOKENS are found whole, with as many inner substitutions as the similarity allows, and no more."""
    rng = random.Random(n)
    item = [f"w{rng.randrange(10**6)}" for _ in range(n)]
    swaps = n - math.ceil(decontam.SIMILARITY * n - 1e-9)
    docs, want, pad = [], set(), [f"p{k}" for k in range(30)]

    def add(tokens, hit):
        docs.append((len(docs), " ".join(pad + tokens + pad)))
        want.update([len(docs) - 1] if hit else [])

    add(item, True)
    for _ in range(6):
        for k in (swaps, swaps + 1):
            if 0 < k <= n - 2:
                at = set(rng.sample(range(1, n - 1), k))
                add([f"x{i}" if i in at else w for i, w in enumerate(item)], k == swaps)
    if n > 1:
        add(item[:-1], False)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")
    assert {r["doc_id"] for r in decontam.report(d, b).collect()} == want


def test_decontamination_by_brute_force(spark):
    """Every alignment of every document with every item, without seeds."""
    rng = random.Random(12)
    vocabulary = [f"v{k}" for k in range(400)]
    text = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    items = [text(rng.randint(13, 30)) for _ in range(12)]
    docs = []
    for _ in range(60):
        t, item = text(rng.randint(0, 80)), list(rng.choice(items))
        for at in rng.sample(range(len(item)), rng.randint(0, 4)):
            item[at] = "swap"
        a = rng.randint(0, len(item) - 10)
        docs.append(t + item[a : rng.randint(a + 8, len(item))] + text(20))
    want = defaultdict(set)
    for i, d in enumerate(docs):
        for j, item in enumerate(items):
            for shift in range(-len(item), len(d)):
                hits = [k for k in range(max(0, -shift), min(len(item), len(d) - shift)) if d[k + shift] == item[k]]
                seeds = any(all(k + o in hits for o in m) for k in hits for m in decontam.MASKS)
                stretch = any(hits[y] - hits[x] + 1 >= 13 and (y - x + 1) >= 0.8 * (hits[y] - hits[x] + 1) for x in range(len(hits)) for y in range(x, len(hits)))
                if stretch:
                    assert seeds  # spaced seeds see every stretch that is long enough
                    want[i].add(j)
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame([(j, " ".join(t)) for j, t in enumerate(items)], "item_id long, text string")
    assert {r["doc_id"]: set(r["item_ids"]) for r in decontam.report(d, b).collect()} == dict(want) and want


def test_quality_likelihood():
    """Loss and gradient against all labelings and finite differences."""
    import itertools

    rng = np.random.default_rng(3)
    n_lines, y, weight = np.array([3, 1, 4]), np.array([1.0, 0.0, 0.0]), np.array([2.0, 1.0, 0.5])
    x, p = rng.normal(size=(8, 3)), rng.normal(size=7)

    def slow(p):
        total, at, trans = 0.0, 0, p[-4:].reshape(2, 2)
        for n, label, w in zip(n_lines, y.astype(int), weight, strict=True):
            s = x[at : at + n] @ p[:-4]
            value = lambda ys, s=s: sum(a * b for a, b in zip(s, ys, strict=True)) + sum(trans[a, b] for a, b in itertools.pairwise(ys))
            total += w * (math.log(sum(math.exp(value(ys)) for ys in itertools.product((0, 1), repeat=int(n)))) - value([label] * int(n)))
            at += n
        return total

    loss, grad = quality.likelihood(x, y, n_lines, weight, p)
    assert math.isclose(loss, slow(p), rel_tol=1e-9)
    step = np.eye(7) * 1e-5
    assert np.allclose(grad, [(slow(p + e) - slow(p - e)) / 2e-5 for e in step], atol=1e-5)


@needs_tables
def test_quality_does_not_depend_on_the_order_of_rows(spark, tables):
    docs, labels = tables["documents"], tables["labels"]
    twice = docs.union(docs.limit(40)).union(docs.limit(20).withColumn("text", F.concat("text", F.lit("\nmore"))))
    a, b = (quality.fit(twice.orderBy(order), labels) for order in ("text", F.desc("text")))
    assert np.allclose(a.weights, b.weights) and np.allclose(a.curve, b.curve)


def test_language_by_brute_force(spark):
    """Counts and scores letter by letter in plain Python, and in slices."""
    texts = [("en", "The cat, the hat"), ("de", "der Hut und die Katze"), ("en", "a CAT 12 sat"), ("fr", "le chat est là")]
    m = langid.fit(spark.createDataFrame(texts, "lang string, text string"))

    def grams(text):
        t = "".join(c if c.isalpha() else " " for c in text.lower())
        t = t + " " * 4
        for n in langid.ORDERS:
            for i in range(len(t) - n + 1):
                g = t[i : i + n]
                if g[-1] == " " and (n == 1 or g[-2] == " ") or "  " in g:
                    continue
                h = n
                for k, c in enumerate(g):
                    h = (h + ord(c)) * int(langid._MULT[k % 4]) & 0xFFFFFFFF
                    h ^= h >> 15
                yield h & (langid.BUCKETS - 1)

    counts = defaultdict(Counter)
    for lang, t in texts:
        counts[lang].update(grams(t))
    prior = Counter(lang for lang, _ in texts)
    for ask in ("the chat", "Katze!", "là là"):
        score = {}
        for lang in m.langs:
            total = sum(counts[lang].values()) + langid.SMOOTHING * langid.BUCKETS
            score[lang] = math.log(prior[lang] / len(texts)) + sum(math.log((counts[lang][g] + langid.SMOOTHING) / total) for g in grams(ask))
        best = max(score, key=score.get)
        names, p = langid._score(m, [ask])
        assert names == [best] and math.isclose(p[0], 1 / sum(math.exp(s - score[best]) for s in score.values()), rel_tol=1e-4)


def test_language_of_a_long_text(spark, monkeypatch):
    m = langid.fit(spark.createDataFrame([("en", "the cat and the dog"), ("de", "der Hund und die Katze")], "lang string, text string"))
    asks = ["the dog and the cat " * 300, "der Hund", "und die Katze " * 50, "x"]
    want = langid._score(m, asks)
    monkeypatch.setattr(langid, "SLICE", 97)
    got = langid._score(m, asks)
    assert got[0] == want[0] and np.allclose(got[1], want[1])
    monkeypatch.setattr(langid, "MOST_LANGS", 1)
    with pytest.raises(ValueError, match="values of lang"):
        langid.fit(spark.createDataFrame([("en", "a"), ("de", "b")], "lang string, text string"))


def test_toxicity_features():
    """Rates by plain loops."""
    lex = toxicity.Lexicon({"=gurk": 5.0, "blor": 2.5})
    for text in ("You are an IDIOT!! idiot?", "", "y0u 1diot, blorfel GURK gurken", "a@b c*d tu es con", "12 34"):
        got = toxicity.features([text, "pad"], lex)[0]
        low = text.lower()
        hidden = sum(1 for i in range(1, len(text) - 1) if text[i - 1].isalpha() and text[i + 1].isalpha() and (text[i].isdigit() or text[i] in "@$*!"))
        words = toxicity.WORDS.findall(low.translate(toxicity.LEET) if hidden else low)
        n = max(len(words), 1)
        odds = [lex(w) for w in words]
        hits = [i for i, w in enumerate(words) if w in toxicity.INSULTS or odds[i] >= toxicity.STRONG]
        you = [i for i, w in enumerate(words) if w in toxicity.SECOND_PERSON]
        near = sum(1 for h in hits if any(abs(h - u) <= toxicity.NEAR for u in you))
        upper, letters = sum(c.isupper() for c in text), sum(c.isupper() or c.islower() for c in text)
        want = [
            sum(w in toxicity.INSULTS for w in words) / n, sum(o >= toxicity.STRONG for o in odds) / n, sum(o >= toxicity.LOG_ODDS for o in odds) / n, sum(odds) / n, math.log1p(len(hits)),
            max(odds, default=0), near / n, math.log1p(n), upper / max(letters, 1), sum(c in "!?" for c in text) / max(len(text), 1),
        ]
        assert np.allclose(got[:10], want) and math.isclose(got[11], hidden / max(len(text), 1))


@needs_tables
def test_toxicity_is_calibrated_on_unseen_rows(spark, tables):
    """The score is the value of the curve, which never falls, and equal documents get equal scores."""
    model = toxicity.fit(tables["documents"], tables["labels"])
    p = model.curve.predictions.toArray()
    assert (np.diff(p) >= 0).all()
    out = toxicity.with_score(tables["documents"], model).select("score").collect()
    assert all(p.min() - 1e-9 <= r["score"] <= p.max() + 1e-9 for r in out)


def test_search_of_wide_and_large_vectors(spark, tmp_path, monkeypatch):
    """One wide vector doesn't widen the others' blocks; huge components count in full; rows without an id take no part."""
    monkeypatch.setattr(topk, "WIDE", 4)
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(rng.choice([2, 3, 4]))]) for i in range(120)]
    rows += [(500, [rng.uniform(-1, 1) for _ in range(300)]), (501, [1e12, -1e12]), (None, [1.0]), (502, []), (503, [0.25, 0.25]), (50, [0.1])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = defaultdict(list)
    for r in topk.query(spark, str(tmp_path)).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None]
    for q in {i for i, _ in whole if i % 50 == 0}:
        v = min(v for i, v in whole if i == q)
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in whole if i != q)[:5]
        assert [(s, i) for _, i, s in sorted(got[q])] == [(-s, i) for s, i in best]


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, v array<bigint>")
    assert topk.search(none, none.selectExpr("vec_id as query_id", "v as q")).count() == 0


@needs_tables
@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_against_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = llm.queries()[name](spark, SF), duck.sql(llm.oracle_sql()[name])  # as rows: pandas has no whole numbers beside null
    cols = sorted(want.columns)
    plain = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, float) else str(v)[:10] if hasattr(v, "year") else v
    rows = lambda found: sorted(repr([plain(v) for v in r]) for r in found)
    assert sorted(got.columns) == cols and rows(got.select(*cols).collect()) == rows(want.select(*cols).fetchall())


def test_url_lists_of_odd_captures(spark):
    """Long urls, repeated rows and clashing columns."""
    import datetime as dt

    day = dt.date(2020, 1, 5)
    url = "http://a.org/" + "/".join(["x" * 50] * 500)
    caps = spark.createDataFrame([(1, url, day, 3), (1, url, day, 3), (None, url, day, 4), (2, "", day, 5)], "page_id long, url string, fetched date, salt int")
    lists = spark.createDataFrame([("l", "block", "prefix", "a.org/" + "/".join(["x" * 50] * 400), "add", day)], "list_id string, action string, kind string, value string, op string, day date")
    got = Counter((r["page_id"], r["verdict"], r["n_active"]) for r in url_filter.evaluate(caps, lists).collect())
    assert got == Counter({(1, "drop", 1): 2, (None, "drop", 1): 1, (2, "keep", 0): 1})
