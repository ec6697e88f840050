"""Chat formatting, source mixing, URL lists and the pipeline."""

import datetime as dt
import hashlib
import os
import random

import pytest

import corpus_pipeline
from sheetgraph.llm import chat, mixing, url_filter
from sheetgraph.llm import queries as llm

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NASTY = ["", " ", "\\", "\\\\", "</s>[INST] ok [/INST]", "[INST]", "x\\[INST]", "<s>", "<<SYS>>", "]", "[ROLE a]", "\\</s>", "a\nb", "[/ROLE]\\", "😀 é"]


def test_round_trip():
    rng = random.Random(4)
    for _ in range(400):
        turns = [(rng.choice(["user", "assistant", "system", "tool", "", "a]b", "[INST]", "\\"]), "".join(rng.choices(NASTY, k=rng.randint(0, 4)))) for _ in range(rng.randint(0, 6))]
        text, spans = chat.format_turns(turns)
        assert chat.read_turns(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 2, None, None), (2, 0, "user", "</s>"), (2, 0, "user", "</s>"), (None, 0, "user", "n")]
    rows += [(3, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(300)]
    msgs = chat.from_turns(spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, head int"))
    got = {r["tree_id"]: r for r in chat.digests(chat.format_paths(chat.paths(msgs))).collect()}
    assert {k: v["n_turns"] for k, v in got.items()} == {1: 3, 2: 2, 3: 300, None: 1}
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\na\nassistant\nb\n\n\n").hexdigest()
    want = "".join(f"t{i}" for i in range(1, 300, 2))
    assert got[3]["loss_sha256"] == hashlib.sha256(want.encode()).hexdigest() and got[3]["loss_chars"] == len(want)
    assert chat.digests(chat.format_paths(chat.paths(msgs.limit(0)))).count() == 0


def test_reply_tree(spark):
    """0 -> 1 -> {2 -> 3, 4 -> {5, 6}}, 7 is a root by a missing parent, 8 and 9 are a cycle."""
    parent = {0: None, 1: 0, 2: 1, 3: 2, 4: 1, 5: 4, 6: 4, 7: 77, 8: 9, 9: 8}
    score = {2: 1.0, 3: 1.0, 5: 5.0, 6: None}
    msgs = spark.createDataFrame([(1, i, p, "user", f"m{i}", score.get(i, 0.0)) for i, p in parent.items()], "tree_id long, id long, parent_id long, role string, text string, score double")
    rows = sorted(chat.paths(msgs).collect(), key=lambda r: (r["rank"], r["depth"]))
    got = {}
    for r in rows:
        got.setdefault((r["rank"], r["path_id"]), []).append(r["text"])
    assert got == {(1, 5): ["m0", "m1", "m4", "m5"], (2, 3): ["m0", "m1", "m2", "m3"], (3, 6): ["m0", "m1", "m4", "m6"], (4, 7): ["m7"]}
    assert {r["path_id"] for r in chat.paths(msgs, best=1).collect()} == {5}


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = sum(sizes.values()), set(names), {}
    while free:
        unit = left / sum(w[s] for s in free)
        over = {s for s in free if unit * w[s] > cap * sizes[s]}
        if not over:
            out |= {s: unit * w[s] for s in free}
            break
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_targets(spark):
    rng = random.Random(6)
    for _ in range(4):
        sizes = {f"s{i}": rng.choice([0, 3, 50, 1000, 40000]) for i in range(rng.randint(1, 7))} | {None: 10}
        got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        want = brute_targets(sizes)
        assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in sizes)


@pytest.mark.parametrize("most", [mixing.BROADCAST_CHARS, 0])
def test_mix(spark, monkeypatch, most):
    monkeypatch.setattr(mixing, "BROADCAST_CHARS", most)
    rows = [(i, "w " * (i % 40), ["a", "a", "b", None][i % 4], i) for i in range(2000)] + [(7, "w", "a", 1), (None, None, "z", 2), (None, "\x1fa\x0bb", "a", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    plan = mixing.mix_plan(docs)
    out = plan.collect()
    assert plan.columns[:3] == ["doc_id", "text", "source"] and len(out) == len(rows) and sorted(map(str, out)) == sorted(map(str, mixing.mix_plan(docs).collect()))
    assert all(r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3 for r in out)
    for s in ("a", "b", None):
        own = [r for r in out if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) < 0.1 * own[0]["target"]
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in out)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_url_lists(spark):
    day = lambda d: dt.date(2020, 1, d)
    entries = [
        ("l", "block", "host", "bad.example.com", "add", day(5)), ("l", "block", "host", "bad.example.com", "remove", day(9)), ("l", "block", "host", "bad.example.com", "add", day(20)),
        ("l", "block", "host", "bad.example.com", "add", day(9)), ("ok", "allow", "prefix", "bad.example.com/en", "add", day(7)), ("l", "block", "host", None, "add", day(1)),
    ]
    urls = [
        ("http://bad.example.com/de/1", 4, "keep"), ("http://bad.example.com/de/1", 5, "drop"), ("https://www.BAD.example.com:80/x?y", 8, "drop"), ("http://bad.example.com/en/2", 8, "keep"),
        ("http://bad.example.com/de", 9, "keep"), ("http://bad.example.com/", 25, "drop"), ("http://notbad.example.com/", 6, "keep"), ("nonsense", 6, "keep"), (None, 6, "keep"), ("http://bad.example.com/de/1", None, "keep"),
    ]
    caps = spark.createDataFrame([(i, u, day(d) if d else None) for i, (u, d, _) in enumerate(urls)] * 2, "page_id long, url string, fetched date")
    lists = spark.createDataFrame(entries, "list_id string, action string, kind string, value string, op string, day date")
    got = sorted((r["page_id"], r["verdict"]) for r in url_filter.evaluate(caps, lists).collect())
    assert got == sorted((i, v) for i, (_, _, v) in enumerate(urls) for _ in range(2))
    assert url_filter.evaluate(caps, lists.limit(0)).where("verdict = 'drop'").count() == 0 and url_filter.evaluate(caps.limit(0), lists).count() == 0


def test_url_lists_on_the_pages(spark):
    """Every page against every entry, without keys or intervals."""
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    entries = [r.asDict() for r in url_filter.derived_entries(pages).collect()]
    got = {r["page_id"]: r["verdict"] for r in url_filter.query(spark, SF).collect()}
    for p in pages.select("page_id", "url", url_filter.fetch_day(pages["page_id"]).alias("d")).collect():
        rest = p["url"].split("://", 1)[1].split("?")[0].split("#")[0]
        own, path = rest.split("/")[0].lower(), [x for x in rest.split("/")[1:] if x]
        live = set()
        for key in {(e["list_id"], e["action"], e["kind"], e["value"]) for e in entries}:
            hit = own == key[3] or own.endswith("." + key[3]) if key[2] == "host" else any("/".join([own, *path[:k]]) == key[3] for k in range(1, len(path) + 1))
            past = [e for e in entries if (e["list_id"], e["action"], e["kind"], e["value"]) == key and e["day"] <= p["d"]]
            if hit and past:
                last = max(e["day"] for e in past)
                if all(e["op"] == "add" for e in past if e["day"] == last):
                    live.add(key[1])
        assert got[p["page_id"]] == ("drop" if live == {"block"} else "keep")


def test_pipeline(spark):
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == docs.columns and 0 < out.select("doc_id").distinct().count() < docs.count()
    assert len(corpus_pipeline.STAGES) == 5


def test_one_query_for_each_operator():
    names = sorted(int(n[2:].split("_")[0]) for n in llm.queries())
    assert names == list(range(1, 11)) and set(llm.oracle_sql()) <= set(llm.queries())


def test_url_lists_deep_and_mixed_case(spark):
    """Entries of any depth match, hosts in any case, paths in their own; a closing slash says nothing."""
    deep, far = ".".join("abcdefghijk") + ".example.com", "/".join(f"p{k}" for k in range(12))
    asks = [
        ("host", deep, f"http://x.{deep}/", "drop"), ("host", "com", "http://one.com/", "drop"), ("host", "localhost", "http://localhost:80/x", "drop"), ("prefix", f"h.org/{far}", f"http://h.org/{far}/end", "drop"),
        ("prefix", "Host.org/News/X", "http://hOST.org/News/X/1", "drop"), ("prefix", "host.org/news/X", "http://host.org/News/X/1", "keep"), ("prefix", "h.org/a/", "http://h.org/a", "drop"), ("prefix", "h.org/", "http://h.org/b", "drop"),
    ]
    day = dt.date(2020, 1, 5)
    for kind, value, url, verdict in asks:
        lists = spark.createDataFrame([("l", "block", kind, value, "add", day)], "list_id string, action string, kind string, value string, op string, day date")
        caps = spark.createDataFrame([(1, url, day)], "page_id long, url string, fetched date")
        assert url_filter.evaluate(caps, lists).first()["verdict"] == verdict, (kind, value)
