"""Scopes of requests, hints for an extractor, pages to send, on small made-up rows."""

import hashlib

from pyspark.sql import functions as F

from sheetgraph.operators import folds, layout, review


def test_scopes_expire_and_are_revoked(spark):
    """A job is reused until it ends, its last instant included; the first request after that opens the next; a revocation clears it."""
    asked = [(1, 0, "k"), (2, 60, "k"), (3, 100, "k"), (4, 101, "k"), (5, 201, "k"), (6, 230, "k"), (7, 240, "k"), (8, 5, None), (9, 6, None), (10, 50, "other")]
    df = spark.createDataFrame([(e, s, 1, 1, "op", 1, k) for e, s, k in asked], "event_id long, s long, tenant long, owner long, operation string, doc long, key string").withColumn("ts", F.timestamp_seconds("s"))
    gone = df.where("event_id = 1").select(review.scope_key().alias("scope")).selectExpr("scope", "timestamp_seconds(220) AS ts")
    got = {r["event_id"]: (r["job"], r["reused"]) for r in review.idempotency_scope(df, 100, gone).collect()}
    assert got == {1: (1, False), 2: (1, True), 3: (1, True), 4: (4, False), 5: (4, True), 6: (6, False), 7: (6, True), 8: (8, False), 9: (9, False), 10: (10, False)}


def test_hints_are_bounded(spark):
    refs = spark.createDataFrame([(1, f"U{i:03}") for i in range(300)] + [(2, "R1")], "design_id long, ref string")
    labels = spark.createDataFrame([(1, f"N{i:03}") for i in range(150)], "design_id long, label string")
    pairs = spark.createDataFrame([(1, f"U{i:03}", "v", 0.64 + 0.01 * (i % 2)) for i in range(300)], "design_id long, ref string, value string, confidence double")
    hints = folds.census_hints(refs, labels, pairs)
    batches = spark.createDataFrame([(1, 0, "U001"), (1, 0, "U002"), (2, 0, "R1"), (3, 0, "X")], "design_id long, batch_no long, ref string")
    told = lambda own, h: [(r, f"{len(own)} {len(h['refs'])} {len(h['labels'])} {len(h['pairs'])}") for r in own]
    got = {(r["design_id"], r["ref"]): r["value"] for r in folds.enrich_batches(batches, told, hints=hints).collect()}
    assert got == {(1, "U001"): "2 220 100 80", (1, "U002"): "2 220 100 80", (2, "R1"): "1 1 0 0", (3, "X"): "1 0 0 0"}


def test_pages_to_send(spark):
    """Relevant pages, keyword pages, page 1 with the text tail, and scans; pages that must stay go with any choice."""
    lines = [(d, p, "words") for d in (1, 2, 3, 5) for p in range(1, 31)] + [(2, 7, "Package Outline"), (2, 29, "引脚")] + [(4, p, " ") for p in (1, 2)]
    df = spark.createDataFrame(lines, "doc_id long, page long, text string")
    relevant = spark.createDataFrame([(1, 3), (1, 4)], "doc_id long, page long")
    ocr = spark.createDataFrame([(1, 9, True), (3, 30, False), (4, 1, True), (4, 2, True)], "doc_id long, page long, must_keep boolean")
    got = {}
    for r in layout.page_strategy(df, relevant, ocr).collect():
        got.setdefault((r["doc_id"], r["strategy"], r["sliced"]), []).append(r["page"])
    assert {k: sorted(v) for k, v in got.items()} == {
        (1, "parser_relevant_pages+ocr_must_keep", True): [3, 4, 9], (2, "keyword_pages", True): [1, 7, 29], (3, "first_plus_text_tail", True): [1, *range(22, 30)],
        (4, "scanned_no_ocr_worker", False): [1, 2], (5, "first_plus_text_tail", True): [1, *range(23, 31)],
    }


def test_a_changed_file_moves_its_keys_and_the_revision(spark):
    keys = spark.createDataFrame([(1, "symbol", 4, "symbol:4", None), (1, "figure", 2, "figure:2", "0,0,1,1"), (1, "model3d", 9, "model3d:9", None), (2, "symbol", 4, "symbol:4", None)], "job_id long, kind string, owner long, key string, instead string")
    files = [(1, "symbol", 4, "a.sym", "s1"), (1, "symbol", 4, "b.sym", "s2"), (2, "symbol", 4, "a.sym", "s1"), (1, "symbol", 5, "c.sym", "s3")]
    hashes = lambda files: {(r["job_id"], r["key"]): (r["hash"], r["files"]) for r in review.asset_hashes(spark.createDataFrame(files, "job_id long, kind string, owner long, path string, sha string"), keys).collect()}
    before, again, after = hashes(files), hashes(files + files), hashes([(1, "symbol", 4, "a.sym", "new"), *files[1:]])
    assert before == again and {k for k in before if before[k] != after[k]} == {(1, "symbol:4"), (1, "revision")}
    assert before[1, "figure:2"] == (hashlib.sha256(b"0,0,1,1").hexdigest(), 0) and before[1, "model3d:9"][0] == hashlib.sha256(b"").hexdigest()
    assert before[1, "symbol:4"][1] == 2 and before[1, "revision"][1] == 2 and before[2, "revision"][1] == 1
