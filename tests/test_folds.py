"""Order-dependent operators against plain Python on small inputs."""

import datetime as dt
import random

from sheetgraph.operators import checks, cleaning, folds, geometry, layout, raster, review
from sheetgraph.sources import records
from sheetgraph.streaming import jobs


def at(i):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i)


def test_lifecycle(spark, tmp_path):
    rng = random.Random(1)
    rows = [(j, at(i), i, rng.choice(["edit", "review", "approve", "publish", "review", "approve"] + ["revoke"] * (i > 50))) for i in range(90) for j in (i % 4,)]
    want = {}
    for j, _, _, a in rows:
        s, ok, no = want.get(j, ("extracted", 0, 0))
        to = review.TRANSITIONS.get(s, {}).get(a)
        want[j] = (to, ok + 1, no) if to else (s, ok, no + 1)
    df = spark.createDataFrame(rows, "job_id long, ts timestamp, event_id long, action string")
    batch = {r[0]: tuple(r[1:]) for r in review.lifecycle_state(df).select("job_id", "state", "applied", "rejected").collect()}
    stream = jobs.run_to_end(jobs.stream_lifecycle(jobs.replay(spark, df, str(tmp_path))), str(tmp_path))
    assert batch == want == {r["job_id"]: (r["state"], r["applied"], r["rejected"]) for r in jobs.lifecycle_current(stream).collect()}
    assert jobs.lifecycle_rejected(stream).count() == sum(x[2] for x in want.values()) and stream.count() == len(rows)


def test_jobs_expire(spark, tmp_path):
    """A job without actions for a day expires once later events tell so."""
    day = 24 * 60
    rows = [(1, at(0), 1, "review"), (2, at(1), 2, "review"), (2, at(day), 3, "approve"), (3, at(3 * day), 4, "edit"), (3, at(3 * day + 1), 5, "review")]
    df = spark.createDataFrame(rows, "job_id long, ts timestamp, event_id long, action string")
    out = jobs.run_to_end(jobs.stream_lifecycle(jobs.replay(spark, df, str(tmp_path), parts=5), ttl_hours=24), str(tmp_path))
    assert {r["job_id"]: r["state"] for r in jobs.lifecycle_current(out).collect()} == {1: "expired", 2: "expired", 3: "reviewed"}


def test_expiry_does_not_depend_on_the_time_zone(spark, tmp_path):
    """Times of a group came as local times and were taken for UTC, so a job expired eight hours early."""
    df = spark.createDataFrame([(1, 10**9, 1, "review"), (3, 10**9 + 20 * 3600, 2, "edit")], "job_id long, s long, event_id long, action string").selectExpr("job_id", "timestamp_seconds(s) AS ts", "event_id", "action")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        out = jobs.run_to_end(jobs.stream_lifecycle(jobs.replay(spark, df, str(tmp_path)), ttl_hours=24), str(tmp_path))
        assert {r["job_id"]: r["state"] for r in jobs.lifecycle_current(out).collect()} == {1: "reviewed", 3: "edited"}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_lifecycle_groups_get_whole_numbers_for_times(spark):
    """Every column of a group is converted by itself, and a timestamp costs most."""
    plan = jobs.stream_lifecycle(spark.readStream.format("rate").load().selectExpr("value AS job_id", "timestamp AS ts", "value AS event_id", "'edit' AS action", "'' AS note"))
    assert "unix_micros(ts" in plan._jdf.queryExecution().analyzed().toString()


def test_nets_while_batches_arrive(spark, tmp_path):
    """After every arrival the nets of its designs are those of all that has arrived."""
    rows = [(d, b, 1, "A", r, "1", 50 + b, at(10 * b + d)) for b in range(3) for d in range(3) for r in (f"U{b}", f"R{d}")]
    df = spark.createDataFrame(rows, "design_id long, batch_no long, net_id long, name string, ref string, pin string, conf_pct long, ts timestamp")
    updates = jobs.stream_batches(jobs.replay(spark, df, str(tmp_path)), str(tmp_path))
    got = {r["design_id"]: r["n_endpoints"] for r in jobs.latest_nets(updates).collect()}
    assert got == {0: 4, 1: 4, 2: 4} and updates.select("arrival").distinct().count() >= 1


def test_ledger(spark, tmp_path):
    """Batch and stream against a plain loop over reservations by id; repeated and late entries change nothing."""
    rng = random.Random(3)
    rows, want = [], {}
    for p in range(8):
        wallet, seen = [0, 0, 0, 0], {}
        for k in range(60):
            op, amount, rid = rng.choice(["topup", "reserve", "reserve", "commit", "refund"]), rng.randint(0, 6), rng.randint(1, 25)
            rows.append((p, 1_700_000_000 + 7 * k, 100 * p + k, op, amount, None if op == "topup" else 1000 * p + rid))
            if op == "topup":
                wallet[0] += amount
            elif op == "reserve":
                if rid in seen or not amount:
                    continue
                if wallet[0] < amount:
                    wallet[3] += 1
                    continue
                seen[rid] = [amount, True]
                wallet = [wallet[0] - amount, wallet[1] + amount, wallet[2] + 1, wallet[3]]
            elif seen.get(rid, [0, False])[1]:
                seen[rid][1], back = False, seen[rid][0] if op == "refund" else 0
                wallet = [wallet[0] + back, wallet[1] - back, wallet[2] - 1, wallet[3]]
        want[p] = tuple(wallet)
    df = spark.createDataFrame(rows, "principal long, s long, event_id long, op string, amount long, reservation long").selectExpr("principal", "timestamp_seconds(s) AS ts", "event_id", "op", "amount", "reservation")
    batch = {r["principal"]: (r["balance"], r["spent"], r["open"], r["refused"]) for r in review.ledger_fold(df).collect()}
    stream = jobs.run_to_end(jobs.stream_ledger(jobs.replay(spark, df, str(tmp_path), parts=6)), str(tmp_path), "principal", "update")
    assert batch == want == {r["principal"]: (r["balance"], r["spent"], r["open"], r["refused"]) for r in stream.collect()}
    assert review.ledger_fold(df.limit(0)).count() == 0


def test_a_repeated_commit_or_refund_changes_nothing():
    w = review.Wallet()
    w.step("topup", 10, None)
    one = w.step("reserve", 4, None)
    assert one == (4, "reserved") and w.step("reserve", 4, one) is None and w.balance == 6
    done = w.step("commit", 0, one)
    assert done == (4, "committed") and w.step("commit", 0, done) is None and w.step("refund", 0, done) is None and (w.balance, w.spent, w.open) == (6, 4, 0)
    two = w.step("reserve", 6, None)
    back = w.step("refund", 0, two)
    assert back == (6, "refunded") and w.step("refund", 0, back) is None and (w.balance, w.spent, w.open) == (6, 4, 0)
    assert w.step("refund", 0, None) is None and w.step("reserve", 7, None) is None and w.refused == 1


def test_first_request_makes_the_job(spark, tmp_path):
    rows = [(i, at(i), 1, 7, "op", i % 3, 0) for i in range(12)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, tenant long, owner long, operation string, doc long, key long")
    assert jobs.run_to_end(jobs.stream_idempotent_jobs(jobs.replay(spark, df, str(tmp_path))), str(tmp_path)).count() == 3


def test_lines(spark):
    """A drifting baseline splits: items are held against the first item of the line."""
    items = [(1, 1, i, s, x, y, 10.0, h) for i, (s, x, y, h) in enumerate([("a", 0, 100, 9), ("b", 12, 97, 9), ("c", 40, 94, 9), ("d", 0, 50, 0), ("  ", 5, 50, 9), ("e", 11, 49, 9)])]
    df = spark.createDataFrame([(a, b, c, d, float(x), float(y), w, float(h)) for a, b, c, d, x, y, w, h in items], "doc_id long, page int, item_no long, str string, x double, y double, w double, h double")
    got = [r["text"] for r in layout.assemble_lines(layout.load_items(df)).orderBy("line_no").collect()]
    assert got == ["a b", "c", "d e"]


def test_thermal_pads(spark):
    lines = ["PIN NAME NO. TYPE DESCRIPTION", "EP Thermal pad", "A 1 I x", "B 2 O y", "C 3 NC", "D 4 I/O z", "EP Thermal pad", "EP Thermal pad", "7 Specifications", "EP Thermal pad"]
    df = spark.createDataFrame([(1, 1, i, t, 700.0) for i, t in enumerate(lines)], "doc_id long, page long, line_no long, text string, y double")
    region = layout.pin_region(df)
    pins = layout.pin_first_wins(layout.pin_rows(region))
    assert {r["number"]: r["type"] for r in pins.collect()} == {"1": "input", "2": "output", "3": "no_connect", "4": "bidirectional"}
    assert sorted(r["number"] for r in layout.pin_ep_rows(region, pins).collect()) == ["5", "6"]


def test_ascii_word_boundaries(spark):
    from pyspark.sql import functions as F

    from sheetgraph.functions.rx import matches

    df = spark.createDataFrame([("éGND x",), ("xGND",), ("a GND",)], "t string")
    assert [r[0] for r in df.select(matches(F.col("t"), r"\bGND\b")).collect()] == [True, False, True]


def test_interfaces_grow(spark):
    """Three groups of which two overlap only after growth; a reset line attaches, a lone net stands alone."""
    rows = [(1, 1, "SPI", "SCK", ["A", "B"]), (1, 2, "SPI", "MOSI", ["C", "D"]), (1, 3, "SPI", "MISO", ["A", "B", "C"]), (1, 4, "SPI", "CS", ["B", "C", "D"]), (1, 5, "SPI", "CS", ["D"]), (1, 6, "SPI", "x", ["Z"])]
    df = spark.createDataFrame([(d, n, t, r, m, 90) for d, n, t, r, m in rows], "design_id long, net_id long, type string, role string, members array<string>, conf_pct long")
    got = {r["net_id"]: r["iface"] for r in checks.interface_groups(df).collect()}
    assert got == {1: "SPI:A,B,C,D", 2: "SPI:A,B,C,D", 3: "SPI:A,B,C,D", 4: "SPI:A,B,C,D", 5: "SPI:A,B,C,D", 6: "SPI:Z"}


def test_anonymous_nets(spark):
    """A net that touches two groups joins the first; with transitive all three are one."""
    nets = [(0, ["a", "b"]), (1, ["c", "d"]), (2, ["b", "c"]), (3, ["x"])]
    df = spark.createDataFrame([(1, 0, n, " ", r, "1", 50 + n) for n, refs in nets for r in refs], "design_id long, batch_no long, net_id long, name string, ref string, pin string, conf_pct long")
    groups = lambda **k: sorted(sorted(r["ref"] for r in folds.batch_anonymous_nets(df, **k).where(f"net = 'N${i}'").collect()) for i in (1, 2))
    assert groups() == [["a", "b", "c"], ["c", "d"]] and groups(transitive=True) == [[], ["a", "b", "c", "d"]]


def test_figures_near_a_kept_one_go(spark):
    rows = [(1, i, "pin_configuration", "Top View", 1, y) for i, y in enumerate([0.1, 0.14, 0.18, 0.5])] + [(1, 9, "application", "Typical Application vs Load", 1, 0.8), (1, 10, "application", "Other", 1, 0.8)]
    df = spark.createDataFrame(rows, "doc_id long, fig_no long, kind string, title string, page long, y0 double")
    got = {r["fig_no"]: r["result"] for r in folds.figure_filter(df, packages=8).collect()}
    assert got == {0: "kept", 1: "duplicate_or_over_cap", 2: "kept", 3: "kept", 9: "blacklist_curve_plot", 10: "keyword_not_matched"}


def _profile(spark, rows, high=100, lines=(), **chrome):
    """A page of ten cells across and `high` down, with the given rows inked from side to side."""
    grid = spark.createDataFrame([(1, r, c) for r in rows for c in range(10)], "page_id long, r long, c long")
    sizes = spark.createDataFrame([(1, 40, high * 4, chrome.get("top"), chrome.get("bottom"))], "page_id long, w long, h long, chrome_top long, chrome_bottom long")
    return raster.ink_profile(grid, sizes, spark.createDataFrame(list(lines), "page_id long, text string, top long, bottom long"))


def test_ink_growth(spark):
    """At a height of 100 rows: gaps of 3 inside, of 6 before, 80 rows at most; body text and chrome stop."""
    grow = lambda profile, *anchors: {(r["anchor"], r["dir"]): r["last"] for r in raster.ink_grow(profile, spark.createDataFrame([(1, a, d) for a, d in anchors], "page_id long, anchor long, dir int")).collect()}
    rows = [5, 6, 10, 15, 16]
    assert grow(_profile(spark, rows), (2, 1), (20, -1), (13, -1), (30, 1), (9, 1), (500, -1)) == {(2, 1): 10, (20, -1): 15, (13, -1): 5, (9, 1): 10}
    text = [(1, "x" * 41, 32, 34), (1, "x" * 40, 20, 24)]
    assert grow(_profile(spark, rows, lines=text), (2, 1), (13, -1)) == {(2, 1): 6, (13, -1): 10}
    assert grow(_profile(spark, rows, top=24, bottom=40), (2, 1), (9, -1), (9, 1), (13, -1)) == {(9, -1): 6, (9, 1): 10}
    assert grow(_profile(spark, range(100)), (0, 1), (99, -1)) == {(0, 1): 81, (99, -1): 18}


def test_figure_fit(spark):
    fit = lambda profile, box=(None, None), *caps: [(r["method"], r["r0"], r["r1"]) for r in raster.figure_fit(profile, spark.createDataFrame([(1, 7, *box)], "page_id long, fig_no long, y0 double, y1 double"), spark.createDataFrame([(1, 7, *c) for c in caps], "page_id long, fig_no long, text string, top long, bottom long")).collect()]
    page = _profile(spark, [*range(10, 21), *range(26, 28), *range(33, 60)])
    assert fit(page, (None, None), ("Figure 1. Both", 96, 100)) == [("caption_up", 10, 25)]
    assert fit(page, (None, None), ("7.2 Both", 112, 116)) == [("caption_down", 28, 59)]
    assert fit(page, (None, None), ("Both", 112, 116)) == [("caption_down", 28, 59)]  # more ink below
    assert fit(page, (None, None), ("Figure 1. Last", 352, 356)) == [("largest_block", 33, 59)]  # nothing near on either side
    assert fit(page, (None, None), ("7.2 Last", 248, 252)) == [("caption_up", 33, 63)]  # nothing below
    assert fit(page, (0.05, 0.15)) == [("seed_trim", 10, 20)] and fit(page, (0.8, 0.92)) == [("seed_mirror", 10, 20)]
    # Too low a block is none; a block that holds the middle of the box counts half as much again
    assert fit(_profile(spark, [10, 11, 50])) == []
    blocks = _profile(spark, [*range(0, 30), *range(40, 64)], lines=[(1, "x" * 50, 200, 200)])
    assert fit(blocks) == [("largest_block", 0, 29)]
    assert fit(_profile(spark, [])) == [] and fit(_profile(spark, range(100))) == []  # blank, and higher than a figure may be


def test_lenient_json(spark):
    good = '{"components": [{"ref": "U1"}], "nets": []}'
    rows = [(1, good), (2, f"```json\n{good}\n```"), (3, '{components: [{"ref": "U1",}], "nets" []}'), (4, '{"components": []}'), (5, "nothing"), (6, None), (7, '{"components": [{"ref": "a"}{"ref": "b"}], "nets": []}')]
    ok, bad = records.lenient_json(spark.createDataFrame(rows, "id long, text string"))
    assert sorted(r["id"] for r in ok.collect()) == [1, 2, 3, 7] and sorted(r["id"] for r in bad.collect()) == [4, 5, 6]


def test_cleaning_twice_changes_nothing(spark):
    raw = spark.createDataFrame([(1, 1, "1,2", " a ", "input"), (1, 2, "2", "b", "odd"), (1, 3, "EP", "", "unspecified"), (1, 4, None, "x", "input"), (1, 5, "", "y", "input")], "package_id long, pos long, number string, name string, type string")
    once = cleaning.sanitize_pins(raw)
    again = cleaning.sanitize_pins(once.drop("part"))
    row = lambda df: sorted((r["number"], r["name"], r["type"]) for r in df.collect())
    assert row(once) == row(again) == [("1", "a", "input"), ("2", "a", "input"), ("EP", "NC", "unspecified")]
    assert {r["number"]: r["name"] for r in cleaning.renumber_ep(once).collect()} == {"1": "a", "2": "a", "3": "EP"}


def test_five_pin_package(spark):
    p = spark.createDataFrame([(1, "SOT-23-5", "dual", 5, 0.95, 2.9, 1.6, 1.45, 2.8, 0.4, 7.62)], "package_id long, type string, family string, pin_count long, pitch double, body_length double, body_width double, height double, lead_span double, lead_length double, row_span double")
    y = {r["number"]: (r["x"] < 0, r["y"]) for r in geometry.pad_table(p).collect()}
    assert y == {"1": (True, -0.95), "2": (True, 0.0), "3": (True, 0.95), "4": (False, 0.95), "5": (False, -0.95)}


def test_jobs_are_written_once_a_revision(spark, tmp_path):
    """A batch that is written again replaces itself; a revision that comes in two batches counts once."""
    jobs_of = lambda rows: {"jobs": spark.createDataFrame(rows, "tenant long, job_id long, revision long, status string")}
    first = jobs_of([(1, 5, 1, "a"), (2, 6, 1, "b")])
    for batch in (1, 1, 2):
        records.job_write(first, str(tmp_path), batch)
    records.job_write(jobs_of([(1, 5, 2, "c")]), str(tmp_path), 3)
    got = records.job_read(spark, str(tmp_path), "jobs")
    assert sorted((r["tenant"], r["job_id"], r["revision"], r["status"]) for r in got.collect()) == [(1, 5, 1, "a"), (1, 5, 2, "c"), (2, 6, 1, "b")]
    assert (tmp_path / "jobs" / "batch=1" / "tenant=1").is_dir()


def test_no_reference_is_dropped(spark):
    df = spark.createDataFrame([(1, 0, f"R{i}") for i in range(500)] + [(2, 0, "U1")], "design_id long, batch_no long, ref string")
    calls = lambda refs: [(r, str(len(refs))) for r in refs]
    got = {(r["design_id"], r["ref"]): int(r["value"]) for r in folds.enrich_batches(df, calls).collect()}
    assert len(got) == 501 and max(got.values()) == 220 and got[2, "U1"] == 1


def test_edits_of_boxes_and_evidence(spark):
    ask = [
        ("figures/bbox", "[0.1,0.2,0.3,0.4]", "x", None, None), ("figures/bbox", "[0.3,0.2,0.1,0.4]", "x", None, "not_a_box"), ("figures/bbox", "[0,0,1,1.5]", "x", None, "not_a_box"),
        ("figures/bbox", "[0,0,1]", "x", None, "not_a_box"), ("figures/bbox", "no", "x", None, "not_a_box"), ("figures/bbox", None, "x", None, "not_a_box"), ("pins/type", None, "x", None, "unknown_type"),
        ("pins/type", "input", "", None, "reason_missing"), ("pins/type", "input", "", '{"page": 2}', None), ("pins/type", "input", " ", '{"note": ""}', "reason_missing"),
        ("packages/pitch", "0.5", "x", '{"page": 1.5}', "evidence_page"), ("packages/pitch", "0.5", "x", '{"bbox": [0,0,1,1], "quotedText": "q"}', None), ("packages/pitch", "0.5", "x", '{"bbox": [1,0,0,1]}', "evidence_bbox"),
        ("packages/pitch", "0.5", "x", "nonsense", "evidence_not_an_object"), ("packages/pin_count", "8.5", "x", None, "not_whole"), ("packages/pin_count", "300", "x", None, "out_of_range"),
        ("packages/lead_width", None, "x", None, None), ("packages/pitch", None, "x", None, "not_a_number"), ("packages/pitch", "NaN", "x", None, "not_a_number"), ("figures/page", "0", "x", None, "not_a_page"),
    ]
    df = spark.createDataFrame([(i, 1, *a[:4]) for i, a in enumerate(ask)], "event_id long, job_id long, path string, value string, reason string, evidence string")
    got = {r["event_id"]: r["error"] for r in review.patch_validate(df).collect()}
    assert [got[i] for i in range(len(ask))] == [a[4] for a in ask]


def test_approvals_lapse(spark):
    frame = lambda rows, s: spark.createDataFrame(rows, s)
    changes = frame([(1, "part.mpn"), (2, "pinsets[a].pin[1].name"), (3, "packages[p].pinset_id"), (4, "partial"), (4, "figures[f].title")], "job_id long, path string")
    packages = frame([(2, "p", "a"), (2, "q", "b"), (3, "p", "a")], "job_id long, package_id string, pinset_id string")
    keys = ["symbol:a", "symbol:b", "footprint:p", "footprint:q", "model3d:p", "figure:f", "figure:g"]
    approvals = frame([(j, k) for j in range(1, 5) for k in keys], "job_id long, key string")
    got = {}
    for r in review.approvals_invalidated(changes, packages, approvals).collect():
        got.setdefault(r["job_id"], set()).add(r["key"])
    assert got == {1: set(keys), 2: {"symbol:a", "footprint:p", "model3d:p"}, 3: {"symbol:a", "symbol:b", "footprint:p", "model3d:p"}, 4: {"figure:f"}}


def test_ledger_stream_looks_once_at_a_reservation():
    """Every entry read its reservation's state, and wrote it, by messages to the JVM; a new principal has none to read."""
    import pandas as pd

    from sheetgraph.streaming import jobs

    class Store(dict):
        looks = writes = 0

        def getValue(self, k):
            self.looks += 1
            return self.get(k)

        def updateValue(self, k, v):
            self.writes += 1
            self[k] = v

    class Sums:
        value = None

        def get(self):
            return self.value

        def update(self, v):
            self.value = v

    w = jobs.Wallets()
    w.wallet, w.reservations = Sums(), Store()
    ops = [("topup", 10, None), ("reserve", 4, 7), ("commit", 0, 7), ("refund", 0, 7), ("refund", 0, 7), ("reserve", 3, 8), ("reserve", 9, 9)]
    frame = lambda ops, at: pd.DataFrame([(at, at + i, *o) for i, o in enumerate(ops)], columns=["ts", "event_id", "op", "amount", "reservation"])
    got = [next(iter(w.handleInputRows((1,), iter([frame(ops, 0)]), None)))]
    assert (w.reservations.looks, w.reservations.writes) == (0, 2) and w.reservations == {(7,): (4, "committed"), (8,): (3, "reserved")}
    got.append(next(iter(w.handleInputRows((1,), iter([frame([("refund", 0, 8), ("refund", 0, 8), ("commit", 0, 7)], 100)]), None))))
    assert (w.reservations.looks, w.reservations.writes) == (2, 3) and w.reservations[8,] == (3, "refunded")
    assert [tuple(g.iloc[0]) for g in got] == [(1, 3, 7, 1, 1), (1, 6, 4, 0, 1)]


def test_anonymous_nets_make_no_frame_a_net(monkeypatch):
    """A design's nets were taken as one data frame each."""
    import pandas as pd

    rows = [(1, b, n, f"R{(n + k) % 9}", "1", 50 + n) for b in (1, 0) for n in (3, 2, 1) for k in (0, b + 1)] + [(1, 0, 9, "X", "1", 99)]
    pdf = pd.DataFrame(rows, columns=["design_id", "batch_no", "net_id", "ref", "pin", "conf_pct"])
    monkeypatch.setattr(pd.DataFrame, "groupby", lambda *a, **k: 1 / 0)
    got = folds._merge_anonymous(False)(pdf)
    assert {(r.net, r.ref, r.conf_pct) for r in got.itertuples()} == {("N$1", f"R{k}", 53) for k in (1, 2, 3, 4, 5)}
