"""Plans that hold at size: nothing large through the driver, nothing large in one task."""

import os

import pytest
from pyspark.sql import functions as F

from sheetgraph import plans
from sheetgraph.operators import checks
from sheetgraph.plans import fixtures

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@tables
def test_pinset_overlay_broadcasts_no_exploded_pins(spark):
    assert "BroadcastExchange" not in plan_of(plans.QUERIES["pinset_overlay"](spark, SF))


@tables
def test_kept_tables_are_not_broadcast(spark):
    t = fixtures.Tables(spark, SF)
    joined = t.eps.groupBy("design_id", "net_id").agg(F.count("*").alias("n")).join(t.nets.where("net_id > 3"), ["design_id", "net_id"])
    assert "BroadcastExchange" not in plan_of(joined)


@tables
def test_packages_are_spread_before_their_pins_are_made(spark):
    plan = plan_of(plans.QUERIES["sanitize_pins"](spark, SF))
    assert "REPARTITION_BY_NUM" in plan.split("Generate", 3)[-1] and plan.count("Exchange") == 1


def test_grown_group_makes_no_pairs_alone(spark, monkeypatch):
    """A group of 400 members that meets no other made 79,800 pairs; a small one that shares two members joins it."""
    rows = [("d", "SPI", 1, [f"U{i:03}" for i in range(400)]), ("d", "SPI", 2, ["U001", "U399", "X1"]), ("d", "SPI", 3, ["X1", "X2"]), ("e", "SPI", 1, [f"U{i:03}" for i in range(400)])]
    df = spark.createDataFrame(rows, "design_id string, type string, net_id long, members array<string>")
    got = {(r["design_id"], r["grp"]): (len(r["refs"]), sorted(r["nets"])) for r in checks._grown(df).collect()}
    assert got == {("d", 1): (401, [1, 2]), ("d", 3): (2, [3]), ("e", 1): (400, [1])}
    made = []
    real = checks.cut
    monkeypatch.setattr(checks, "cut", lambda d: made.append(plan_of(d)) or real(d))
    checks._grown(df).count()
    assert made and not any("BroadcastExchange" in p for p in made)


@tables
def test_netlist_reads_the_line_items_once(spark, monkeypatch):
    made, real = [], fixtures.cut
    monkeypatch.setattr(fixtures, "cut", lambda d: made.append(plan_of(d)) or real(d))
    fixtures.release()
    t = fixtures.Tables(spark, SF)
    for name in ("eps", "comps", "pins", "nets", "ncs"):
        getattr(t, name).count()
    assert sum("lineitem.parquet" in p for p in made) == 1


def test_pin_of_several_nets_counts_nets_of_one_name(spark):
    ctx = spark.createDataFrame([(1, "U1", "1", 1, "A"), (1, "U1", "1", 2, "A"), (1, "U1", "2", 3, "B"), (1, "U1", "2", 3, "B")], "design_id int, ref string, pin string, net_id int, net string")
    out = checks.erc_pin_multi_net(ctx)
    assert plan_of(out).count("Exchange") == 1
    assert [(r["refs"], r["nets"]) for r in out.collect()] == [("U1.1", "A")]


@tables
def test_url_check_and_its_sql_on_large_page_ids(spark, tmp_path):
    """Groups of an IPv6 address have at most four digits; ids of five digits made such groups, which the SQL took."""
    import duckdb

    (tmp_path / "pages.parquet").mkdir()
    duck = duckdb.connect()
    duck.sql(f"COPY (SELECT range AS page_id, 'http://example.com/' AS url, '' AS html FROM range(9990, 10038)) TO '{tmp_path}/pages.parquet/part.parquet'")
    duck.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = {r["page_id"]: r["result"] for r in plans.QUERIES["url_check"](spark, str(tmp_path)).collect()}
    want = dict(duck.sql(f"SELECT page_id, result FROM ({plans.ORACLES['url_check']})").fetchall())
    assert got == want and got[10002] == "invalid" and got[9990] != "invalid"


def test_replay_deals_rows_of_one_time_out_in_order(spark, tmp_path):
    """All rows of one ts went through one task into one file."""
    from sheetgraph.streaming import jobs

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(4000).select(F.timestamp_seconds(F.lit(5)).alias("ts"), (3999 - F.col("id")).alias("event_id"))
        jobs.replay(spark, rows, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted(tmp_path.glob("*/part=*/part-*.parquet"), key=lambda f: f.stat().st_mtime)
    spans = [spark.read.parquet(str(f)).agg(F.min("event_id"), F.max("event_id"), F.count("*")).first() for f in files]
    spans = [s for s in spans if s[2]]
    assert len(spans) > 1 and sum(s[2] for s in spans) == 4000 and max(s[2] for s in spans) < 2000
    assert all(a[1] < b[0] for a, b in zip(spans[:-1], spans[1:], strict=True))


@tables
@pytest.mark.parametrize("name", ["interface_groups", "interface_sideband", "quality_score", "quality_gate", "quality_issues", "health_score"])
def test_groups_and_signals_are_not_broadcast(spark, monkeypatch, name):
    """Rows exploded from groups, and a row a design, were broadcast for as small as their compressed files."""
    made, real = [], fixtures.cut
    monkeypatch.setattr(fixtures, "cut", lambda d: made.append(plan_of(d)) or real(d))
    fixtures.release()
    made.append(plan_of(plans.QUERIES[name](spark, SF)))
    fixtures.release()
    joins = [line for p in made for line in p.splitlines() if "BroadcastHashJoin" in line and "part#" not in line]
    assert not joins


@tables
def test_named_queries_group_nets_once_and_broadcast_nothing_that_grows(spark, monkeypatch):
    """Three queries grouped the nets each for itself and told types and roles at every reading; the signals' plan held the health's."""
    names = ["interface_groups", "interface_sideband", "interface_complete", "erc_iface_incomplete", "proto_spi_cs", "proto_uart", "proto_usb_c_cc", "proto_debug", "proto_spi_miso", "proto_spi_driver", "health_score", "quality_gate"]
    made, real, rounds, grown = [], fixtures.cut, [], checks._grown
    monkeypatch.setattr(fixtures, "cut", lambda d: made.append(plan_of(d)) or real(d))
    monkeypatch.setattr(checks, "_grown", lambda strong: rounds.append(plan_of(strong)) or grown(strong))
    fixtures.release()
    for name in names:
        made.append(plan_of(plans.QUERIES[name](spark, SF)))
    tables = {k[2] for k in fixtures._kept}
    fixtures.release()
    assert len(rounds) == 1 and "RLIKE" not in rounds[0] and {"candidates", "groups", "health", "signals"} <= tables
    assert not [line for p in made for line in p.splitlines() if "BroadcastHashJoin" in line and "part#" not in line]
