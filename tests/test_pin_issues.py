"""The rules of single pins in one grouping."""

import random

from pyspark.sql import functions as F

from sheetgraph.operators import checks


def test_pin_issues_are_those_of_the_three_rules(spark):
    rng = random.Random(4)
    refs, pins = ["U1", "U2", "R1"], ["1", "2", "3"]
    types = ["power_in", "input", "output", "no_connect", None]
    pin_rows = [(d, r, p, rng.choice(types), rng.choice([30, 55, 70, None])) for d in range(40) for r in refs for p in pins if rng.random() < 0.9]
    pin_rows += pin_rows[:5]  # a pin that is listed twice
    eps = sorted({(d, r, p, rng.randrange(3)) for d in range(40) for r in refs for p in pins for _ in range(rng.randrange(3))})
    known = {(d, r, p) for d, r, p, *_ in pin_rows}
    ctx = [e for e in eps if e[:3] in known and e[3] < 2] * 2  # net 2 is not described, endpoints come twice
    ncs = [(d, r, p) for d in range(40) for r in refs for p in pins if rng.random() < 0.2] * 2 + [(1, None, "1")]
    net = "design_id long, ref string, pin string, net_id long"
    pin_df = spark.createDataFrame(pin_rows, "design_id long, ref string, number string, type string, conf_pct long")
    ends, seen, nc = spark.createDataFrame(eps, net), spark.createDataFrame(ctx, net).withColumn("net", F.concat(F.lit("N"), "net_id")), spark.createDataFrame(ncs, "design_id long, ref string, pin string")
    apart = [checks.erc_nc_connected(seen, nc), checks.erc_pin_multi_net(seen), checks.erc_unconnected(pin_df, ends, nc)]
    want = sorted(tuple(r) for df in apart for r in df.select("design_id", "code", "severity").collect())
    together = checks.pin_issues(seen, pin_df, ends, nc)
    assert together._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # seven before
    assert sorted(map(tuple, together.collect())) == want and len({c for _, c, _ in want}) == 5
