"""Interfaces behind the protocol rules, on small made-up designs."""

import random

import pytest

from sheetgraph.operators import checks

CTX = "design_id long, net_id long, net string, net_conf long, ref string, pin string, pin_name string, type string, pin_conf long"


def context(spark, rows):
    """rows: (design, net_id, net, ref, pin, pin_name, type)."""
    return spark.createDataFrame([(d, i, n, 90, r, p, pn, t, 90) for d, i, n, r, p, pn, t in rows], CTX)


def analysed(spark, ctx):
    nets = checks.net_facts(ctx)
    roles = checks.interface_role(checks.interface_type(nets).where("type <> 'POWER'"))
    ifaces = checks.interface_groups(checks.interface_candidates(nets)).join(roles, ["design_id", "net_id", "type"])
    return nets, ifaces, checks.interface_facts(ifaces, nets)


def bus(design, first, names, refs, kinds=None):
    return [(design, first + i, n, r, str(i + 1), n.split("_")[0], (kinds or {}).get(r, "bidirectional")) for i, n in enumerate(names) for r in refs]


def test_two_buses_of_one_design(spark):
    """Both I2C buses are found and checked: one has pull-ups, the other none and a push-pull output."""
    rows = bus(1, 10, ["SDA_A", "SCL_A"], ["U1", "U2"]) + bus(1, 20, ["SDA_B", "SCL_B"], ["U3", "U4"], {"U4": "output"})
    rows += [(1, 10, "SDA_A", "R1", "1", "1", "passive"), (1, 11, "SCL_A", "R2", "1", "1", "passive"), (1, 30, "VCC", "R1", "2", "2", "passive"), (1, 30, "VCC", "R2", "2", "2", "passive")]
    ctx = context(spark, rows)
    pins = spark.createDataFrame([(1, r, n) for r in ("R1", "R2") for n in ("1", "2")], "design_id long, ref string, number string")
    _, ifaces, facts = analysed(spark, ctx)
    assert {(r["iface"], r["net_id"]) for r in ifaces.collect()} == {("I2C:U1,U2", 10), ("I2C:U1,U2", 11), ("I2C:U3,U4", 20), ("I2C:U3,U4", 21)}
    comps = spark.createDataFrame([(1, "U1", "MCU")], "design_id long, ref string, value string")
    got = {(r["iface"], r["code"], r["status"]) for r in checks.protocol_checks(facts, ctx, pins, comps).collect()}
    want = {("I2C:U1,U2", f"I2C_{x}_PULLUP_OK", "pass") for x in ("SDA", "SCL")} | {("I2C:U3,U4", f"I2C_{x}_PULLUP_MISSING", "warning") for x in ("SDA", "SCL")}
    assert got == want | {("I2C:U3,U4", f"I2C_{x}_DRIVE_TYPE", "review") for x in ("SDA", "SCL")}
    summary = {r["iface"]: (r["pass"], r["review"], r["warning"], r["worst"]) for r in checks.proto_summary(checks.protocol_checks(facts, ctx, pins, comps)).collect()}
    assert summary == {"I2C:U1,U2": (2, 0, 0, "pass"), "I2C:U3,U4": (0, 2, 2, "warning")}


def test_spi_chip_selects_per_interface(spark):
    """A chip select attaches to the bus of its device; a slave without one is named. Masters of one bus don't cover another."""
    rows = bus(1, 10, ["MOSI", "MISO", "SCK"], ["U1", "U2", "U3"], {"U1": "output"}) + [(1, 15, "CS", "U2", "9", "CS", "input")]
    rows += bus(1, 20, ["MOSI_2", "SCK_2"], ["U7", "U8"])
    _, ifaces, facts = analysed(spark, context(spark, rows))
    assert {(r["iface"], r["net_id"]) for r in ifaces.where("role = 'CS'").collect()} == {("SPI:U1,U2,U3", 15)}
    got = {(r["iface"], r["code"], r["refs"]) for r in checks.proto_spi_cs(facts).collect()}
    assert got == {("SPI:U1,U2,U3", "SPI_CS_COVERAGE", "U3")}
    assert {r["iface"]: r["missing"] for r in checks.interface_complete(facts).collect()} == {"SPI:U1,U2,U3": "", "SPI:U7,U8": "MISO"}
    assert {r["net_id"] for r in checks.shared_miso(ifaces).collect()} == {11}


def slow_groups(nets):
    groups = [[set(m), {i}] for i, m in sorted(nets.items()) if len(m) >= 2]
    while True:
        hit = next(((a, b) for a in range(len(groups)) for b in range(a + 1, len(groups)) if len(groups[a][0] & groups[b][0]) >= 2), None)
        if hit is None:
            return {min(g[1]): (tuple(sorted(g[0])), tuple(sorted(g[1]))) for g in groups}
        a, b = hit
        groups[a] = [groups[a][0] | groups[b][0], groups[a][1] | groups[b][1]]
        del groups[b]


@pytest.mark.parametrize("seed", [1, 2])
def test_grouping_is_the_fixpoint(spark, seed):
    """Chains that only meet once groups have grown, and many nets of the same members, in designs of any size."""
    rng = random.Random(seed)
    nets = {}
    for d in range(6):
        for i in range(60):
            nets[d, i] = [f"U{x}" for x in rng.sample(range(rng.choice([8, 40])), rng.choice([0, 1, 2, 2, 3, 4]))]
        for i in range(60, 90):
            nets[d, i] = [f"V{i - 60}", f"V{i - 59}", f"V{i - 58}"]  # a chain
        for i in range(100, 140):
            nets[d, i] = ["W1", "W2"]
    df = spark.createDataFrame([(d, "SPI", i, m, "SCK", 90) for (d, i), m in nets.items()], "design_id long, type string, net_id long, members array<string>, role string, conf_pct long")
    got = {}
    for r in checks.interface_groups(df.where("size(members) >= 2")).collect():
        got.setdefault((r["design_id"], r["grp"]), (r["members"], []))[1].append(r["net_id"])
    want = {(d, g): (",".join(m), list(n)) for d in range(6) for g, (m, n) in slow_groups({i: m for (e, i), m in nets.items() if e == d}).items()}
    assert {k: (m, sorted(n)) for k, (m, n) in got.items()} == want


def test_more_nets_than_any_cap(spark):
    """A design of 3,000 nets of one type groups without a cap."""
    rows = [(1, "UART", i, [f"U{i}", f"U{i + 1}"], "TX", 90) for i in range(3000)]
    df = spark.createDataFrame(rows, "design_id long, type string, net_id long, members array<string>, role string, conf_pct long")
    assert checks.interface_groups(df).select("grp").distinct().count() == 3000
