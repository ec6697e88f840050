"""Rule checks on netlists: interfaces, power rails, electrical and protocol rules.

Rules read the context table of `netlist.endpoint_context` and return (design_id, code, severity, refs, nets), the last
two as sorted text lists. Protocol rules read one row an interface (`interface_facts`) and return (design_id, grp, iface, code,
status, refs); `grp`, the interface's first net, tells interfaces of one name apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sheetgraph.functions.rx import first_of, matches
from sheetgraph.functions.store import cut, dealt

# Names of power and ground nets, references by kind, words that tell interfaces and roles.
POWER_NAMES = r"^(GND|AGND|DGND|PGND|VSS|VEE|VBAT|VBUS|VIN|VCC|VDD|AVDD|DVDD|\+?[0-9.]+V[0-9A-Z_+-]*)$"
GROUND_NAMES = r"^(GND|AGND|DGND|PGND|VSS|0V)$"
BIAS_NAMES = r"^(VCC|VDD|AVDD|DVDD|VIN|VBUS|VBAT|VTREF|VREF|\+?[0-9.]+V[0-9A-Z_+-]*)$"
TARGET_NAMES = r"^(VTREF|VREF|VDD|VCC|\+?3\.3V|3V3)$"
CONNECTOR_REF = r"^(J|P|CN)\d+"
PASSIVE_REF = r"^(R|C|L|D|F|FB|TP)\d+"
RESISTOR_REF = r"^R\d+"
TYPE_RULES = [
    ("I2C", r"\bSDA\b|\bSCL\b|I2C|I²C"),
    ("SPI", r"\bMOSI\b|\bMISO\b|\bSCK\b|\bSCLK\b|\bSS\b|\bCSN?\b|SPI"),
    ("UART", r"\bTXD?\b|\bRXD?\b|UART|USART"),
    ("USB", r"USB[_ -]?(D\+|DP|D-|DM)|\bD\+\b|\bD-\b|VBUS|CC1|CC2"),
    ("SWD", r"SWDIO|SWCLK|SWO|NRST|\bSWD\b"),
    ("JTAG", r"TCK|TMS|TDI|TDO|\bJTAG\b"),
]
ROLE_RULES = {
    "I2C": [("SDA", "SDA"), ("SCL", "SCL")],
    "SPI": [("MOSI", "MOSI|SDI"), ("MISO", "MISO|SDO"), ("SCK", "SCK|SCLK|CLK"), ("CS", r"(^|[_ -])(CS|SS|NSS)(\b|[_ -])")],
    "UART": [("TX", r"(^|[_ -])TXD?(\b|[_ -])"), ("RX", r"(^|[_ -])RXD?(\b|[_ -])")],
    "USB": [("D+", r"D\+|(^|[_ -])DP(\b|[_ -])"), ("D-", r"D-|(^|[_ -])DM(\b|[_ -])"), ("VBUS", "VBUS"), ("CC1", "CC1"), ("CC2", "CC2")],
    "SWD": [("SWDIO", "SWDIO"), ("SWCLK", "SWCLK"), ("SWO", "SWO"), ("NRST", "NRST|RESET")],
    "JTAG": [("TCK", "TCK"), ("TMS", "TMS"), ("TDI", "TDI"), ("TDO", "TDO")],
}
EXPECTED = {"I2C": ["SDA", "SCL"], "SPI": ["MOSI", "MISO", "SCK"], "UART": ["TX", "RX"], "USB": ["D+", "D-"], "SWD": ["SWDIO", "SWCLK"], "JTAG": ["TCK", "TMS", "TDI", "TDO"]}
SIDEBAND = ("CC1", "CC2", "NRST", "SWO", "CS")


def drives() -> Column:
    return F.col("type").isin("output", "power_out")


def active() -> Column:
    return ~matches(F.col("ref"), PASSIVE_REF, True)


def listed(col: Column) -> Column:
    return F.array_join(F.array_sort(F.collect_set(col)), ",")


def issue(df: DataFrame, code: str, severity: str, refs: Column, nets: Column) -> DataFrame:
    return df.select("design_id", F.lit(code).alias("code"), F.lit(severity).alias("severity"), refs.alias("refs"), nets.alias("nets"))


def net_facts(ctx: DataFrame) -> DataFrame:
    """One row a net with all that its rules read: names and references of its pins by kind, joined with commas or as sorted arrays."""
    refs = lambda cond: F.array_sort(F.collect_set(F.when(cond, F.col("ref"))))
    has = lambda text: F.upper("pin_name").contains(text)
    pin, out, into = F.concat_ws(".", "ref", "pin"), F.col("type") == "power_out", F.col("type") == "power_in"
    return ctx.groupBy("design_id", "net_id", "net").agg(
        F.array_join(F.array_sort(F.collect_set("pin_name")), " ").alias("names"), F.min("net_conf").alias("conf_pct"), F.bool_or(out | into).alias("power"),
        listed(F.col("ref")).alias("refs"), refs(active()).alias("live"), F.count_if(drives()).alias("drivers"), refs(drives()).alias("driven"), refs(F.col("type") == "output").alias("outputs"),
        F.count_if(has("TX")).alias("tx"), F.count_if(has("RX")).alias("rx"), refs(has("TX")).alias("tx_refs"), refs(has("RX")).alias("rx_refs"),
        listed(F.when(out, pin)).alias("sources"), listed(F.when(into, pin)).alias("loads"), listed(F.when(into, F.col("ref"))).alias("load_refs"),
        listed(F.when(matches(F.col("ref"), CONNECTOR_REF, True), pin)).alias("connectors"),
    )


def interface_type(nets: DataFrame) -> DataFrame:
    """(design_id, net_id, net, names, type) of nets that name an interface or power; nets: net_facts."""
    text = F.upper(F.concat_ws(" ", "net", "names"))
    power = F.when(matches(F.upper("net"), POWER_NAMES) | F.col("power"), "POWER")
    return nets.select("design_id", "net_id", "net", "names", first_of(text, TYPE_RULES, power).alias("type")).where("type is not null")


def interface_role(types: DataFrame) -> DataFrame:
    """The role of each net within its interface type; the net's name if no rule tells."""
    text, role = F.upper(F.concat_ws(" ", "net", "names")), None
    for kind, rules in ROLE_RULES.items():
        one = first_of(text, rules, F.col("net"))
        role = F.when(F.col("type") == kind, one) if role is None else role.when(F.col("type") == kind, one)
    return types.select("design_id", "net_id", "net", "type", role.otherwise(F.col("net")).alias("role"))


def active_members(nets: DataFrame) -> DataFrame:
    """Non-passive references of each net, sorted."""
    return nets.where(F.size("live") > 0).select("design_id", "net_id", F.col("live").alias("members"))


def interface_candidates(nets: DataFrame) -> DataFrame:
    """(design_id, net_id, net, type, role, conf_pct, members) of nets that name an interface; nets: net_facts."""
    roles = interface_role(interface_type(nets).where("type <> 'POWER'"))
    return roles.join(dealt(nets.select("design_id", "net_id", "conf_pct", F.col("live").alias("members"))), ["design_id", "net_id"])


def _grown(strong: DataFrame) -> DataFrame:
    """Groups of nets of one design and type whose members overlap in two, to a fixpoint: (grp, refs, nets).

    A group is named by its smallest net. Nets of equal members are one group from the start. In each round every group
    meets the others in the pairs of its members, hooks itself to the smallest group met, chains of hooks are followed to
    their ends, and the grown groups pair anew, until no group meets a smaller one. Only members that several groups have
    form pairs: a grown group that is alone, or has few members in common, makes none or few of its many pairs.
    """
    of = ["design_id", "type"]
    alike = strong.groupBy(*of, F.array_sort("members").alias("refs")).agg(F.min("net_id").alias("grp"), F.collect_list("net_id").alias("nets"))
    groups = cut(alike.select(*of, "grp", "refs", "nets"))
    later = lambda i: F.slice("refs", i + 2, F.size("refs"))
    pairs = F.flatten(F.transform("refs", lambda a, i: F.transform(later(i), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    while True:
        member = groups.select(*of, "grp", F.explode("refs").alias("ref")).withColumn("n", F.count("*").over(W.partitionBy(*of, "ref")))
        common = member.where("n > 1").groupBy(*of, "grp").agg(F.array_sort(F.collect_list("ref")).alias("refs"))
        met = common.select(*of, "grp", F.explode(pairs).alias("pair")).withColumn("low", F.min("grp").over(W.partitionBy(*of, "pair")))
        hooks = cut(met.groupBy(*of, "grp").agg(F.min("low").alias("goes")).where("goes < grp"))
        if hooks.isEmpty():
            return groups
        more = True
        while more:  # two steps at a time
            up = lambda n: hooks.select(*of, F.col("grp").alias("goes"), F.col("goes").alias(n))  # noqa: E731,B023
            one = hooks.join(up("above"), [*of, "goes"], "left").select(*of, "grp", F.coalesce("above", "goes").alias("goes"), F.col("above").isNotNull().alias("went"))
            two = one.join(up("above"), [*of, "goes"], "left").select(*of, "grp", F.coalesce("above", "goes").alias("goes"), "went", F.col("above").isNotNull().alias("again"))
            hooks = cut(two)
            more = not hooks.where("again").isEmpty()
            hooks = hooks.select(*of, "grp", "goes")
        moved = groups.join(hooks, [*of, "grp"], "left").select(*of, F.coalesce("goes", "grp").alias("grp"), "refs", "nets")
        grown = moved.groupBy(*of, "grp").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("refs")))).alias("refs"), F.flatten(F.collect_list("nets")).alias("nets"))
        groups = cut(grown)


def strong_groups(candidates: DataFrame) -> DataFrame:
    """Groups of the nets of two or more active members, (design_id, type, grp, refs, nets)."""
    return _grown(candidates.where(F.size("members") >= 2))


def interface_groups(candidates: DataFrame, grown: DataFrame | None = None) -> DataFrame:
    """(design_id, type, grp, iface, net_id, members, conf_pct): interfaces grown to a fixpoint, `grp` being their first net.

    Nets of two or more active members merge while members overlap in two. Of the others, those with a side-band role join the first
    interface that has their member, or else the first of the nets that have the same member alone; each other one
    stands for itself. Interfaces without members are named by their place in the design and type. Designs have no cap on nets:
    grouping is joins on pairs of members; a group's members are one row. Its joins shuffle both sides: rows exploded from
    groups are many more than the optimizer thinks. grown: strong_groups of the candidates, if they are made already.
    """
    of = ["design_id", "type"]
    grown = strong_groups(candidates) if grown is None else grown
    refs, nets = grown.select(*of, "grp", "refs"), grown.select(*of, F.explode("nets").alias("net_id"), "grp")
    homes = refs.select(*of, "grp", F.explode("refs").alias("m")).groupBy(*of, "m").agg(F.min("grp").alias("home"))
    single = candidates.where(F.size("members") < 2).select(*of, "net_id", F.try_element_at("members", F.lit(1)).alias("m"), (F.col("role").isin(*SIDEBAND) & (F.size("members") == 1)).alias("side"))
    weak = single.join(dealt(homes), of + ["m"], "left").withColumn("home", F.when(F.col("side"), F.col("home")))
    leader = F.when(F.col("side"), F.min("net_id").over(W.partitionBy(*of, "m"))).otherwise(F.col("net_id"))
    alone = weak.where("home is null").withColumn("grp", leader)
    rows = nets.withColumn("weak", F.lit(False)).unionByName(weak.where("home is not null").select(*of, "net_id", F.col("home").alias("grp"), F.lit(False).alias("weak")))
    rows = rows.unionByName(alone.select(*of, "net_id", "grp", F.lit(True).alias("weak")))
    named = refs.unionByName(alone.where("grp = net_id").select(*of, "grp", F.array_compact(F.array("m")).alias("refs")))
    members = F.array_join("refs", ",")
    conf = rows.join(dealt(candidates.select(*of, "net_id", "conf_pct")), [*of, "net_id"]).groupBy(*of, "grp").agg(F.min("conf_pct").alias("conf_pct"), F.bool_or("weak").alias("weak"))
    place = F.row_number().over(W.partitionBy(*of).orderBy("weak", "grp"))
    groups = named.join(dealt(conf), [*of, "grp"]).withColumn("place", place)
    iface = F.concat_ws(":", "type", F.when(members != "", members).otherwise(F.concat(F.lit("group"), F.col("place"))))
    groups = groups.select(*of, "grp", iface.alias("iface"), members.alias("members"), "conf_pct")
    return rows.join(dealt(groups), [*of, "grp"]).select("design_id", "type", "grp", "iface", "net_id", "members", "conf_pct")


#: A row an interface: roles by the name of their column.
ROLE_COLUMNS = {"SDA": "sda", "SCL": "scl", "MOSI": "mosi", "MISO": "miso", "SCK": "sck", "TX": "tx", "RX": "rx", "D+": "dp", "D-": "dm", "CC1": "cc1", "CC2": "cc2", "NRST": "nrst"}
KEY = ["design_id", "grp", "iface"]


def interface_facts(ifaces: DataFrame, nets: DataFrame) -> DataFrame:
    """One row an interface with all that its rules read: members, roles, what its chip selects cover, and for each role the
    first net (by net_id) with its active references, drivers and pins of the role's name.

    ifaces: (design_id, grp, iface, type, members, net_id, role).
    """
    rows = ifaces.join(nets.drop("net", "conf_pct"), ["design_id", "net_id"], "left")
    fact = F.struct("net_id", "live", F.coalesce("drivers", F.lit(0)).alias("drivers"), "driven", "outputs", "tx", "rx", "tx_refs", "rx_refs")
    firsts = [F.min(F.when(F.col("role") == role, fact)).alias(f"_{name}") for role, name in ROLE_COLUMNS.items()]
    cs = F.array_distinct(F.flatten(F.collect_list(F.when(F.col("role") == "CS", F.col("live")))))
    out = rows.groupBy(*KEY, "type", "members").agg(F.collect_set("role").alias("roles"), F.count_if(F.col("role") == "CS").alias("cs"), cs.alias("selected"), *firsts)
    out = out.withColumn("members", F.when(F.col("members") == "", F.array().cast("array<string>")).otherwise(F.split("members", ",")))
    return out.withColumnsRenamed({f"_{name}": name for name in ROLE_COLUMNS.values()})


def interface_complete(facts: DataFrame) -> DataFrame:
    """Expected roles an interface lacks."""
    expected = F.element_at(F.create_map(*[x for k, v in EXPECTED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), F.col("type"))
    missing = F.array_except(expected, "roles")
    return facts.select(*KEY, "type", F.array_join(missing, ",").alias("missing"), (F.size(missing) == 0).alias("complete"))


def power_rails(nets: DataFrame) -> DataFrame:
    """Rails by name or by a power pin: sources, loads, connectors and whether it is ground."""
    rails = nets.where(F.col("power") | matches(F.upper("net"), POWER_NAMES))
    return rails.select("design_id", "net_id", "net", "sources", "loads", "connectors", "load_refs", matches(F.upper("net"), GROUND_NAMES).alias("ground"))


def erc_nc_connected(ctx: DataFrame, ncs: DataFrame) -> DataFrame:
    hit = ctx.join(ncs.distinct(), ["design_id", "ref", "pin"], "left_semi")
    return issue(hit, "NC_CONNECTED", "error", F.col("ref"), F.col("net"))


def erc_multi_driver(nets: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """Nets with several outputs, but for shared MISO nets (design_id, net_id)."""
    many = nets.where("drivers > 1")
    if shared is not None:
        many = many.join(shared, ["design_id", "net_id"], "left_anti")
    return issue(many, "MULTIPLE_DRIVERS", "error", F.array_join("driven", ","), F.col("net"))


def erc_low_conf_net(nets: DataFrame) -> DataFrame:
    return issue(nets.where("conf_pct < 65"), "LOW_CONFIDENCE_NET", "review", F.col("refs"), F.col("net"))


def erc_pin_multi_net(ctx: DataFrame) -> DataFrame:
    many = ctx.groupBy("design_id", "ref", "pin").agg(F.size(F.collect_set("net_id")).alias("n"), listed(F.col("net")).alias("nets")).where("n > 1")
    return issue(many, "PIN_MULTI_NET", "error", F.concat_ws(".", "ref", "pin"), F.col("nets"))


def unconnected_code() -> Column:
    """What it means that a pin has no net."""
    return F.when(F.col("type") == "power_in", "POWER_INPUT_UNCONNECTED").when((F.col("type") == "input") & (F.col("conf_pct") >= 60), "INPUT_UNCONNECTED").when(F.col("conf_pct") < 50, "PIN_LOW_CONFIDENCE")


def erc_unconnected(pins: DataFrame, endpoints: DataFrame, ncs: DataFrame) -> DataFrame:
    key = ["design_id", "ref", "number"]
    free = pins.where("type <> 'no_connect'").join(endpoints.select("design_id", "ref", F.col("pin").alias("number")), key, "left_anti")
    free = free.join(ncs.select("design_id", "ref", F.col("pin").alias("number")), key, "left_anti")
    code = unconnected_code()
    severity = F.when(code == "PIN_LOW_CONFIDENCE", "review").otherwise("warning")
    return free.select("design_id", code.alias("code"), severity.alias("severity"), F.concat_ws(".", "ref", "number").alias("refs"), F.lit("").alias("nets")).where("code is not null")


def pin_issues(ctx: DataFrame, pins: DataFrame, endpoints: DataFrame, ncs: DataFrame) -> DataFrame:
    """(design_id, code, severity) of the rules of single pins, as erc_nc_connected, erc_pin_multi_net and erc_unconnected find
    them, by one grouping of all that is said of a pin instead of a join for each."""
    key, nothing = ["design_id", "ref", "pin"], F.lit(None)
    said = lambda df, net=nothing, code=nothing, on=False, nc=False: df.select(*key, net.alias("net_id"), code.alias("code"), F.lit(on).alias("on"), F.lit(nc).alias("nc"))
    free = pins.where("type <> 'no_connect'").select("design_id", "ref", F.col("number").alias("pin"), unconnected_code().alias("code")).where("code is not null")
    rows = said(ctx, net=F.col("net_id")).union(said(free, code=F.col("code"))).union(said(endpoints, on=True)).union(said(ncs, nc=True))
    codes = [("POWER_INPUT_UNCONNECTED", "warning"), ("INPUT_UNCONNECTED", "warning"), ("PIN_LOW_CONFIDENCE", "review")]
    count = [F.count_if(F.col("code") == code).alias(code) for code, _ in codes]
    pin = rows.groupBy(*key).agg(F.count("net_id").alias("n"), (F.min("net_id") != F.max("net_id")).alias("many"), F.bool_or("on").alias("on"), F.bool_or("nc").alias("nc"), *count)
    times = lambda n, code, severity: F.array_repeat(F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity")), n.cast("int"))
    loose = [times(F.when(~F.col("on") & ~F.col("nc"), F.col(code)).otherwise(0), code, severity) for code, severity in codes]
    found = F.concat(times(F.when(F.col("nc"), F.col("n")).otherwise(0), "NC_CONNECTED", "error"), times(F.when(F.col("many"), 1).otherwise(0), "PIN_MULTI_NET", "error"), *loose)
    return pin.select("design_id", F.explode(found).alias("i")).select("design_id", "i.code", "i.severity")


def erc_power_source(rails: DataFrame) -> DataFrame:
    bad = rails.where("not ground and loads <> '' and sources = '' and connectors = ''")
    return issue(bad, "POWER_SOURCE_MISSING", "warning", F.col("load_refs"), F.col("net"))


def erc_iface_incomplete(complete: DataFrame) -> DataFrame:
    return issue(complete.where("not complete"), "INTERFACE_INCOMPLETE", "warning", F.col("iface"), F.col("missing"))


def shared_miso(ifaces: DataFrame) -> DataFrame:
    """(design_id, net_id) of master-in nets of SPI buses, which several outputs may drive in turn."""
    return ifaces.where("type = 'SPI' and role = 'MISO'").select("design_id", "net_id").distinct()


def finding(code: Column, status: Column, refs: Column | None = None) -> Column:
    """A check's outcome; refs: those it names, the interface's members if none are given."""
    return F.struct(code.alias("code"), status.alias("status"), F.array_join(F.coalesce(refs, F.array().cast("array<string>")) if refs is not None else F.col("members"), ",").alias("refs"))


def _found(facts: DataFrame, kinds: list[str], *findings: Column) -> DataFrame:
    """(design_id, grp, iface, code, status, refs) of the findings that are there."""
    out = facts.where(F.col("type").isin(kinds)).select(*KEY, F.explode(F.array_compact(F.array(*findings))).alias("f"))
    return out.select(*KEY, "f.code", "f.status", "f.refs")


def proto_i2c_bias(facts: DataFrame, ctx: DataFrame, pins: DataFrame) -> DataFrame:
    """Where the resistors on SDA and SCL lead: a supply (pass), ground (error), unknown (review), or no resistor (warning).

    The first resistor pin (by reference and number) whose other net is a supply or ground decides.
    """
    line = lambda role: F.when(F.col(ROLE_COLUMNS[role]).isNotNull(), F.struct(F.lit(role).alias("role"), F.col(f"{ROLE_COLUMNS[role]}.net_id").alias("net_id")))
    lines = facts.where("type = 'I2C'").select(*KEY, "members", F.explode(F.array_compact(F.array(line("SDA"), line("SCL")))).alias("l")).select(*KEY, "members", "l.role", "l.net_id")
    r = ctx.where(matches(F.col("ref"), RESISTOR_REF, True)).select("design_id", "net_id", "ref", "pin")
    far = pins.where(matches(F.col("ref"), RESISTOR_REF, True)).select("design_id", "ref", F.col("number").alias("far_pin"))
    other = ctx.where(matches(F.col("ref"), RESISTOR_REF, True)).groupBy("design_id", "ref", F.col("pin").alias("far_pin")).agg(F.min_by("net", "net_id").alias("far_net"))
    legs = lines.join(r, ["design_id", "net_id"], "left").join(dealt(far.join(dealt(other), ["design_id", "ref", "far_pin"], "left")), ["design_id", "ref"], "left").where("ref is null or far_pin <> pin")
    kind = F.when(matches(F.upper("far_net"), GROUND_NAMES), "PULLDOWN").when(matches(F.upper("far_net"), BIAS_NAMES), "PULLUP_OK")
    order = F.when(kind.isNotNull(), F.concat_ws(":", "ref", "pin", F.lpad("far_pin", 6, "0")))
    out = legs.withColumn("kind", kind).groupBy(*KEY, "members", "role").agg(F.min_by("kind", order).alias("kind"), F.count("ref").alias("n"))
    kind = F.coalesce("kind", F.when(F.col("n") > 0, "BIAS_UNVERIFIED").otherwise("PULLUP_MISSING"))
    status = F.when(kind == "PULLUP_OK", "pass").when(kind == "PULLDOWN", "error").when(kind == "BIAS_UNVERIFIED", "review").otherwise("warning")
    return out.select(*KEY, F.concat(F.lit("I2C_"), F.col("role"), F.lit("_"), kind).alias("code"), status.alias("status"), F.array_join("members", ",").alias("refs"))


def proto_i2c_drive(facts: DataFrame) -> DataFrame:
    """Push-pull outputs on the lines of an open-drain bus."""
    hard = lambda name: F.col(f"{name}.outputs")
    return _found(facts, ["I2C"], *(F.when(F.size(hard(n)) > 0, finding(F.lit(f"I2C_{n.upper()}_DRIVE_TYPE"), F.lit("review"), hard(n))) for n in ("sda", "scl")))


def proto_spi_driver(facts: DataFrame) -> DataFrame:
    """Clock and master-out have one driver."""

    def one(role: str) -> Column:
        net, n = F.col(role), F.col(f"{role}.drivers")
        code = F.concat(F.lit(f"SPI_{role.upper()}_"), F.when(n == 1, "DRIVER_OK").when(n == 0, "NO_DRIVER").otherwise("MULTI_DRIVER"))
        return F.when(net.isNotNull(), finding(code, F.when(n == 1, "pass").when(n == 0, "review").otherwise("error"), F.when(n > 1, F.col(f"{role}.driven")).otherwise(F.col("members"))))

    return _found(facts, ["SPI"], one("sck"), one("mosi"))


def proto_spi_miso(facts: DataFrame) -> DataFrame:
    """Several drivers of master-in need chip selects."""
    n = F.col("miso.drivers")
    shared = finding(F.lit("SPI_MISO_SHARED_DRIVERS"), F.when(F.col("cs") > 0, "review").otherwise("warning"), F.col("miso.driven"))
    return _found(facts, ["SPI"], F.when(n > 1, shared).when(n == 1, finding(F.lit("SPI_MISO_DRIVER_OK"), F.lit("pass"))))


def proto_spi_cs(facts: DataFrame) -> DataFrame:
    """Members beyond bus drivers and connectors that no CS net covers, in interfaces of more than two members."""
    nothing = F.array().cast("array<string>")
    slaves = F.filter(F.array_except(F.array_except("members", F.coalesce("sck.driven", nothing)), F.coalesce("mosi.driven", nothing)), lambda r: ~matches(r, CONNECTOR_REF, True))
    missing = F.array_except(slaves, "selected")
    return _found(facts, ["SPI"], F.when((F.size("members") > 2) & (F.size(missing) > 0), finding(F.lit("SPI_CS_COVERAGE"), F.lit("review"), missing)))


def _pair(a: str, b: str, ok: str, bad: str) -> Column:
    """Whether the nets of two roles have the same active devices."""
    same = F.coalesce(f"{a}.live", F.array().cast("array<string>")) == F.coalesce(f"{b}.live", F.array().cast("array<string>"))
    return F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), finding(F.when(same, ok).otherwise(bad), F.when(same, "pass").otherwise("warning")))


def proto_uart(facts: DataFrame) -> DataFrame:
    """Same-named pins meeting, more than two devices on a line, and whether TX and RX have the same devices."""
    same = [F.when(F.col(f"{r}.{r}") >= 2, finding(F.lit(f"UART_{r.upper()}_{r.upper()}"), F.lit("warning"), F.col(f"{r}.{r}_refs"))) for r in ("tx", "rx")]
    many = [F.when(F.size(f"{r}.live") > 2, finding(F.lit("UART_MULTIDROP"), F.lit("review"), F.col(f"{r}.live"))) for r in ("tx", "rx")]
    return _found(facts, ["UART"], *same, *many, _pair("tx", "rx", "UART_PAIR_OK", "UART_PAIR_MEMBER_MISMATCH"))


def proto_usb_pair(facts: DataFrame) -> DataFrame:
    return _found(facts, ["USB"], _pair("dp", "dm", "USB_DIFF_PAIR_ENDPOINTS_OK", "USB_DIFF_PAIR_ENDPOINT_MISMATCH"))


def proto_usb_c_cc(facts: DataFrame, comps: DataFrame) -> DataFrame:
    """Interfaces with a USB-C looking member need both CC1 and CC2."""
    looks = comps.where(matches(F.col("value"), "USB.?C|TYPE.?C", True)).select("design_id", "ref").distinct()
    both = F.col("cc1").isNotNull() & F.col("cc2").isNotNull()
    member = facts.where("type = 'USB'").select(*KEY, both.alias("both"), F.explode("members").alias("ref")).join(looks, ["design_id", "ref"], "left_semi")
    out = member.groupBy(*KEY, "both").agg(listed(F.col("ref")).alias("refs"))
    return out.select(*KEY, F.when(F.col("both"), "USB_C_CC_PRESENT").otherwise("USB_C_CC_INCOMPLETE").alias("code"), F.when(F.col("both"), "pass").otherwise("warning").alias("status"), "refs")


def proto_debug(facts: DataFrame, ctx: DataFrame) -> DataFrame:
    """Debug interfaces with a connector: a shared ground, a target voltage, and a reset line for SWD."""
    wired = facts.where(F.col("type").isin("SWD", "JTAG") & F.exists("members", lambda r: matches(r, CONNECTOR_REF, True)))
    name = F.upper("net")
    rails = ctx.where((matches(name, GROUND_NAMES) | matches(name, TARGET_NAMES)) & active()).select("design_id", "ref", "net_id", "net").distinct()
    on = wired.select(*KEY, F.size("members").alias("size"), F.explode("members").alias("ref")).join(rails, ["design_id", "ref"])
    on = on.groupBy(*KEY, "size", "net_id", "net").agg(F.count("*").alias("hits")).where("hits >= least(2, size)")
    found = on.groupBy(*KEY).agg(F.bool_or(matches(name, GROUND_NAMES)).alias("gnd"), F.bool_or(matches(name, TARGET_NAMES)).alias("vref"))
    out = wired.join(dealt(found), KEY, "left").na.fill(False, ["gnd", "vref"])
    t = F.col("type")
    ground = finding(F.concat(t, F.when(F.col("gnd"), "_GND_OK").otherwise("_GND_MISSING")), F.when(F.col("gnd"), "pass").otherwise("warning"))
    voltage = finding(F.concat(t, F.when(F.col("vref"), "_VTREF_OK").otherwise("_VTREF_MISSING")), F.when(F.col("vref"), "pass").otherwise("review"))
    optional = F.when((t == "SWD") & F.col("nrst").isNull(), finding(F.lit("SWD_NRST_OPTIONAL"), F.lit("review")))
    return _found(out, ["SWD", "JTAG"], ground, voltage, optional)


def protocol_checks(facts: DataFrame, ctx: DataFrame, pins: DataFrame, comps: DataFrame) -> DataFrame:
    """All protocol rules over every interface."""
    parts = [proto_i2c_bias(facts, ctx, pins), proto_i2c_drive(facts), proto_spi_driver(facts), proto_spi_miso(facts), proto_spi_cs(facts), proto_uart(facts), proto_usb_pair(facts), proto_usb_c_cc(facts, comps), proto_debug(facts, ctx)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


RANK = ("pass", "review", "warning", "error")


def proto_summary(checks: DataFrame) -> DataFrame:
    """Checks per status and the worst status of each interface."""
    rank = F.array_position(F.array(*map(F.lit, RANK)), F.col("status"))
    counts = [F.count_if(F.col("status") == s).alias(s) for s in RANK]
    return checks.groupBy(*KEY).agg(*counts, F.max_by("status", rank).alias("worst"))


def all_issues(ctx: DataFrame, nets: DataFrame, ncs: DataFrame, pins: DataFrame, endpoints: DataFrame, comps: DataFrame, ifaces: DataFrame, facts: DataFrame) -> DataFrame:
    """(design_id, code, severity) of every rule: graph, power and protocol."""
    found = [
        pin_issues(ctx, pins, endpoints, ncs), erc_multi_driver(nets, shared_miso(ifaces)), erc_low_conf_net(nets),
        erc_power_source(power_rails(nets)), erc_iface_incomplete(interface_complete(facts)),
        protocol_checks(facts, ctx, pins, comps).where("status <> 'pass'").withColumnRenamed("status", "severity"),
    ]
    out = found[0].select("design_id", "code", "severity")
    for f in found[1:]:
        out = out.union(f.select("design_id", "code", "severity"))
    return out


def health_score(issues: DataFrame, nets: DataFrame, comps: DataFrame) -> DataFrame:
    """Issues per severity of every design, what passed, and a score from 0 to 100."""
    by = [F.count_if(F.col("severity") == s).alias(s) for s in ("error", "warning", "review")]
    size = nets.select("design_id").unionAll(comps.select("design_id")).groupBy("design_id").agg(F.count("*").alias("size"))
    out = size.join(dealt(issues.groupBy("design_id").agg(*by)), "design_id", "left").na.fill(0)
    score = F.greatest(F.lit(0), 100 - F.col("error") * 18 - F.col("warning") * 6 - F.col("review") * 2)
    return out.select("design_id", "error", "warning", "review", F.greatest(F.lit(0), F.col("size") - F.col("error")).alias("passed"), score.alias("score"))
