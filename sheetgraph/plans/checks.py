"""Queries of the rule checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetgraph.operators import checks as c
from sheetgraph.plans.folds import GROUPED, GROUPS_SQL, SIDEBAND_SQL
from sheetgraph.plans.registry import query


def _b(pattern: str) -> str:
    return pattern.replace("'", "''")


_TYPES = " ".join(f"WHEN regexp_matches(txt, '{_b(p)}') THEN '{n}'" for n, p in c.TYPE_RULES)
_ROLES = " ".join(f"WHEN type = '{k}' THEN CASE " + " ".join(f"WHEN regexp_matches(txt, '{_b(p)}') THEN '{n}'" for n, p in rules) + " ELSE net END" for k, rules in c.ROLE_RULES.items())
_LIST = "coalesce(string_agg(DISTINCT {0}, ',' ORDER BY {0}), '')"
V = {
    "nettext": "SELECT design_id, net_id, net, upper(net || ' ' || string_agg(DISTINCT pin_name, ' ' ORDER BY pin_name)) AS txt, string_agg(DISTINCT "
        "pin_name, ' ' ORDER BY pin_name) AS names, bool_or(type IN ('power_in', 'power_out')) AS power FROM ctx GROUP BY 1, 2, 3",
    "typed": f"SELECT * FROM (SELECT *, CASE {_TYPES} WHEN regexp_matches(upper(net), '{_b(c.POWER_NAMES)}') OR power THEN 'POWER' END AS type FROM "
        "nettext) WHERE type IS NOT NULL",
    "roled": f"SELECT design_id, net_id, net, type, CASE {_ROLES} ELSE net END AS role FROM typed",
    "live": f"SELECT * FROM ctx WHERE NOT regexp_matches(ref, '(?i){c.PASSIVE_REF}')",
    "sets": "SELECT design_id, net_id, string_agg(DISTINCT ref, ',' ORDER BY ref) AS \"set\", count(DISTINCT ref) AS size FROM live GROUP BY 1, 2",
    "drv": "SELECT design_id, net_id, count(*) AS n, string_agg(DISTINCT ref, ',' ORDER BY ref) AS refs FROM ctx WHERE type IN ('output', 'power_out') GROUP BY 1, 2",
    "rails": f"SELECT design_id, net_id, net, {_LIST.format('s')} AS sources, {_LIST.format('l')} AS loads, {_LIST.format('j')} AS connectors, "
        f"{_LIST.format('lr')} AS load_refs, regexp_matches(upper(net), '{_b(c.GROUND_NAMES)}') AS ground FROM (SELECT *, CASE WHEN type = 'power_out' "
        "THEN ref || '.' || pin END AS s, CASE WHEN type = 'power_in' THEN ref || '.' || pin END AS l, CASE WHEN type = 'power_in' THEN ref END AS "
        f"lr, CASE WHEN regexp_matches(ref, '(?i){c.CONNECTOR_REF}') THEN ref || '.' || pin END AS j FROM ctx) GROUP BY 1, 2, 3 HAVING bool_or(type IN "
        f"('power_in', 'power_out')) OR regexp_matches(upper(net), '{_b(c.POWER_NAMES)}')",
}
V |= GROUPED | {
    "igroups": "SELECT design_id, type, list_min(nets) AS grp, list_sort(m) AS m, NULL AS place, unnest(nets) AS net_id FROM merged"
    " UNION ALL SELECT s.design_id, s.type, list_min(g.nets), list_sort(g.m), NULL, s.net_id FROM single s JOIN merged g ON g.design_id = s.design_id AND g.type = s.type AND g.i = s.home"
    " UNION ALL SELECT a.design_id, a.type, a.leader, CASE WHEN o.m IS NULL THEN [] ELSE [o.m] END, o.place + coalesce(n.n, 0), a.net_id FROM alone a"
    " JOIN own o ON o.design_id = a.design_id AND o.type = a.type AND o.leader = a.leader"
    " LEFT JOIN (SELECT design_id, type, count(*) AS n FROM merged GROUP BY 1, 2) n ON n.design_id = a.design_id AND n.type = a.type",
    "ifaces": "SELECT g.design_id, g.grp, g.type || ':' || CASE WHEN len(m) = 0 THEN 'group' || place::VARCHAR ELSE array_to_string(m, ',') END AS iface, g.type,"
    " m AS members, array_to_string(m, ',') AS mem, r.role, r.net, g.net_id FROM igroups g JOIN roled r ON r.design_id = g.design_id AND r.net_id = g.net_id",
    "firsts": "SELECT design_id, grp, iface, type, any_value(members) AS members, any_value(mem) AS mem, role, min(net_id) AS net_id FROM ifaces GROUP BY 1, 2, 3, 4, role",
}


def _ctx(t):
    """The one wide join that every rule reads."""
    from sheetgraph.operators.netlist import endpoint_context

    return t.kept("ctx", lambda: endpoint_context(t.eps, t.nets, t.pins))


def _nets(t):
    return t.kept("netfacts", lambda: c.net_facts(_ctx(t)))


def _typed(t):
    return c.interface_type(_nets(t))


def _candidates(t):
    """Read several times by the grouping, so types and roles are told once."""
    return t.kept("candidates", lambda: c.interface_candidates(_nets(t)))


def _groups(t):
    return t.kept("groups", lambda: c.strong_groups(_candidates(t)))


def _ifaces(t):
    """Every net of every interface, with its role."""

    def make():
        roles = _candidates(t).select("design_id", "net_id", "net", "type", "role")
        return c.interface_groups(_candidates(t), _groups(t)).join(roles, ["design_id", "net_id", "type"])

    return t.kept("ifaces", make)


def _facts(t):
    return t.kept("facts", lambda: c.interface_facts(_ifaces(t), _nets(t)))


query("interface_type", "SELECT design_id, net_id, net, names, type FROM typed", V)(_typed)
query("interface_role", "SELECT * FROM roled", V)(lambda t: c.interface_role(_typed(t)))
query("active_members", 'SELECT design_id, net_id, "set" AS members FROM sets', V)(lambda t: c.active_members(_nets(t)).withColumn("members", F.array_join("members", ",")))
query("interface_groups", GROUPS_SQL, V)(lambda t: c.interface_groups(_candidates(t).where(F.size("members") >= 2), _groups(t)).drop("grp"))
query("interface_sideband", SIDEBAND_SQL, V)(lambda t: c.interface_groups(_candidates(t), _groups(t)).drop("grp"))
_EXPECTED = ", ".join(f"('{k}', {i}, '{e}')" for k, v in c.EXPECTED.items() for i, e in enumerate(v))
_COMPLETE = (
    "SELECT design_id, grp, iface, type, coalesce(string_agg(e, ',' ORDER BY i), '') AS missing, count(e) = 0 AS complete FROM (SELECT f.design_id, f.grp, f.iface, f.type, x.i,"
    " CASE WHEN list_contains(f.roles, x.e) THEN NULL ELSE x.e END AS e FROM (SELECT design_id, grp, iface, type, list(DISTINCT role) AS roles FROM ifaces GROUP BY 1, 2, 3, 4) f"
    f" JOIN (VALUES {_EXPECTED}) AS x(k, i, e) ON x.k = f.type) GROUP BY 1, 2, 3, 4"
)
query("interface_complete", _COMPLETE, V)(lambda t: c.interface_complete(_facts(t)))
query("power_rails", "SELECT * FROM rails", V)(lambda t: c.power_rails(_nets(t)))
#: SQL of the issues by rule; `query` gets it with the rule's own DataFrame code.
ISSUES = {
    "erc_nc_connected": "SELECT design_id, 'NC_CONNECTED' AS code, 'error' AS severity, ref AS refs, net AS nets FROM ctx c SEMI JOIN ncs n ON n.design_id = c.design_id AND n.ref = c.ref AND n.pin = c.pin",
    "erc_multi_driver": "SELECT design_id, 'MULTIPLE_DRIVERS' AS code, 'error' AS severity, string_agg(DISTINCT ref, ',' ORDER BY ref) AS refs, net AS nets FROM ctx c"
    " WHERE type IN ('output', 'power_out') AND NOT EXISTS (SELECT 1 FROM ifaces s WHERE s.type = 'SPI' AND s.role = 'MISO' AND s.design_id = c.design_id AND s.net_id = c.net_id)"
    " GROUP BY design_id, net_id, net HAVING count(*) > 1",
    "erc_low_conf_net": "SELECT design_id, 'LOW_CONFIDENCE_NET' AS code, 'review' AS severity, string_agg(DISTINCT ref, ',' ORDER BY ref) AS refs, net AS nets FROM ctx"
    " WHERE net_conf < 65 GROUP BY design_id, net_id, net",
    "erc_pin_multi_net": "SELECT design_id, 'PIN_MULTI_NET' AS code, 'error' AS severity, ref || '.' || pin AS refs, string_agg(DISTINCT net, ',' ORDER BY net) AS nets FROM ctx"
    " GROUP BY design_id, ref, pin HAVING count(DISTINCT net_id) > 1",
    "erc_unconnected": "SELECT design_id, code, CASE WHEN code = 'PIN_LOW_CONFIDENCE' THEN 'review' ELSE 'warning' END AS severity, ref || '.' || number AS refs, '' AS nets FROM ("
    "SELECT *, CASE WHEN type = 'power_in' THEN 'POWER_INPUT_UNCONNECTED' WHEN type = 'input' AND conf_pct >= 60 THEN 'INPUT_UNCONNECTED' WHEN conf_pct < 50 THEN 'PIN_LOW_CONFIDENCE' END AS code"
    " FROM pins p ANTI JOIN eps e ON e.design_id = p.design_id AND e.ref = p.ref AND e.pin = p.number ANTI JOIN ncs x ON x.design_id = p.design_id AND x.ref = p.ref AND x.pin = p.number"
    " WHERE type <> 'no_connect') WHERE code IS NOT NULL",
    "erc_power_source": "SELECT design_id, 'POWER_SOURCE_MISSING' AS code, 'warning' AS severity, load_refs AS refs, net AS nets FROM rails"
    " WHERE NOT ground AND loads <> '' AND sources = '' AND connectors = ''",
    "erc_iface_incomplete": f"SELECT design_id, 'INTERFACE_INCOMPLETE' AS code, 'warning' AS severity, iface AS refs, missing AS nets FROM ({_COMPLETE}) WHERE NOT complete",
}


def _rule(name: str, make, sql: dict[str, str] = ISSUES) -> None:
    query(name, sql[name], V)(make)


_rule("erc_nc_connected", lambda t: c.erc_nc_connected(_ctx(t), t.ncs))
_rule("erc_multi_driver", lambda t: c.erc_multi_driver(_nets(t), c.shared_miso(_ifaces(t))))
_rule("erc_low_conf_net", lambda t: c.erc_low_conf_net(_nets(t)))
_rule("erc_pin_multi_net", lambda t: c.erc_pin_multi_net(_ctx(t)))
_rule("erc_unconnected", lambda t: c.erc_unconnected(t.pins, t.eps, t.ncs))
_rule("erc_power_source", lambda t: c.erc_power_source(c.power_rails(_nets(t))))
_rule("erc_iface_incomplete", lambda t: c.erc_iface_incomplete(c.interface_complete(_facts(t))))

# Protocol rules: one loop over the interfaces, roles by their first net
_ROLE = "SELECT f.design_id, f.grp, f.iface, {code} AS code, {status} AS status, {refs} AS refs FROM firsts f "
_PAIR = (
    "SELECT design_id, grp, iface, CASE WHEN a = b THEN '{ok}' ELSE '{bad}' END AS code, CASE WHEN a = b THEN 'pass' ELSE 'warning' END AS status, mem AS refs FROM ("
    "SELECT f.design_id, f.grp, f.iface, any_value(f.mem) AS mem, max(coalesce(s.\"set\", '')) FILTER (f.role = '{x}') AS a, max(coalesce(s.\"set\", '')) FILTER (f.role = '{y}') AS b"
    " FROM firsts f LEFT JOIN sets s ON s.design_id = f.design_id AND s.net_id = f.net_id WHERE f.type = '{t}' GROUP BY 1, 2, 3) WHERE a IS NOT NULL AND b IS NOT NULL"
)
_ON = "ON c.design_id = f.design_id AND c.net_id = f.net_id"
_GND, _BIAS, _TARGET = _b(c.GROUND_NAMES), _b(c.BIAS_NAMES), _b(c.TARGET_NAMES)
_WIRED = (
    "SELECT i.design_id, i.grp, i.iface, i.type, any_value(i.members) AS members, any_value(i.mem) AS mem, bool_or(i.role = 'NRST') AS nrst FROM ifaces i WHERE i.type IN ('SWD', 'JTAG')"
    f" GROUP BY 1, 2, 3, 4 HAVING len(list_filter(any_value(i.members), lambda r: regexp_matches(r, '(?i){c.CONNECTOR_REF}'))) > 0"
)
_SHARES = (
    "EXISTS (SELECT 1 FROM live l WHERE l.design_id = w.design_id AND list_contains(w.members, l.ref) AND regexp_matches(upper(l.net), '{0}')"
    " GROUP BY l.net_id, l.net HAVING count(DISTINCT l.ref) >= least(2, len(w.members)))"
)
V |= {
    "wired": _WIRED,
    "dout": f"SELECT w.design_id, w.grp, w.iface, w.type, w.mem, w.nrst, {_SHARES.format(_GND)} AS gnd, {_SHARES.format(_TARGET)} AS vref FROM wired w",
}
PROTOCOL = {
    "proto_i2c_bias": f"""SELECT design_id, grp, iface, 'I2C_' || role || '_' || k AS code,
      CASE k WHEN 'PULLUP_OK' THEN 'pass' WHEN 'PULLDOWN' THEN 'error' WHEN 'BIAS_UNVERIFIED' THEN 'review' ELSE 'warning' END AS status, mem AS refs FROM (
      SELECT design_id, grp, iface, mem, role, coalesce(arg_min(kind, o) FILTER (kind IS NOT NULL), CASE WHEN count(ref) > 0 THEN 'BIAS_UNVERIFIED' ELSE 'PULLUP_MISSING' END) AS k FROM (
        SELECT f.design_id, f.grp, f.iface, f.mem, f.role, r.ref, r.ref || ':' || r.pin || ':' || lpad(p.number, 6, '0') AS o,
          CASE WHEN regexp_matches(upper(x.net), '{_GND}') THEN 'PULLDOWN' WHEN regexp_matches(upper(x.net), '{_BIAS}') THEN 'PULLUP_OK' END AS kind
        FROM firsts f LEFT JOIN ctx r ON r.design_id = f.design_id AND r.net_id = f.net_id AND regexp_matches(r.ref, '^R[0-9]')
        LEFT JOIN pins p ON p.design_id = r.design_id AND p.ref = r.ref AND p.number <> r.pin
        LEFT JOIN (SELECT design_id, ref, pin, arg_min(net, net_id) AS net FROM ctx GROUP BY 1, 2, 3) x ON x.design_id = r.design_id AND x.ref = r.ref AND x.pin = p.number
        WHERE f.type = 'I2C' AND f.role IN ('SDA', 'SCL')) GROUP BY ALL)""",
    "proto_i2c_drive": _ROLE.format(code="'I2C_' || f.role || '_DRIVE_TYPE'", status="'review'", refs="string_agg(DISTINCT c.ref, ',' ORDER BY c.ref)")
    + f"JOIN ctx c {_ON} WHERE f.type = 'I2C' AND f.role IN ('SDA', 'SCL') AND c.type = 'output' GROUP BY f.design_id, f.grp, f.iface, f.role",
    "proto_spi_driver": _ROLE.format(
        code="'SPI_' || f.role || '_' || CASE coalesce(c.n, 0) WHEN 1 THEN 'DRIVER_OK' WHEN 0 THEN 'NO_DRIVER' ELSE 'MULTI_DRIVER' END",
        status="CASE coalesce(c.n, 0) WHEN 1 THEN 'pass' WHEN 0 THEN 'review' ELSE 'error' END",
        refs="CASE WHEN c.n > 1 THEN c.refs ELSE f.mem END",
    )
    + f"LEFT JOIN drv c {_ON} WHERE f.type = 'SPI' AND f.role IN ('SCK', 'MOSI')",
    "proto_spi_miso": _ROLE.format(
        code="CASE WHEN c.n = 1 THEN 'SPI_MISO_DRIVER_OK' ELSE 'SPI_MISO_SHARED_DRIVERS' END",
        status="CASE WHEN c.n = 1 THEN 'pass' WHEN EXISTS (SELECT 1 FROM firsts i WHERE i.design_id = f.design_id AND i.grp = f.grp AND i.iface = f.iface AND i.role = 'CS') THEN 'review' ELSE 'warning' END",
        refs="CASE WHEN c.n = 1 THEN f.mem ELSE c.refs END",
    )
    + f"JOIN drv c {_ON} WHERE f.type = 'SPI' AND f.role = 'MISO'",
    "proto_spi_cs": "SELECT design_id, grp, iface, 'SPI_CS_COVERAGE' AS code, 'review' AS status, string_agg(ref, ',' ORDER BY ref) AS refs FROM ("
    "SELECT DISTINCT i.design_id, i.grp, i.iface, unnest(i.members) AS ref FROM ifaces i WHERE i.type = 'SPI' AND len(i.members) > 2) m"
    f" WHERE NOT regexp_matches(ref, '(?i){c.CONNECTOR_REF}')"
    " AND NOT EXISTS (SELECT 1 FROM firsts f JOIN ctx d ON d.design_id = f.design_id AND d.net_id = f.net_id"
    " WHERE f.design_id = m.design_id AND f.grp = m.grp AND f.iface = m.iface AND f.role IN ('SCK', 'MOSI') AND d.type IN ('output', 'power_out') AND d.ref = m.ref)"
    " AND NOT EXISTS (SELECT 1 FROM ifaces i JOIN live l ON l.design_id = i.design_id AND l.net_id = i.net_id"
    " WHERE i.design_id = m.design_id AND i.grp = m.grp AND i.iface = m.iface AND i.role = 'CS' AND l.ref = m.ref) GROUP BY design_id, grp, iface",
    "proto_uart": _ROLE.format(code="'UART_' || f.role || '_' || f.role", status="'warning'", refs="string_agg(DISTINCT c.ref, ',' ORDER BY c.ref)")
    + f"JOIN ctx c {_ON} WHERE f.type = 'UART' AND f.role IN ('TX', 'RX') AND contains(upper(c.pin_name), f.role) GROUP BY f.design_id, f.grp, f.iface, f.role HAVING count(*) >= 2 UNION ALL "
    + _ROLE.format(code="'UART_MULTIDROP'", status="'review'", refs='c."set"')
    + f"JOIN sets c {_ON} WHERE f.type = 'UART' AND f.role IN ('TX', 'RX') AND c.size > 2 UNION ALL "
    + _PAIR.format(ok="UART_PAIR_OK", bad="UART_PAIR_MEMBER_MISMATCH", x="TX", y="RX", t="UART"),
    "proto_usb_pair": _PAIR.format(ok="USB_DIFF_PAIR_ENDPOINTS_OK", bad="USB_DIFF_PAIR_ENDPOINT_MISMATCH", x="D+", y="D-", t="USB"),
    "proto_usb_c_cc": "SELECT design_id, grp, iface, CASE WHEN cc = 2 THEN 'USB_C_CC_PRESENT' ELSE 'USB_C_CC_INCOMPLETE' END AS code, CASE WHEN cc = 2 THEN 'pass' ELSE 'warning' END AS status, refs FROM ("
    "SELECT i.design_id, i.grp, i.iface, string_agg(DISTINCT k.ref, ',' ORDER BY k.ref) AS refs, count(DISTINCT i.role) FILTER (i.role IN ('CC1', 'CC2')) AS cc"
    " FROM ifaces i JOIN comps k ON k.design_id = i.design_id AND list_contains(i.members, k.ref) WHERE i.type = 'USB' AND regexp_matches(k.value, '(?i)USB.?C|TYPE.?C') GROUP BY 1, 2, 3)",
    "proto_debug": "SELECT design_id, grp, iface, type || CASE WHEN gnd THEN '_GND_OK' ELSE '_GND_MISSING' END AS code, CASE WHEN gnd THEN 'pass' ELSE 'warning' END AS status, mem AS refs FROM dout"
    " UNION ALL SELECT design_id, grp, iface, type || CASE WHEN vref THEN '_VTREF_OK' ELSE '_VTREF_MISSING' END, CASE WHEN vref THEN 'pass' ELSE 'review' END, mem FROM dout"
    " UNION ALL SELECT design_id, grp, iface, 'SWD_NRST_OPTIONAL', 'review', mem FROM dout WHERE type = 'SWD' AND NOT nrst",
}
_rule("proto_i2c_bias", lambda t: c.proto_i2c_bias(_facts(t), _ctx(t), t.pins), PROTOCOL)
_rule("proto_i2c_drive", lambda t: c.proto_i2c_drive(_facts(t)), PROTOCOL)
_rule("proto_spi_driver", lambda t: c.proto_spi_driver(_facts(t)), PROTOCOL)
_rule("proto_spi_miso", lambda t: c.proto_spi_miso(_facts(t)), PROTOCOL)
_rule("proto_spi_cs", lambda t: c.proto_spi_cs(_facts(t)), PROTOCOL)
_rule("proto_uart", lambda t: c.proto_uart(_facts(t)), PROTOCOL)
_rule("proto_usb_pair", lambda t: c.proto_usb_pair(_facts(t)), PROTOCOL)
_rule("proto_usb_c_cc", lambda t: c.proto_usb_c_cc(_facts(t), t.comps), PROTOCOL)
_rule("proto_debug", lambda t: c.proto_debug(_facts(t), _ctx(t)), PROTOCOL)
V["protocol_rows"] = " UNION ALL ".join(f"({sql})" for sql in PROTOCOL.values())
query(
    "proto_summary",
    "SELECT design_id, grp, iface, count(*) FILTER (status = 'pass') AS pass, count(*) FILTER (status = 'review') AS review, count(*) FILTER (status = 'warning') AS warning,"
    " count(*) FILTER (status = 'error') AS error, CASE max(CASE status WHEN 'pass' THEN 0 WHEN 'review' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END)"
    " WHEN 0 THEN 'pass' WHEN 1 THEN 'review' WHEN 2 THEN 'warning' ELSE 'error' END AS worst FROM protocol_rows GROUP BY 1, 2, 3",
    V,
)(lambda t: c.proto_summary(c.protocol_checks(_facts(t), _ctx(t), t.pins, t.comps)))


def flagship(t):
    """Health of every design by all its graph, power and protocol rules."""
    issues = c.all_issues(_ctx(t), _nets(t), t.ncs, t.pins, t.eps, t.comps, _ifaces(t), _facts(t))
    return c.health_score(issues, t.nets, t.comps)


V["netlist_issues"] = " UNION ALL ".join(f"SELECT design_id, severity FROM ({sql})" for sql in ISSUES.values()) + " UNION ALL SELECT design_id, status FROM protocol_rows WHERE status <> 'pass'"
HEALTH = """SELECT design_id, error, warning, review, greatest(0, size - error) AS passed, greatest(0, 100 - error * 18 - warning * 6 - review * 2) AS score FROM (
      SELECT s.design_id, s.size, count(*) FILTER (i.severity = 'error') AS error, count(*) FILTER (i.severity = 'warning') AS warning, count(*) FILTER (i.severity = 'review') AS review
      FROM (SELECT design_id, count(*) AS size FROM (SELECT design_id FROM nets UNION ALL SELECT design_id FROM comps) GROUP BY 1) s LEFT JOIN netlist_issues i ON i.design_id = s.design_id GROUP BY 1, 2)"""
query("health_score", HEALTH, V)(flagship)
