"""Views derived from the driver tables, written once in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sheetgraph.functions.store import cut, dealt, remove


def pick(index: str, *names: str) -> str:
    """The name at an index from 0."""
    quoted = (n.replace("'", "''") for n in names)
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(quoted)) + " END"


def div(a: str, n: int) -> str:
    return f"CAST(floor(({a}) / {n}) AS BIGINT)"


BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")
REF = pick("ref_no % 10", "U", "IC", "R", "C", "J", "L", "R", "U", "R", "Q") + " || CAST(ref_no AS VARCHAR(20))"

FX: dict[str, str] = {
    # Netlist
    "raw_eps": "SELECT l_suppkey AS design_id, l_orderkey % 97 AS net_no, l_partkey % 40 AS ref_no, CAST(l_linenumber AS BIGINT) AS pin_no, max(100 - 5 * "
        "CAST(round(l_discount * 100) AS INT)) AS conf_pct FROM lineitem GROUP BY 1, 2, 3, 4",
    "eps": f"SELECT design_id, net_no AS net_id, {REF} AS ref, CAST(pin_no AS VARCHAR(20)) AS pin, conf_pct FROM raw_eps",
    "comp_nos": "SELECT DISTINCT design_id, ref_no FROM raw_eps",
    "comps": f"SELECT design_id, ref_no, {REF} AS ref, " + pick("(ref_no * 5 + design_id) % 8", "ADM8829", "MCP3204", "NE555", "MAX6106", "4.7k", "100n", "USB-C", "MCU") + " AS value, 40 + (ref_no * 7 + design_id) % 61 AS conf_pct FROM comp_nos",
    "pins": f"SELECT design_id, ref_no, {REF} AS ref, pin_no, CAST(pin_no AS VARCHAR(20)) AS number, "
    + pick("(ref_no * 3 + pin_no) % 16", "SDA", "SCL", "MOSI", "MISO", "SCK", "CS", "TX", "RX", "GND", "VCC", "USB_DP", "USB_DM", "SWDIO", "SWCLK", "OUT", "IN")
    + " AS name, CASE WHEN ref_no % 10 IN (2, 3, 5, 6, 8) THEN 'passive' ELSE "
    + pick("(ref_no * 7 + pin_no) % 10", "input", "output", "bidirectional", "power_in", "power_out", "passive", "tri_state", "open_collector", "no_connect", "unspecified")
    + " END AS type, 30 + (ref_no * 11 + pin_no * 7) % 71 AS conf_pct FROM (SELECT *, {seven} AS pin_no FROM comp_nos)",
    "nets": "SELECT design_id, net_no AS net_id, CASE WHEN net_no < 20 THEN "
    + pick("net_no", "GND", "VCC", "3V3", "SDA", "SCL", "MOSI", "MISO", "SCK", "CS", "TX", "RX", "USB_D+", "USB_D-", "VBUS", "CC1", "CC2", "SWDIO", "SWCLK", "NRST", "TCK")
    + " ELSE 'N$' || CAST(net_no AS VARCHAR(20)) END AS name, min(conf_pct) AS conf_pct FROM raw_eps GROUP BY design_id, net_no",
    "ncs": "SELECT design_id, ref, number AS pin FROM pins WHERE type = 'no_connect' OR (ref_no * 13 + pin_no * 5 + design_id) % 29 = 0",
    "ctx": "SELECT e.design_id, e.net_id, n.name AS net, n.conf_pct AS net_conf, e.ref, e.pin, p.name AS pin_name, p.type, p.conf_pct AS pin_conf FROM "
        "eps e JOIN nets n ON e.design_id = n.design_id AND e.net_id = n.net_id JOIN pins p ON e.design_id = p.design_id AND e.ref = p.ref AND e.pin "
        "= p.number",
    # Batches of an extraction: one per return flag; nets from number 60 on have no name
    "batches": "SELECT DISTINCT l_suppkey AS design_id, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS batch_no, l_orderkey % 97 AS net_no, "
        "l_partkey % 40 AS ref_no, CAST(l_linenumber AS BIGINT) AS pin_no, 100 - 5 * CAST(round(l_discount * 100) AS INT) AS conf_pct FROM lineitem",
    "batch_eps": f"SELECT design_id, batch_no, net_no AS net_id, CASE WHEN net_no < 60 THEN 'Net' || CAST(net_no AS VARCHAR(20)) ELSE '' END AS name, {REF} AS "
        "ref, CAST(pin_no AS VARCHAR(20)) AS pin, max(conf_pct) AS conf_pct FROM batches GROUP BY design_id, batch_no, net_no, ref_no, pin_no",
    "batch_comps": f"SELECT DISTINCT design_id, batch_no, {REF} AS ref, CASE WHEN (ref_no + batch_no) % 3 = 0 THEN NULL ELSE 'V' || CAST(ref_no AS VARCHAR(20)) "
        "|| '.' || CAST(batch_no AS VARCHAR(20)) END AS value, 50 + (ref_no * 7 + batch_no * 13) % 50 AS conf_pct FROM batches",
    # Packages and their pins
    "packages": "SELECT p_partkey AS package_id, "
    + pick("p_partkey % 12", "SOIC", "TSSOP", "VQFN", "PDIP", "SOT-23", "SOT-23-5", "DSBGA", "LQFP", "PLCC", "TO-220", "LGA", "XYZ")
    + " AS type, CAST("
    + pick(div("p_partkey", 12) + " % 8", "8", "14", "16", "20", "24", "5", "3", "9")
    + " AS BIGINT) AS pin_count, "
    + ", ".join(
        f"CASE WHEN (p_partkey + {k}) % 11 = 0 THEN NULL WHEN (p_partkey + {k}) % 17 = 0 THEN 99.0 ELSE CAST((p_size * {m} + {a}) AS DOUBLE) / 100.0 END AS {name}"
        for k, (name, m, a) in enumerate([("pitch", 1, 40), ("body_length", 10, 200), ("body_width", 8, 180), ("height", 2, 60), ("lead_span", 9, 400), ("lead_length", 1, 30), ("row_span", 7, 500)])
    )
    + ", CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size + 30 AS DOUBLE) / 100.0 END AS pad_w, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size + 90 AS "
        "DOUBLE) / 100.0 END AS pad_l, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 5 <> 0 THEN CAST(p_size * 7 + 450 AS DOUBLE) / 100.0 END AS "
        "lp_row_span FROM part",
    "raw_pins": "SELECT p_partkey AS package_id, i AS pos, CASE WHEN (p_partkey + i) % 19 = 0 THEN NULL WHEN (p_partkey + i) % 23 = 0 THEN CAST(i AS "
        "VARCHAR(20)) || ',' || CAST(i + 1 AS VARCHAR(20)) WHEN (p_partkey + i) % 29 = 0 THEN 'EP' WHEN (p_partkey + i) % 31 = 0 THEN '1' ELSE CAST(i "
        "AS VARCHAR(20)) END AS number, CASE WHEN (p_partkey * 3 + i) % 13 = 0 THEN '' ELSE "
    + pick("(p_partkey * 3 + i) % 16", "SDA", "SCL", "MOSI", "MISO", "SCK", "CS#", "/TX", "~RX", "GND", "VCC", "USB_DP", "USB_DM", "SWDIO", "SWCLK", "OUT", "IN")
    + " END AS name, " + pick("(p_partkey * 7 + i) % 11", "input", "output", "bidirectional", "power_in", "power_out", "passive", "tri_state", "open_collector", "no_connect", "unspecified", "weird")
    + " AS type FROM (SELECT p_partkey, {eight} AS i FROM part)",
    # Jobs and their history
    "ev": "SELECT event_id, ts, user_id, event_type, CAST({k} AS BIGINT) AS k FROM events",
    "jobs": "SELECT o_orderkey AS job_id, o_custkey % 5 AS tenant, o_custkey AS owner, CASE o_orderstatus WHEN 'F' THEN 'revoked' ELSE 'active' END AS "
        "status, o_orderdate AS created, o_orderkey % 400 AS ttl_days FROM orders",
    "ledger": "SELECT user_id AS principal, ts, event_id, CASE event_type WHEN 'signup' THEN 'topup' WHEN 'click' THEN 'reserve' WHEN 'purchase' THEN "
        "'commit' WHEN 'error' THEN 'refund' END AS op, CASE event_type WHEN 'signup' THEN 10 + k % 20 WHEN 'click' THEN 1 + k % 5 ELSE 0 END AS "
        "amount, coalesce(CASE WHEN event_type <> 'signup' THEN {reserved} OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - CASE WHEN event_type <> 'click' AND k % 7 = 0 THEN 1 ELSE 0 END END, 0) AS "
        "reservation FROM ev WHERE event_type IN ('signup', 'click', 'purchase', 'error')",
    "lifecycle": "SELECT user_id AS job_id, ts, event_id, CASE event_type WHEN 'click' THEN 'edit' WHEN 'view' THEN 'review' WHEN 'purchase' THEN 'approve' "
        "WHEN 'signup' THEN 'publish' WHEN 'error' THEN 'revoke' END AS action FROM ev WHERE event_type IN ('click', 'view', 'purchase', 'signup') OR "
        "(event_type = 'error' AND k = 0)",
    "requests": "SELECT event_id, ts, user_id % 5 AS tenant, user_id AS owner, event_type AS operation, k % 10 AS doc, k % 4 AS key FROM ev",
    "edits": "SELECT event_id, ts, user_id AS job_id, "
    + pick("event_id % 14", "packages/pitch", "packages/body_length", "pins/name", "pins/type", "figures/title", "figures/bbox", "part/mpn", "part/title", "packages/unknown", "figures/page", "figures/kind", "figures/confirmed", "packages/pin_count", "packages/lead_width")
    + " AS path, "
    + pick("k % 11", "0.5", "250", "input", "text", "[0.1, 0.2, 0.3, 0.4]", "[0.5, 0.2, 0.3, 0.4]", "3", "true", "application", "[0.1, 0.2, 0.3]")
    + " AS value, CASE WHEN event_id % 5 = 0 THEN ' ' ELSE 'seen on page ' || CAST(k AS VARCHAR(20)) END AS reason, "
    + pick("(event_id + k) % 13", '{"page": 3}', '{"page": 0}', '{"bbox": [0, 0, 1, 1]}', '{"bbox": [0, 0, 2, 1]}', '{"note": "seen"}', '{"colour": 1}', "[1]")
    + " AS evidence, k % 7 AS expected_revision FROM ev",
    # Lines of text
    "lines": "SELECT doc_id, line_no, " + div("line_no", 40) + " + 1 AS page, CAST(770 - 18 * (line_no % 40) AS DOUBLE) AS y, CASE (doc_id * 7 + line_no * 5) % 23 "
    + " ".join(
        f"WHEN {i} THEN {t}"
        for i, t in enumerate(
            [
                "'PIN NAME NO. TYPE DESCRIPTION'", "'NAME  D, PW  DSBGA  I/O  DESCRIPTION'", "'SDA ' || CAST(line_no % 24 + 1 AS VARCHAR(20)) || ' I/O Serial data'", "CAST(line_no % 24 + 1 AS VARCHAR(20)) || ' GND G Ground'",
                "'OUT ' || CAST(line_no % 24 + 1 AS VARCHAR(20)) || ' B' || CAST(line_no % 9 + 1 AS VARCHAR(20)) || ' O Output U12 and R7'", "'VDD ' || CAST(line_no % 24 + 1 AS VARCHAR(20)) || ' PWR supply'", "'EP Exposed thermal pad'", "'MECHANICAL DATA package outline U3 C14 GND +3.3V SDA'",
                "'Figure ' || CAST(line_no % 9 + 1 AS VARCHAR(20)) || '. Functional Block Diagram'", "'Figure ' || CAST(line_no % 9 + 1 AS VARCHAR(20)) || '. Typical Application vs Temperature'", "'Figure ' || CAST(line_no % 9 + 1 AS VARCHAR(20)) || '. Pin Configuration'",
                "'Functional Block Diagram'", "'Typical Application'", "'7 Specifications'",
            ]
        )
    )
    + " ELSE line END AS text FROM doc_lines",
    "doc_lines": "{split}",
    "tokens": "{tokens}",
}

SPARK = {
    "split": "SELECT doc_id, CAST(pos AS BIGINT) AS line_no, line FROM (SELECT doc_id, posexplode(split(text, '\\\\n')) AS (pos, line) FROM documents)",
    "tokens": "SELECT doc_id, page, line_no, y, CAST(pos AS BIGINT) AS token_no, str FROM (SELECT doc_id, page, line_no, y, posexplode(filter(split(text, "
        "'[ \\\\t\\\\r]+'), t -> t <> '')) AS (pos, str) FROM lines)",
    "k": "get_json_object(props, '$.k')",
    "reserved": "last_value(CASE WHEN event_type = 'click' THEN event_id END) IGNORE NULLS",
    "seven": "explode(sequence(1, 7))",
    "eight": "explode(sequence(1, 8))",
}
DUCK = {
    "split": "SELECT doc_id, CAST(u.pos - 1 AS BIGINT) AS line_no, u.line AS line FROM (SELECT doc_id, unnest(list_zip(range(1, len(s) + 1), s)) AS z, "
        "z[1] AS pos, z[2] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)) u",
    "tokens": "SELECT doc_id, page, line_no, y, z[1] - 1 AS token_no, z[2] AS str FROM (SELECT doc_id, page, line_no, y, unnest(list_zip(range(1, len(s) + "
        "1), s)) AS z FROM (SELECT *, list_filter(regexp_split_to_array(text, '[ \\t\\r]+'), lambda t: t <> '') AS s FROM lines))",
    "k": "json_extract_string(props, '$.k')",
    "reserved": "last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS)",
    "seven": "unnest([1, 2, 3, 4, 5, 6, 7])",
    "eight": "unnest([1, 2, 3, 4, 5, 6, 7, 8])",
}
ORDER = ["raw_eps", "eps", "comp_nos", "comps", "pins", "nets", "ncs", "ctx", "batches", "batch_eps", "batch_comps", "packages", "raw_pins", "ev", "jobs", "ledger", "lifecycle", "requests", "edits", "doc_lines", "lines", "tokens"]


def filled(sql: str, dialect: dict[str, str]) -> str:
    for name, text in dialect.items():
        sql = sql.replace("{" + name + "}", text)
    return sql


def needed(sql: str, extra: dict[str, str]) -> list[str]:
    """The views that sql reads, in order of definition."""
    import re

    names, todo, found = {**FX, **extra}, [sql], set()
    while todo:
        for word in set(re.findall(r"[A-Za-z_]\w*", todo.pop())):
            if word in names and word not in found:
                found.add(word)
                todo.append(names[word])
                if names[word].startswith("{"):
                    todo.append(DUCK[names[word].strip("{}")])
    return [n for n in [*ORDER, *extra] if n in found]


def duck_sql(sql: str, extra: dict[str, str] | None = None) -> str:
    """sql for DuckDB with the views it reads before it."""
    extra = extra or {}
    fill = lambda s: filled(s, DUCK)
    with_ = ",\n".join(f"{n} AS MATERIALIZED ({fill({**FX, **extra}[n])})" for n in needed(sql, extra))
    return f"WITH {with_}\n{sql}" if with_ else sql


#: Views that many queries of one session read: made once, written to the shared folder, so their plans end there. Views of
#: the netlist are made from the kept raw_eps, so that lineitem is shuffled once.
KEPT = ("raw_eps", "comps", "pins", "nets", "ncs")
_kept: dict[tuple[str, str, str], tuple[int, DataFrame]] = {}


def stamp(spark: SparkSession, sf_dir: str) -> int:
    """What changes when a table is written again: a hash of its files' names, sizes and times."""
    seen = []
    for name in BASE:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        for f in fs.listStatus(path) if fs.exists(path) else ():
            seen.append((f.getPath().getName(), f.getLen(), f.getModificationTime()))
    return hash(tuple(sorted(seen)))


def kept(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame], now: int) -> DataFrame:
    """A table made once a session, folder and content."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _kept or _kept[key][0] != now:
        if key in _kept:
            remove(_kept.pop(key)[1])
        _kept[key] = now, cut(make())
    return _kept[key][1]


def release() -> None:
    """Delete all kept tables."""
    while _kept:
        remove(_kept.popitem()[1][1])


#: Tables dealt by the first key of what is grouped from them: one shuffle, of rows by design.
DEALT = {"lineitem": "l_suppkey"}
#: Tables whose rows become many: a few row groups, read by as few tasks, hold millions of them. Bytes of a partition's share.
SPREAD, SPREAD_BYTES = {"part": "p_partkey"}, 1 << 18


def files_size(spark: SparkSession, path: str) -> int:
    """Bytes of a table's files."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


class Tables:
    """The views as DataFrames, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._stamp = spark, sf_dir, None

    def kept(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if self._stamp is None:
            self._stamp = stamp(self.spark, self.sf_dir)
        return kept(self.spark, self.sf_dir, name, make, self._stamp)

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in FX:
            raise AttributeError(name)
        return self.kept(name, lambda: self._view(name)) if name in KEPT else dealt(self._view(name))

    def _view(self, name: str) -> DataFrame:
        import re

        fill = lambda s: filled(s, SPARK)
        views, made = needed(f"SELECT * FROM {name}", {}), {}
        if name != "raw_eps" and "raw_eps" in views:
            self.raw_eps.createOrReplaceTempView(f"kept_raw_eps_{id(self)}")
            made["raw_eps"] = f"SELECT * FROM kept_raw_eps_{id(self)}"
        with_ = ",\n".join(f"{n} AS ({made.get(n) or fill(FX[n])})" for n in views)
        text = f"WITH {with_} SELECT * FROM {name}"
        text = re.sub(r"(FROM|JOIN) (" + "|".join(BASE) + r")\b", lambda m: f"{m[1]} {self._source(m[2])}", text)
        out = self.spark.sql(text)
        if made:
            self.spark.catalog.dropTempView(f"kept_raw_eps_{id(self)}")
        return out

    def _source(self, name: str) -> str:
        """A driver table in Spark's SQL; one whose rows become many is spread by its key first."""
        file = f"parquet.`{self.sf_dir}/{name}.parquet`"
        if name in DEALT:
            return f"(SELECT /*+ REPARTITION({DEALT[name]}) */ * FROM {file})"
        if name not in SPREAD:
            return file
        n = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), files_size(self.spark, f"{self.sf_dir}/{name}.parquet") // SPREAD_BYTES)
        return f"(SELECT /*+ REPARTITION({n}, {SPREAD[name]}) */ * FROM {file})"
