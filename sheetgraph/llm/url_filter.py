"""URL filters over time: which list entries were active when a page was fetched.

Lists are kept as dated entries: on a day, a list adds or removes a value of a kind (`host` covers the host and
everything below it, `prefix` covers host and path from the left). Entries become validity intervals: per (list,
kind, value) the last entry of a day counts, and an entry lasts until the next day that has one. A capture is looked
up under every suffix of its host and every prefix of its path, however deep, and an as-of join keeps the intervals
that hold at its fetch time. `allow` lists win over `block`
lists.

The join is by key. Keys that many captures share are split into as many parts as they are too large, and their
intervals are repeated for each. Those keys are few whatever the input (each holds over 1/HOT_SHARE of all lookups, so
they have 2 x HOT_SHARE parts together at most), so that list alone is broadcast.

Defined cases: a null or unparsable url has no host, no key and verdict `keep`; entries with a null list, value or
date are ignored; two entries of one day and value: a `remove` wins; a capture without a fetch time matches nothing;
repeated captures are kept; empty tables: everything is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sheetgraph.llm.common import cut, table

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"
#: A key with more lookups than both is split.
HOT_LEAST, HOT_SHARE = 1000, 200


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def lookup_keys(url: Column) -> Column:
    """Array of keys: `host:` with each suffix of the host, `prefix:` with the host and each path prefix, none included."""
    labels = F.split(host(url), r"\.")
    n = F.size(labels)
    hosts = F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(F.lit("host:"), F.array_join(F.slice(labels, n - k + 1, k), ".")))
    parts = F.concat(F.array(host(url)), F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda p: p != ""))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat(F.lit("prefix:"), F.array_join(F.slice(parts, 1, k), "/")))
    return F.when(F.length(host(url)) > 0, F.concat(hosts, prefixes)).otherwise(F.array().cast("array<string>"))


def entry_key(kind: Column, value: Column) -> Column:
    """The key of an entry, written as those of captures: host in lower case, path as it is, no empty segments."""
    parts = F.filter(F.split(value, "/"), lambda p: p != "")
    return F.concat_ws(":", kind, F.array_join(F.concat(F.array(F.lower(F.get(parts, F.lit(0)))), F.slice(parts, 2, F.size(parts))), "/"))


def intervals(entries: DataFrame) -> DataFrame:
    """(list_id, action, kind, value, op, day) -> (list_id, action, key, valid_from, valid_to); valid_to null: still active."""
    e = entries.where("list_id is not null and value is not null and day is not null")
    key = entry_key(F.col("kind"), F.col("value"))
    e = e.groupBy("list_id", "action", key.alias("key"), "day").agg(F.bool_and(F.col("op") == "add").alias("adds"))
    until = F.lead("day").over(W.partitionBy("list_id", "action", "key").orderBy("day"))
    e = e.withColumn("valid_to", until).where("adds")
    return e.select("list_id", "action", "key", F.col("day").alias("valid_from"), "valid_to")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(page_id, url, fetched) -> the same and host, n_active, block_lists, allow_lists, since, verdict.

    n_active counts the active entries that match, since is the latest day one of them began.
    """
    key = F.concat(F.hex(F.xxhash64("page_id", "url", "fetched")), F.hex(F.xxhash64(F.lit(1), "url", "fetched", "page_id")))
    caps = captures.select("page_id", "url", "fetched").withColumn("_row", key)
    keyed = caps.distinct().select("_row", "fetched", F.explode(F.array_distinct(lookup_keys(F.col("url")))).alias("key"))
    keyed = cut(keyed)
    counts = keyed.groupBy("key").count()
    least = max(HOT_LEAST, keyed.count() // HOT_SHARE)
    salts = F.ceil(F.col("count") / least).cast("int")  # a part has about as many lookups as a key that is just not hot
    hot = cut(counts.where(F.col("count") > least).select(F.col("key").alias("_hot"), salts.alias("salts")))
    keyed = keyed.join(F.broadcast(hot), F.col("key") == F.col("_hot"), "left")
    keyed = keyed.withColumn("salt", F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64("_row"), F.col("salts")).cast("int")).otherwise(0))
    spans = intervals(entries).join(F.broadcast(hot), F.col("key") == F.col("_hot"), "left")
    spread = F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array(F.lit(0)))
    spans = spans.select("list_id", "action", F.col("key").alias("k"), "valid_from", "valid_to", F.explode(spread).alias("s"))
    live = (F.col("fetched") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to")))
    hits = keyed.join(spans, (F.col("key") == F.col("k")) & (F.col("salt") == F.col("s")) & live)
    lists = lambda a: F.array_join(F.array_sort(F.collect_set(F.when(F.col("action") == a, F.col("list_id")))), ",")
    found = hits.groupBy("_row").agg(F.count("*").alias("n"), lists("block").alias("b"), lists("allow").alias("a"), F.max("valid_from").alias("since"))
    out = caps.join(found, "_row", "left")
    blocked = (F.coalesce("b", F.lit("")) != "") & (F.coalesce("a", F.lit("")) == "")
    return out.select(
        "page_id", "url", "fetched", host(F.col("url")).alias("host"), F.coalesce("n", F.lit(0)).cast("long").alias("n_active"), F.coalesce("b", F.lit("")).alias("block_lists"),
        F.coalesce("a", F.lit("")).alias("allow_lists"), "since", F.when(blocked, "drop").otherwise("keep").alias("verdict"),
    )


def fetch_day(page_id: Column) -> Column:
    """The pages table has no fetch time: a day of 2020 to 2023 by the id."""
    return F.date_add(F.lit("2020-01-01").cast("date"), F.pmod(page_id * 7919, F.lit(1461)).cast("int"))


def derived_entries(pages: DataFrame) -> DataFrame:
    """Dated list entries made from the hosts and sections of the pages table: adds, removals, and adds again.

    Three lists: `spam` and `adult` block hosts, and `press` allows sections of hosts and whole paths, as deep and in the
    case they have.
    """
    h, section = host(F.col("url")), F.concat(host(F.col("url")), F.lit("/"), F.regexp_extract("url", r"^[a-z]+://[^/]+/([a-z]+)/", 1))
    hosts = pages.select(h.alias("value")).where("value <> ''").distinct().select("value", F.lit("host").alias("kind"))
    sections = pages.select(section.alias("value")).where("value not like '%/' and value not like '/%'").distinct().select("value", F.lit("prefix").alias("kind"))
    path = F.regexp_replace(F.regexp_extract("url", PATH, 1), "/+$", "")
    deep = pages.select(F.concat(host(F.col("url")), path).alias("value")).where("value like '_%/%' and value not like '%//%'").distinct().select("value", F.lit("prefix").alias("kind"))
    sections = sections.union(deep).distinct()
    n = F.conv(F.substring(F.md5(F.col("value").cast("binary")), 1, 8), 16, 10).cast("long")
    day = lambda k: F.date_add(F.lit("2020-01-01").cast("date"), F.pmod(n * k, F.lit(1200)).cast("int"))
    rows = F.array(*(F.struct(F.lit(op).alias("op"), day(k).alias("day")) for op, k in (("add", 1), ("remove", 3), ("add", 7))))
    lists = F.when(F.col("kind") == "prefix", "press").when(n % 2 == 0, "spam").otherwise("adult")
    picked = hosts.where(n % 3 != 0).union(sections.where(n % 4 == 0))
    out = picked.select(lists.alias("list_id"), F.when(F.col("kind") == "prefix", "allow").otherwise("block").alias("action"), "kind", "value", F.explode(rows).alias("e"))
    return out.select("list_id", "action", "kind", "value", "e.op", "e.day")


def query(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.select("page_id", "url", fetch_day(F.col("page_id")).alias("fetched"))
    return evaluate(captures, cut(derived_entries(pages)))


ORACLE = rf"""
WITH p AS (SELECT page_id, url, DATE '2020-01-01' + CAST((page_id * 7919) % 1461 AS INTEGER) AS fetched,
  lower(regexp_extract(url, '{HOST}', 1)) AS host, regexp_extract(url, '{PATH}', 1) AS path FROM pages),
picked AS (
  SELECT 'host' AS kind, value FROM (SELECT DISTINCT host AS value FROM p WHERE host <> '')
  WHERE ('0x' || substr(md5(value), 1, 8))::BIGINT % 3 <> 0
  UNION ALL SELECT 'prefix', value FROM (
    SELECT host || '/' || regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)/', 1) AS value FROM p
    UNION SELECT host || regexp_replace(path, '/+$', '') FROM p)
  WHERE value LIKE '_%/_%' AND value NOT LIKE '%//%' AND value NOT LIKE '%/' AND ('0x' || substr(md5(value), 1, 8))::BIGINT % 4 = 0),
entries AS (SELECT kind || ':' || value AS key, CASE WHEN kind = 'prefix' THEN 'allow' ELSE 'block' END AS action,
    CASE WHEN kind = 'prefix' THEN 'press' WHEN n % 2 = 0 THEN 'spam' ELSE 'adult' END AS list_id,
    DATE '2020-01-01' + CAST(n * o.k % 1200 AS INTEGER) AS day, bool_and(o.op = 'add') AS adds
  FROM (SELECT *, ('0x' || substr(md5(value), 1, 8))::BIGINT AS n FROM picked) CROSS JOIN (VALUES ('add', 1), ('remove', 3), ('add', 7)) AS o(op, k)
  GROUP BY ALL),
spans AS (SELECT *, lead(day) OVER (PARTITION BY list_id, action, key ORDER BY day) AS until FROM entries QUALIFY adds),
parts AS (SELECT DISTINCT page_id, url, fetched, host, string_split(host, '.') AS labels,
  list_concat([host], list_filter(string_split(path, '/'), lambda x: x <> '')) AS steps FROM p WHERE host <> ''),
keys AS (SELECT page_id, url, fetched, unnest(list_distinct(list_concat(
  list_transform(range(1, len(labels) + 1), lambda k: 'host:' || array_to_string(labels[len(labels) - k + 1:], '.')),
  list_transform(range(1, len(steps) + 1), lambda k: 'prefix:' || array_to_string(steps[1:k], '/'))))) AS key FROM parts),
found AS (SELECT page_id, url, fetched, count(*) AS n, max(day) AS since,
    coalesce(string_agg(DISTINCT list_id, ',' ORDER BY list_id) FILTER (action = 'block'), '') AS block_lists,
    coalesce(string_agg(DISTINCT list_id, ',' ORDER BY list_id) FILTER (action = 'allow'), '') AS allow_lists
  FROM keys JOIN spans USING (key) WHERE fetched >= day AND (until IS NULL OR fetched < until) GROUP BY 1, 2, 3)
SELECT p.page_id, p.url, p.fetched, p.host, coalesce(n, 0) AS n_active, coalesce(block_lists, '') AS block_lists,
  coalesce(allow_lists, '') AS allow_lists, since,
  CASE WHEN coalesce(block_lists, '') <> '' AND coalesce(allow_lists, '') = '' THEN 'drop' ELSE 'keep' END AS verdict
FROM p LEFT JOIN found f ON f.page_id IS NOT DISTINCT FROM p.page_id AND f.url IS NOT DISTINCT FROM p.url AND f.fetched IS NOT DISTINCT FROM p.fetched
"""
