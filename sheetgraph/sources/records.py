"""Reading model output and writing job histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IR_SCHEMA = "components array<struct<ref:string,value:string>>, nets array<struct<name:string,endpoints:array<struct<ref:string,pin:string>>>>, _corrupt string"
# Control and zero-width characters, reserved file names.
CONTROL = r"[\u0000-\u001F\u007F\u200B-\u200F\u2028\u2029\uFEFF]"
RESERVED = r"(?i)^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$"


def repaired(text: Column) -> Column:
    """Fences stripped and common punctuation defects mended; nothing is invented."""
    s = F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), r"```\s*$", "")
    s = F.translate(s, "“”‘’", "\"\"''")
    steps = [
        (r"^[^{]*", ""), (r",\s*([}\]])", "$1"), (r"([{,]\s*)([A-Za-z_][A-Za-z0-9_.-]*)(\s*:)", '$1"$2"$3'),
        (r'([,{]\s*"(?:\\.|[^"\\])*"\s*)(?=["{\[\d-]|true\b|false\b|null\b)', "$1: "), (r'(["}\]\d]|true|false|null)\s+(?="(?:\\.|[^"\\])*"\s*:)', "$1, "), (r"\}\s*\{", "},{"),
    ]
    for pattern, to in steps:
        s = F.regexp_replace(s, pattern, to)
    return s


def lenient_json(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, text) -> typed rows, and what could not be read: broken text, or no list of components or of nets."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = raw.select("id", "text", F.from_json(repaired(F.col("text")), IR_SCHEMA, options).alias("ir"))
    good = F.col("ir._corrupt").isNull() & F.col("ir.components").isNotNull() & F.col("ir.nets").isNotNull()
    return parsed.where(good).select("id", "ir.components", "ir.nets"), parsed.where(~F.coalesce(good, F.lit(False))).select("id", "text")


def job_write(frames: dict[str, DataFrame], path: str, batch: str | int) -> None:
    """Each table of some jobs' revisions, partitioned by tenant. Rows carry job_id and revision and are never changed, so a
    table only grows. A batch has a folder of its own: written again, after a failure or by a replay, it replaces itself."""
    for name, df in frames.items():
        df.write.mode("overwrite").partitionBy("tenant").parquet(f"{path}/{name}/batch={batch}")


def job_read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table as job_write left it; a revision that came in several batches counts once."""
    rows = spark.read.parquet(f"{path}/{name}").drop("batch")
    return rows.distinct()


def object_key(files: DataFrame) -> DataFrame:
    """Keys by content: tenant/job/kind/ab/sha.ext."""
    return files.select("file_id", F.concat(F.concat_ws("/", F.col("tenant").cast("string"), F.col("job_id").cast("string"), "kind", F.substring("sha", 1, 2), "sha"), F.lit("."), F.col("ext")).alias("key"))


def safe_file_name(name: Column, most: int = 120, fallback: str = "unnamed") -> Column:
    v = F.regexp_replace(F.coalesce(name, F.lit("")), CONTROL, "")
    for pattern, to in ((r"[\\/]", "_"), (r"\.{2,}", "_"), (r"[^A-Za-z0-9._,+\-]", "_"), (r"^[.\-]+", "_")):
        v = F.regexp_replace(v, pattern, to)
    v = F.when(F.regexp_extract(v, r"^[^.]*", 0).rlike(RESERVED), F.concat(F.lit("_"), v)).otherwise(v)
    return F.coalesce(F.nullif(F.substring(v, 1, most), F.lit("")), F.lit(fallback))


def safe_path(path: Column, fallback: str = "file") -> Column:
    parts = F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda p: ~p.isin("", ".", ".."))
    return F.coalesce(F.nullif(F.array_join(F.transform(parts, lambda p: safe_file_name(p, fallback=fallback)), "/"), F.lit("")), F.lit(fallback))


def file_manifest(files: DataFrame) -> DataFrame:
    """(path, content) -> path made safe, sha256 and bytes."""
    return files.select(safe_path(F.col("path"), "asset").alias("path"), F.sha2(F.col("content").cast("binary"), 256).alias("sha"), F.octet_length("content").cast("long").alias("bytes"))


def text_safety(rows: DataFrame, most: int = 200, strict_most: int = 64) -> DataFrame:
    """Control characters become blanks, blanks collapse, long texts are cut; with what was changed. strict_error says why
    a field that takes no mending (a part number) refuses the text."""
    text = F.coalesce("text", F.lit(""))
    v = F.trim(F.regexp_replace(F.regexp_replace(text, CONTROL, " "), r"\s+", " "))
    cut = F.substring(v, 1, most)
    strict = F.when(text.rlike(CONTROL), "control").when(F.length(text) > strict_most, "too_long").when(F.trim(text) == "", "empty")
    return rows.select("id", cut.alias("value"), (cut != text).alias("changed"), (F.length(v) > most).alias("truncated"), text.rlike(CONTROL).alias("had_control"), strict.alias("strict_error"))


def safe_names(rows: DataFrame) -> DataFrame:
    return rows.select("id", safe_file_name(F.col("name")).alias("file_name"), safe_path(F.col("name")).alias("path"))
