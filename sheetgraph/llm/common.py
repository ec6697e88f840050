"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n).cast("int")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a local session without one (a test) gets a folder of its own."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named is None and not sc.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return named or tempfile.mkdtemp(prefix="spark-ckpt-")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it from there."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def whole_rows(docs: DataFrame, *names: str) -> DataFrame:
    """docs as one struct column `row`, and some of its columns beside it, so that no other name can clash."""
    return docs.select(F.struct("*").alias("row"), *(F.col(f"`{n}`").alias(n) for n in names))


def text_key(text: Column) -> Column:
    """What tells rows of one id apart: a hash of the text."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


#: A key with more rows than this and than this share of all is hot.
HOT_LEAST, HOT_SHARE = 1000, 500


def join_counted(left: DataFrame, right: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Inner join of left (any number of rows a key) with right (one row a key; n: how many rows left has of it).

    Hot keys are few whatever the input (each has over 1/HOT_SHARE of all `total` rows of left), so their rows of right
    are broadcast and left's need no shuffle; the others meet by a shuffle on the key. n is dropped.
    """
    hot = F.col(n) > max(HOT_LEAST, total // HOT_SHARE)
    found = F.struct(*(c for c in right.columns if c not in (key, n)))
    if right.where(hot).isEmpty():
        return left.join(right.select(F.col(key).alias("_cold"), found.alias("_found")), F.col(key) == F.col("_cold")).select(*left.columns, "_found.*")
    few = right.where(hot).select(F.col(key).alias("_hot"), found.alias("_found"))
    marked = left.join(F.broadcast(few), F.col(key) == F.col("_hot"), "left")
    cold = marked.where("_hot is null").drop("_hot", "_found").join(right.where(~hot).select(F.col(key).alias("_cold"), found.alias("_found")), F.col(key) == F.col("_cold"))
    return marked.where("_hot is not null").drop("_hot").unionByName(cold.drop("_cold")).select(*left.columns, "_found.*")


def text_chunks(texts: list[str | None], most: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """(first index, texts) of consecutive runs of about `most` characters; a long text stands alone. Null: empty."""
    first, size, run = 0, 0, []
    for i, t in enumerate(texts):
        t = t if isinstance(t, str) else ""
        if run and size + len(t) > most:
            yield first, run
            first, size, run = i, 0, []
        run.append(t)
        size += len(t)
    if run:
        yield first, run
