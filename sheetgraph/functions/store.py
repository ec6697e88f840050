"""What is written on the way goes to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a local session without one (a test) gets a folder of its own."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named is None and sc.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return named or tempfile.mkdtemp(prefix="sheetgraph-")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it from there: its plan, and what the optimizer knows of its rows, end."""
    path = f"{_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return dealt(df.sparkSession.read.schema(df.schema).parquet(path))


def dealt(df: DataFrame) -> DataFrame:
    """df, whose joins shuffle both sides: the optimizer takes a table for as small as its compressed files and knows nothing
    of rows exploded from them, so it would broadcast, through the driver, what is many times as large."""
    return df.hint("merge")


_folders: dict[str, str] = {}


def _folder(spark: SparkSession) -> str:
    """One folder a session."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    return _folders[app]


def remove(df: DataFrame) -> None:
    """Delete what cut() wrote for df; df can't be read any more."""
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
