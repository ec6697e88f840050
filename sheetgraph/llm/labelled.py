"""Bounded samples of labelled documents, to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample(docs: DataFrame, labels: DataFrame, label: str, most_0: int, most_1: int) -> DataFrame:
    """(doc_id, text, y, weight): at most so many documents of either label, first by a hash of their ids.

    Rows without a label or id are left out; an id with both labels counts as 1. weight makes up for the share of
    each label that is taken. The ids are at most most_0 + most_1 longs, so they are broadcast.
    """
    known = labels.select("doc_id", label).where(f"{label} in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max(label).cast("int").alias("y"))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    part = lambda y, most: known.where(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(most)
    ids = part(0, most_0).union(part(1, most_1))
    share = [max(1.0, sizes.get(0, 0) / most_0), max(1.0, sizes.get(1, 0) / most_1)]
    weight = F.when(F.col("y") == 1, share[1]).otherwise(share[0])
    texts = docs.select("doc_id", "text")  # nothing else of docs, whatever its name
    return texts.join(F.broadcast(ids), texts["doc_id"] == ids["_id"]).select("doc_id", "text", "y", weight.alias("weight"))
