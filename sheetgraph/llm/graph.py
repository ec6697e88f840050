"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetgraph.llm.common import cut, join_counted


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) links of longs -> (node, root), root being the smallest node reachable.

    Each round gives every node the smallest label among its neighbours' labels, then halves label chains, so the
    rounds needed grow with the logarithm of a component's width in practice. Labels are written at each round. Nodes of
    many links, and labels of many nodes, are joined by their counts, so neither a star nor a giant component meets in
    one task. Nodes without a link don't appear. Raises if max_rounds don't settle it.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root"), F.count("*").alias("degree")))
    links, nodes = both.count(), labels.count()
    if not nodes:
        return labels.select("node", "root")
    for _ in range(max_rounds):
        met = join_counted(both, labels.select(F.col("node").alias("a"), "root", "degree"), "a", "degree", links)
        near = met.groupBy("b").agg(F.min("root").alias("near"))
        hooked = cut(labels.join(near, labels["node"] == near["b"]).select("node", "root", "degree", F.least("root", "near").alias("low")))
        times = hooked.groupBy(F.col("low").alias("named")).agg(F.count("*").alias("times"))
        up = labels.select(F.col("node").alias("low"), F.col("root").alias("upper")).join(times, F.col("low") == F.col("named")).drop("named")
        least = F.least("low", "upper")
        new = cut(join_counted(hooked, up, "low", "times", nodes).select("node", least.alias("root"), "degree", (least != F.col("root")).alias("moved")))
        labels = new.select("node", "root", "degree")
        if new.where("moved").isEmpty():
            return labels.select("node", "root")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
