"""Connected components by label propagation over edges, for arrays of detections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import dropped, written


def labelled(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of an undirected graph (a, b) of longs; root is the smallest node that can be reached.

    Each round hangs every node's larger neighbours on its smallest one, then every node and its
    smaller neighbours on the smallest of those: minima by node, combined before the shuffle, and joins.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct(), "graph")
    state = None
    for _ in range(rounds):
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first())
        if mark == state or not mark[0]:
            break
        state = mark
        ways = now.union(now.select("y", "x"))
        low = ways.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        far = ways.where("y > x").join(low, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        deep = far.groupBy("x").agg(F.min("y").alias("m"))
        near = far.join(deep, "x").where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y")).union(deep)
        new = written(near.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), "graph")
        dropped(now)
        now = new
    else:
        raise RuntimeError("labels did not settle")
    top = now.groupBy("x").agg(F.min("y").alias("root")).toDF("node", "root")
    return top.union(now.select(F.col("y").alias("node"), F.col("y").alias("root")).distinct())
