"""Connected components by contraction: each node joins its neighbour of the lowest hash until no edge is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id of edges (a, b: long); component is the smallest id reachable.

    Hash order makes the number of rounds logarithmic in the longest path; a round's edges are distinct pairs of
    contracted nodes and are written, so a lost executor repeats one round at most.
    """
    edges = written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        low = F.min(F.struct(F.xxhash64("b"), F.col("b").alias("to")))["to"]
        hooks = both.groupBy(F.col("a").alias("node")).agg(low.alias("to"))
        hooks = written(hooks.select("node", F.when(F.xxhash64("to") < F.xxhash64("node"), F.col("to")).otherwise(F.col("node")).alias("to")))
        if labels is None:
            labels = hooks.select(F.col("node").alias("id"), F.col("to").alias("at"))
        else:
            labels = labels.join(hooks, labels["at"] == hooks["node"], "left").select("id", F.coalesce("to", "at").alias("at"))
        labels = written(labels)
        moved = edges.join(hooks.select(F.col("node").alias("a"), F.col("to").alias("c")), "a").join(hooks.select(F.col("node").alias("b"), F.col("to").alias("d")), "b")
        edges = written(moved.filter("c <> d").select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).distinct())
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    lowest = labels.groupBy("at").agg(F.min("id").alias("component"))
    return written(labels.join(lowest, "at").select("id", F.least("id", "component").alias("component")))
