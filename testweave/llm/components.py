"""Connected components over an edge table, by alternating stars.

Each round attaches the larger neighbours of every node to its smallest neighbour, then the smaller ones. Only
minima per node are grouped (combined before the shuffle), hubs meet their minimum in an equi-join that Spark can
split, and every round is written to the shared folder, so lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, meet


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 999_983)).first())


def connected_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, component) for each node of ``edges`` (two columns of ids); component is the smallest node reachable.

    Nulls and loops are dropped: a node that has no other edge is in no row.
    """
    a, b = (F.col(c) for c in edges.columns[:2])
    e = edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = materialize(e, "edges")
    before = _state(e)
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = meet(both.where("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        met = meet(large, low, "u")
        small = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        last, e = e, materialize(small.distinct(), "edges")
        discard(last)
        now = _state(e)
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
