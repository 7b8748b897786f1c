"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step: each node's neighbours (large: the greater ones; small: the lesser ones and itself) move to its least neighbour."""
    if large:
        both = edges.select(F.col("u").alias("n"), F.col("v").alias("m")).union(edges.select(F.col("v").alias("n"), F.col("u").alias("m")))
    else:
        both = edges.select(F.greatest("u", "v").alias("n"), F.least("u", "v").alias("m"))
    least = both.groupBy("n").agg(F.min("m").alias("low")).select("n", F.least("low", "n").alias("low"))
    moved = both.join(least, "n")
    if large:
        moved = moved.filter("m > n").select(F.col("m").alias("u"), F.col("low").alias("v"))
    else:
        moved = moved.select(F.col("m").alias("u"), F.col("low").alias("v")).union(least.select(F.col("n").alias("u"), F.col("low").alias("v")))
    return moved.filter("u <> v").distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) for each node of an edge table (u, v) of longs; root is the least node of its component.

    Nodes without edges, null ends and loops don't appear. Every round is checkpointed, so lost executors cost one round;
    rounds grow with the logarithm of the longest path. An empty table gives an empty result.
    """
    edges = checkpoint(edges.select("u", "v").dropna().filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    for _ in range(most):
        edges = checkpoint(_stars(_stars(edges, True), False))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    # at rest every edge leads from a node straight to its root
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
