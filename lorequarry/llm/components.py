"""Distributed union-find: connected components by alternating large-star and small-star contraction.

Every step is an aggregation and a join on node ids, so no task or driver holds a component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace, large, swept


def _is_star_forest(e: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most, and none that has one itself."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    n = ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    with swept(e.sparkSession):
        return not n.agg(F.max((F.col("down") > 1) | ((F.col("down") > 0) & (F.col("up") > 0)))).first()[0]


def connected_components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` -> ``(node, component)``; ``component`` is the smallest node of the component.

    Self-loops and repeated edges are allowed; nodes without an edge to another node are not returned. An empty input
    gives an empty result. Each round writes its edges, so lineage stays short, and removes those of the round before.
    """
    e = edges.where("a <> b and a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = ws.save(e, "edges")
    while not _is_star_forest(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        up = both.join(large(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = up.groupBy("u").agg(F.min("v").alias("m"))
        star = up.join(large(low), "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        e, before = ws.save(star, "edges"), e
        ws.forget(before)
    leaves = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
