"""Connected components of an edge table by alternating large-star and small-star steps.

Nodes are values that can be ordered (longs, digests) and a component is named by its smallest node.  Every step is a grouped
minimum (combined before the shuffle and written) and a join of two plain exchanges, of which Spark splits
what a node with very many edges makes long; no list of neighbours is gathered.  Each round is written to the shared folder, so a lost executor repeats one
round at most.  Rounds grow with the logarithm of the largest component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from csvloom.llm.common import release, stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "edges-least")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node's smaller neighbours, and the node, to the smallest of them."""
    least = stage(edges.groupBy("u").agg(F.min("v").alias("m")), "edges-least")
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges``: two columns of nodes, in any direction, repeated or not; null ends and loops are ignored.

    Returns ``node``, ``component`` for every node that has an edge to another.
    """
    u, v = (F.col(c) for c in edges.columns)
    held = stage(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where(u.isNotNull() & v.isNotNull() & (u != v)).distinct(), "edges")
    for _ in range(max_rounds):
        # done when the edges are stars: each larger node has one edge, to a node that has none upward
        tops = held.groupBy("u").agg(F.count("*").alias("n"))
        if tops.where("n > 1").isEmpty() and held.select("v").distinct().join(tops, F.col("v") == F.col("u"), "left_semi").isEmpty():
            nodes = held.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return nodes.unionByName(held.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component")))
        new = stage(_small_star(_large_star(held).distinct()).distinct(), "edges")
        release(held)
        held = new
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
