"""Connected components by alternating large-star and small-star steps.

Each step replaces edges by edges to a neighbourhood minimum: a ``groupBy`` with partial aggregation and a
join, so a node with a third of all edges is never one task's group. The edge table is written to the
shared folder after each round, which cuts the lineage; nothing is collected but two counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadmill.llm.scratch import Scratch


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the smallest node of u's closed neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of u, and u, is linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def is_star_forest(edges: DataFrame) -> bool:
    """Each child has one parent and no parent is a child."""
    per_child = edges.groupBy("u").agg(F.count("*").alias("n"))
    if per_child.where("n > 1").limit(1).count():
        return False
    return not edges.select(F.col("v").alias("u")).distinct().join(edges.select("u"), "u", "left_semi").limit(1).count()


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v) links to a table (node, component): the smallest node each one reaches, for nodes with links."""
    edges = scratch.write(small_star(links.select("u", "v").where("u <> v")), "edges")
    while not is_star_forest(edges):
        newer = scratch.write(small_star(large_star(edges)), "edges")
        scratch.drop(edges)
        edges = newer
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
