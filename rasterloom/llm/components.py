"""Connected components of an edge table, by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.session import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.filter("v < u")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    out = both.join(least, "u")
    moved = out.filter("v > u" if large else "v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        moved = moved.union(least.select("u", F.col("m").alias("v")))
    return moved.filter("u != v").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one node at most and none of those hangs on another: then each star is a component, named by its centre. (Small stars only point to smaller ids.)"""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up = 1 and down = 1").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest id reachable from each node of edges (u, v), ids of type long.

    Every step writes its edge table to the shared folder, so the plan stays short and a lost executor costs one step. Self loops, repeated edges and an empty table are fine; a null end drops the edge; a node without a partner isn't in the result.
    """
    now = edges.select("u", "v").dropna().filter("u != v")
    now = cut(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    while not _are_stars(now):
        now = cut(_star(_star(now, True), False), "cc")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
