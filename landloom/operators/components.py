"""Connected components as joins: alternating large-star and small-star steps, each cut by a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from landloom.session import cut


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour greater than u is tied to the smallest of u and its neighbours."""
    all_ways = _both_ways(edges)
    least = all_ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return all_ways.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are tied to the smallest of them. Edges come as (u, v) with v < u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Components of the graph with these edges.

    Returns one row (node, component) for each node of an edge; component is its smallest node. Edges that hold a null
    are no edges; loops give a component of one node; repeated edges count once; no edges give no rows. The columns may be of any
    orderable type, and other columns are ignored. Only counts reach the driver.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    start = cut(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    nodes = start.select("u").union(start.select("v")).distinct()
    now = start.where("u <> v")
    while True:
        now = cut(_small_star(_large_star(now)))
        # Done when the edges are stars: each node has one target, which has none itself.
        parents = now.groupBy("u").agg(F.count("*").alias("n"))
        loose = now.select(F.col("v").alias("u")).distinct().join(parents, "u", "left_semi").select("u").limit(1).union(parents.where("n > 1").select("u").limit(1))
        if not loose.take(1):
            break
    return nodes.join(now, "u", "left").select(F.col("u").alias("node"), F.coalesce("v", "u").alias("component"))
