"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .runtime import stored


def state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def large_star(edges: DataFrame) -> DataFrame:
    """Link the greater neighbours of every node to the least of it and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Link every node and its lesser neighbours to the least of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of ``links`` besides the roots themselves; root is the least node of its component.

    A node's neighbours are only ever aggregated and joined, never gathered, so a hub is no unbounded
    group. Each round is written to the shared folder.
    """
    edges = stored(links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct())
    before = None
    while (now := state(edges)) != before and now[0]:
        before = now
        edges = stored(small_star(large_star(edges)))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
