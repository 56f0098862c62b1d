"""Connected components over link tables, with lineage cut by written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cellweft.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the smallest node reachable.

    Alternates large-star and small-star contractions until the links stop changing: each
    node points to the smallest of its neighbourhood, so the number of rounds grows with
    the logarithm of the longest path. Aggregates and joins on node only.
    """
    edges = written(_ordered(links.select("a", "b")), "links")
    state = None
    while True:
        edges = written(_small_star(_large_star(edges)), "stars")
        told = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(told) == state:
            break
        state = tuple(told)
    leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def _ordered(links: DataFrame) -> DataFrame:
    """Distinct links from the larger node to the smaller."""
    return links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    smallest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(smallest, "a").filter("b > a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    smallest = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(smallest, "a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
        smallest.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
