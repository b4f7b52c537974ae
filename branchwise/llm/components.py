"""Connected components of an edge list, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from branchwise.session import durable


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are tied to its smallest neighbour (itself included)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("_low"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("_low").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are tied to the smallest of them. ``edges``: a > b."""
    low = edges.groupBy("a").agg(F.min("b").alias("_low"))
    tied = edges.join(low, "a").where("b <> _low").select(F.col("b").alias("a"), F.col("_low").alias("b"))
    return tied.unionByName(low.select("a", F.col("_low").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: for every node of ``edges`` (``a``, ``b``; numbers) the smallest node of its component.

    Each round is two aggregations and joins over at most as many edges as there were; the number of rounds grows
    with the logarithm of the longest path. It ends when all edges lead from a node to a root that is no node's child.
    """
    edges = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        edges = durable(_small_star(_large_star(edges)))
        inner = edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi")
        twice = edges.groupBy("a").count().where("count > 1")
        if not inner.take(1) and not twice.take(1):
            roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
