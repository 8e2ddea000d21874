"""Connected components of a distributed edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the least node around."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
    return both.join(least, "a").filter("b > a").select(F.col("least").alias("a"), "b")


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its lower neighbours are tied to the least of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("least"))
    lower = edges.join(least, "b").filter("a > least").select(F.col("least").alias("a"), F.col("a").alias("b"))
    return lower.unionByName(least.select(F.col("least").alias("a"), "b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for every node of an edge ``(a, b)`` of longs.

    Edges of a node with itself are ignored, so a node without another edge is not in the result. The work is joins and
    minima per node; only the number of edges and a checksum come to the driver. Each turn at least halves the depth of
    the trees, so there are as many turns as the logarithm of the longest path.
    """
    edges = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges, before = written(edges, "edges"), None
    while True:
        edges = written(_small_star(_large_star(edges).distinct()).distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("component")))
