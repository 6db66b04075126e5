"""Connected components of edge tables, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return (both.join(least, "a").where("b > a AND b > m")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them (here a > b)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label for every node of the edges (a, b): label is the smallest node it reaches.

    Large and small stars alternate until nothing moves, about log2 of the longest path times. Hot
    nodes are reduced before the shuffle in the aggregates, and are skewed joins, which adaptive
    execution splits. Loops, null ends and repeated edges add nothing; a node without other edges is left out.
    """
    stars = stored(edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last = None
    while True:
        # Two rounds between looks; only two sums reach the driver.
        now = stars.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if now == last or now.n == 0:
            break
        last = now
        stars = stored(_small_star(_large_star(stars)), "edges")
    found = stars.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
        stars.select(F.col("b").alias("node"), F.col("b").alias("label")))
    return found.groupBy("node").agg(F.min("label").alias("label"))
