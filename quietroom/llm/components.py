"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour (or itself)."""
    both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u < v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every smaller neighbour of a node, and the node, to its smallest neighbour."""
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    up = edges.join(least, "v")
    return (up.select(F.col("m").alias("u"), F.col("u").alias("v"))
            .union(least.select(F.col("m").alias("u"), "v")).where("u < v").distinct())


def _digest(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit((1 << 31) - 1)))).first())


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) for every node with a link; the root is the smallest node of its component.

    Each step keeps the components and pulls nodes towards their smallest member; a fixed point
    is a star per component.  The number of steps grows with the logarithm of the longest
    path.  Only counts come to the driver.
    """
    a, b = F.col(u), F.col(v)
    now = staged(edges.where(a != b).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct())
    mark = _digest(now)
    while mark[0]:
        step = staged(_small_star(_large_star(now)))
        new = _digest(step)
        discard(now)
        now = step
        if new == mark:
            break
        mark = new
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).union(
        now.select(F.col("u").alias("node"), F.col("u").alias("root"))).distinct()
