"""Connected components of an edge list by alternating large and small stars, in Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize


def large_star(e: DataFrame) -> DataFrame:
    """Every node sends its smallest neighbour to its larger neighbours."""
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(e: DataFrame) -> DataFrame:
    """Every node sends its smallest neighbour to its smaller ones; edges have u > v."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge, root the smallest node of its component.

    edges: columns u and v (long), any direction, repeats and loops allowed. Each
    round is written to the shared folder, so that lost executors cost one round.
    The stars end as one edge per node that is not a root.
    """
    e = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        new = materialize(small_star(large_star(e).where("u <> v").distinct()).distinct(), "edges")
        now = tuple(new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        forget(e)
        e = new
        if now == seen:
            roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
        seen = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
