"""Connected components of a graph that no machine holds: alternating large and small stars over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cuts import cut


def _nearest(edges: DataFrame) -> DataFrame:
    """(u, v) with m, the least of u and its neighbours. The least is aggregated before it is shuffled; a hot u is a skewed join."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    return edges.join(least, F.col("u") == F.col("_u")).select("u", "v", "m")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """From edges (u, v), in any direction, repeated or not: (u, root) for each u that isn't its component's least member."""
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(edges)
    for _ in range(most_rounds):
        both = edges.union(edges.select("v", "u"))
        large = _nearest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        near = _nearest(large)
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = cut(small)
        before, state = state, _state(edges)
        if before == state:
            return edges.select("u", F.col("v").alias("root"))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
