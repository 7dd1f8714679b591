"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import materialise, spread_join


def _to_least(pairs: DataFrame, heavy: int) -> DataFrame:
    """u, v, m of pairs (u, v): each v with the least of its u's other ends and u itself. Stars of over `heavy` edges are spread."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree")).select("u", F.least("u", "m").alias("m"), "degree")
    return spread_join(pairs, "u", least, ["m"], F.col("degree") > heavy, F.col("v"))


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (its least node) for every node of links (a, b); nodes are comparable values, links without nulls.

    Each round costs two joins on edges that shrink to stars; the number of rounds grows with the
    logarithm of the longest chain. Rounds end when no edge changes.
    """
    edges = materialise(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("mark")
    last, n = edges.agg(mark, F.count(F.lit(1))).first()
    if last is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        heavy = max(64, n // 1024)  # the edges of both directions have at most 2048 such stars
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both, heavy).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        small = _to_least(large, heavy)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        edges = materialise(small.where("u != v").distinct())
        now, n = edges.agg(mark, F.count(F.lit(1))).first()
        if now == last:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        last = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
