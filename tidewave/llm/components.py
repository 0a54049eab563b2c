"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored


def _sign(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _least(edges: DataFrame) -> DataFrame:
    # written out, so that both sides of the join that follows are exchanges
    # and adaptive execution can split the rows of a hub
    return stored(edges.groupBy("u").agg(F.min("v").alias("m")))


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``links``; root is the smallest node reachable.

    Each round points every neighbourhood at its minimum (Kiveris et al. 2014);
    the edges end as stars around the roots after about log(n) rounds. All
    state is distributed and written out after each step, so that lost
    executors cost one step; what a step no longer needs is deleted. Null ends and loops are ignored; no links give
    no rows.
    """
    edges = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    edges = stored(edges.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    before = _sign(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = _least(both)
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = stored(large.distinct())
        least = _least(large)
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        behind = [edges, lowest, large, least]
        edges = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        for df in behind:
            forget(df)
        if (now := _sign(edges)) == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
