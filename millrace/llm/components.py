"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, rounds: int = 200) -> DataFrame:
    """edges: (a, b) longs, in any order, repeats and loops allowed. Returns (node, component) for
    every node that has a link; component is the smallest node that it reaches. No links: no rows.

    Each round moves links towards the smallest node of each neighbourhood, so their number never
    grows and the rounds are logarithmic in practice. The minima are kept as tables before they are
    joined, so that the join's two inputs are plain exchanges, which Spark can split at a hub.
    """
    e = scratch.keep(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(rounds):
        mark = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1000003)).first())
        if mark == before or not mark[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b")).distinct()
        before = mark
        both = e.union(e.select("b", "a")).toDF("u", "v")
        least = scratch.keep(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = scratch.keep(both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        small = scratch.keep(large.groupBy("a").agg(F.min("b").alias("m")))
        linked = large.join(small, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = scratch.keep(linked.union(small).distinct())
        scratch.drop(e, least, large, small)
        e = after
    raise RuntimeError(f"components did not settle within {rounds} rounds")
