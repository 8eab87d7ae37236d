"""Connected components by alternating large-star and small-star steps, cut by stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relspan.sources.scratch import discard, staged


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of edges (a, b): component is the least node reachable.

    Each step gives every node's neighbours its least one as their neighbour, so stars form in about log(n) rounds;
    rows never exceed the edges. It ends when a round changes nothing.
    """
    up = staged(edges.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        state = up.agg(F.count("*"), F.bit_xor(F.xxhash64("lo", "hi"))).first()
        if mark == state:
            return up.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(up.select(F.col("lo").alias("node"), F.col("lo").alias("component"))).distinct()
        mark = state
        both = up.unionByName(up.select(F.col("hi").alias("lo"), F.col("lo").alias("hi")))  # lo: the node, hi: its neighbour
        # stored, so that both sides of the join are plain shuffles: Spark then splits the rows of a star's centre
        least = staged(both.groupBy("lo").agg(F.least(F.min("hi"), F.first("lo")).alias("m")), "least")
        large = staged(both.where("hi > lo").join(least, "lo").select(F.col("hi").alias("u"), "m").where("u <> m").distinct(), "large")
        low = large.groupBy("u").agg(F.min("m").alias("least"))
        small = large.join(low, "u").select(F.when(F.col("m") == F.col("least"), F.col("u")).otherwise(F.col("m")).alias("hi"), F.col("least").alias("lo"))
        last, up = up, staged(small.where("hi <> lo").select("lo", "hi").distinct(), "edges")
        discard(edges.sparkSession, last, least, large)
    raise RuntimeError(f"components still change after {most_rounds} rounds")
