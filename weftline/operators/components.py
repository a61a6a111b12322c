"""Connected components of an undirected edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import checkpointed


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); the component is its smallest node.

    Each round hooks the larger neighbours of a node to its smallest neighbour, then the smaller ones. Rounds grow with
    the logarithm of the longest path. Each is written to the checkpoint folder, so a lost executor costs one round.
    Null and equal ends make no edge.
    """
    pairs = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select("b", "m").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = checkpointed(small.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct())
        state = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
    stars = pairs.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    centres = stars.select(F.col("component").alias("node"), "component").distinct()
    return stars.unionByName(centres)
