"""Connected components of a graph of links, wholly on the cluster.

Rounds of large-star and small-star steps: each hangs every node on the least node of its
neighbourhood, so trees become stars after a few rounds, and a hub costs one row a neighbour.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import checkpointed, salted_join


def _on_least(pairs: DataFrame, upward: bool) -> DataFrame:
    """Links (a, b), a > b, between each neighbour of a node and the least of them all."""
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = salted_join(pairs, least, ["a"], "b")
    if upward:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return joined.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
        least.where("a > m").select("a", F.col("m").alias("b"))
    )


def components(links: DataFrame) -> DataFrame:
    """``links`` has two columns of node ids.  Returns (``node``, ``component``): every node
    that is not the least of its component, with the least."""
    a, b = links.columns
    edges = (
        links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct()
    )
    edges, before = checkpointed(edges), None
    while True:
        state = edges.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if state == before or not state[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = state
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _on_least(both, upward=True).distinct()
        edges = checkpointed(_on_least(large, upward=False).distinct())
