"""Connected components by alternating large-star and small-star steps, each a partial aggregate and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import discard, materialise


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node and root (its component's smallest node) of every node of the edges (a, b); both of one comparable type.

    The minima are written before they are joined, so that AQE can split the join for a node with many edges.
    """
    edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while (now := _state(edges)) != before and now[0]:
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "large-star")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialise(large, "large-star-edges")
        discard(edges, least)
        least = materialise(large.groupBy("a").agg(F.min("b").alias("m")), "small-star")
        joined = large.join(least, "a")
        down = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialise(down.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "small-star-edges")
        discard(large, least)
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
