"""Connected components of a link table, without neighbour lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.shared import stored


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _to_smallest(edges: DataFrame, within: DataFrame) -> DataFrame:
    """Links (a, smallest of a's neighbours and a); the minimum is combined before its shuffle."""
    smallest = within.groupBy("a").agg(F.min("b").alias("__low"))
    return edges.join(smallest, "a").withColumn("__low", F.least("a", "__low"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; component is the smallest node reachable.

    Alternates large-star and small-star rounds until the links stop changing. A
    node with very many links is a skewed join key that adaptive execution splits;
    only a row count and a digest sum reach the driver.
    """
    links = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links",
    )
    before = None
    while True:
        state = links.agg(
            F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b") % 1_000_000_007), F.lit(0))
        ).first()
        if state == before or state[0] == 0:
            break
        before = state
        around = _both_ways(links)
        large = _to_smallest(around, around).where("b > a").select(F.col("b").alias("a"), F.col("__low").alias("b"))
        large = large.where("a <> b").distinct()
        small = _to_smallest(large, large)
        small = (
            small.select(F.col("b").alias("a"), F.col("__low").alias("b"))
            .unionByName(small.select("a", F.col("__low").alias("b")))
            .where("a <> b")
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            .distinct()
        )
        links = stored(small, "links")
    roots = links.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
