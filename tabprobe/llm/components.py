"""Connected components of a graph whose edges are spread over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.llm.common import stored


def _smallest(edges: DataFrame) -> DataFrame:
    """Each node with the smallest of itself and its neighbours; summed up before the shuffle."""
    return edges.groupBy("u").agg(F.min("v").alias("low")).select(
        F.col("u").alias("of"), F.least("u", "low").alias("low"))


def components(links: DataFrame) -> DataFrame:
    """node and component (smallest node reachable) of every node of `links` (columns a, b).

    Alternates large and small stars until nothing changes, in about log n rounds. Each round is
    written to the shared folder. A node with very many links is one row of an aggregate, and its
    edges are joined back by a join that adaptive execution can split. No links give no rows; an
    edge given twice, in both directions or from a node to itself changes nothing.
    """
    edges = stored(links.filter("a <> b").select(
        F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = _smallest(both)
        large = both.join(low, F.col("u") == F.col("of")).filter("v > u").select(
            F.col("low").alias("v"), F.col("v").alias("u")).filter("u <> v").distinct()
        large = stored(large, "large-star")
        low = _smallest(large)
        joined = large.join(low, F.col("u") == F.col("of"))
        edges = stored(
            joined.select(F.col("low").alias("v"), F.col("v").alias("u"))
            .unionByName(joined.select(F.col("low").alias("v"), F.col("u").alias("u")))
            .filter("u <> v").distinct(), "small-star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(
        stars.select(F.col("component").alias("node"), "component").distinct())
