"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefmill.llm.tables import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component): the smallest node reachable from each node that has an edge.

    Alternates two steps until nothing changes: every larger neighbour of a node is tied to the node's
    smallest neighbour, then every smaller one is. Chains shrink to stars in a number of rounds that grows
    with the logarithm of their length. Only minima are gathered per node, never neighbour lists, so a node
    with very many edges is summed up before the shuffle. Each round is written to the shared folder.
    """
    links = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    links = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        larger = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        larger = larger.filter("a <> b").distinct()
        low = larger.groupBy("a").agg(F.min("b").alias("m"))
        smaller = larger.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        links = cut(smaller.filter("a <> b").distinct(), "edges")
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    stars = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
