"""Rows that share a key, directly or through others, kept on one side of a split.

Keys are nodes; a row ties its keys together. A component is told by its smallest key, found by two steps in turn until
nothing changes: each key passes the smallest key it knows to its neighbours, and looks up what that one knows. Labels halve
their way to the smallest each round, so rounds grow with the logarithm of a chain's length. Only minima are gathered for a
key, summed up before they move; each round is saved.

A component goes to one side whole, by a hash of its smallest key. So sides come near the wanted share while no
component holds much of the rows; ``component_sizes`` shows those that do.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefmill.session import saved


def _key(name: str) -> Column:
    """A key as text that tells its column; null for null."""
    return F.when(F.col(name).isNotNull(), F.concat(F.lit(f"{name}="), F.col(name).cast("string")))


def key_components(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(key, component): each key, as ``column=value``, with the smallest key of its component."""
    listed = rows.select(F.array_sort(F.array_compact(F.array(*[_key(k) for k in keys]))).alias("ks")).filter(F.size("ks") > 0).distinct()
    # A row's first key stands for the row; the others are tied to it.
    ties = listed.select(F.get("ks", F.lit(0)).alias("a"), F.explode("ks").alias("b"))
    both = saved(ties.unionByName(ties.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "ties")
    labels = saved(both.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "key"), "labels")
    while True:
        # The smallest label among a key's neighbours (itself included).
        near = both.join(labels, both["b"] == labels["key"]).groupBy("a").agg(F.min("label").alias("label")).withColumnRenamed("a", "key")
        # That label's holder learns of it too, and may know a smaller one.
        told = labels.join(near.withColumnRenamed("label", "found"), "key").select(F.col("label").alias("key"), F.col("found").alias("label"))
        least = near.unionByName(told).groupBy("key").agg(F.min("label").alias("label"))
        least = saved(least, "labels")
        known = least.select(F.col("key").alias("label"), F.col("label").alias("further"))
        after = least.join(known, "label").select("key", F.least("label", "further").alias("label"))
        after = saved(after, "labels")
        before = labels.withColumnRenamed("label", "old")
        changed = not after.join(before, "key").filter("label <> old").isEmpty()
        labels = after
        if not changed:
            return labels.withColumnRenamed("label", "component")


def with_components(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows with ``component``; a row whose keys are all null has none."""
    found = key_components(rows, keys).withColumnRenamed("key", "_key")
    return rows.withColumn("_key", F.coalesce(*[_key(k) for k in keys])).join(found, "_key", "left").drop("_key")


def side(component: Column, alone: Column, share: float, seed: int = 0) -> Column:
    """Whether a row is on the first side; a row without component goes by ``alone``, its own key."""
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(component, alone))), 1, 13), 16, 10).cast("double")
    return drawn / F.lit(float(1 << 52)) < share


def split_by_keys(
    rows: DataFrame, keys: Sequence[str], row_key: str, share: float = 0.9, seed: int = 0
) -> tuple[DataFrame, DataFrame]:
    """Two tables that share no value of any of the keys; the first has about ``share`` of the components."""
    marked = with_components(rows, keys)
    first = side(F.col("component"), F.col(row_key).cast("string"), share, seed)
    marked = saved(marked.withColumn("_first", first), "sides")
    return tuple(marked.filter(kept).drop("_first", "component") for kept in (F.col("_first"), ~F.col("_first")))


def component_sizes(marked: DataFrame, least_share: float = 0.01) -> DataFrame:
    """Components with at least a share of the rows (component, n_rows, share), largest first."""
    total = marked.agg(F.count(F.lit(1)).alias("n")).scalar()
    sizes = marked.filter("component IS NOT NULL").groupBy("component").agg(F.count(F.lit(1)).alias("n_rows"))
    return sizes.withColumn("share", F.col("n_rows") / total).filter(F.col("share") >= least_share).orderBy(F.col("n_rows").desc(), "component")
