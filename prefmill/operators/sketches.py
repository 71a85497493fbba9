"""Saved sketches of growing data: distinct counts and quantiles that new shards extend without reading old ones.

A state is a folder with a row for each shard and group: counts, and mergeable sketches (HyperLogLog for distinct
values, KLL for quantiles). Shards already in the state are left out before anything is read of their texts, and what is
new is added as a whole or not at all. Summaries merge the sketches of all shards; nothing else is read.

A shard's name stands for its content: to replace a shard, give it another name and drop the old one from the state.
One job at a time may extend a state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefmill.operators.quantiles import exact_quantiles
from prefmill.session import exists

CARD_COLUMNS = ("domain", "task", "code_form")
#: Registers of a distinct count, as a power of two; its standard error is 1.04 / sqrt(registers).
REGISTERS = 14
#: Size of a quantile sketch; ranks are off by less than ``rank_error`` (at 99 %).
KLL = 1024
#: Known shards that are named in a filter; more are joined.
LISTED = 5000


def distinct_error(registers: int = REGISTERS) -> float:
    """Three standard errors of a distinct count, as a share of it."""
    return 3 * 1.04 / (1 << registers) ** 0.5


def rank_error(k: int = KLL) -> float:
    return 2.446 / k**0.9433


def new_shards(spark: SparkSession, rows: DataFrame, path: str, shard: str) -> DataFrame:
    """The rows of shards that the state does not have; a null shard is refused."""
    named = rows.filter(F.assert_true(F.col(shard).isNotNull(), "a row has no shard").isNull())
    if not exists(spark, f"{path}/part-*"):
        return named
    known = spark.read.parquet(path).select(shard).distinct()
    listed = known.limit(LISTED + 1).collect()
    if len(listed) <= LISTED:  # a filter that reaches the scan, so that folders of known shards are not opened
        return named.filter(~F.col(shard).isin([r[0] for r in listed]))
    return named.join(known, shard, "left_anti")


def extend_card(
    spark: SparkSession, pairs: DataFrame, path: str, shard: str, by: Sequence[str] = (), columns: Sequence[str] = CARD_COLUMNS, registers: int = REGISTERS
) -> None:
    """Add the new shards' row counts and distinct-value sketches to the state."""
    sketches = [F.hll_sketch_agg(F.col(c), registers).alias(f"hll_{c}") for c in columns]
    added = new_shards(spark, pairs, path, shard).groupBy(shard, *by).agg(F.count(F.lit(1)).alias("n_rows"), *sketches)
    added.write.mode("append").parquet(path)


def card_from_state(state: DataFrame, by: Sequence[str] = (), columns: Sequence[str] = CARD_COLUMNS) -> DataFrame:
    """Rows and estimated distinct values over all shards, as ``n_<column>s``; exact counts come from ``dataset_card``."""
    merged = [F.hll_sketch_estimate(F.hll_union_agg(f"hll_{c}")).alias(f"n_{c}s") for c in columns]
    return state.groupBy(*by).agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), *merged)


def extend_quantiles(spark: SparkSession, values: DataFrame, path: str, shard: str, by: Sequence[str], value: str, k: int = KLL) -> None:
    """Add the new shards' counts, ends and quantile sketches to the state; nulls are left out."""
    v = F.col(value).cast("double")
    added = new_shards(spark, values.filter(v.isNotNull()), path, shard).groupBy(shard, *by).agg(
        F.count(F.lit(1)).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.kll_sketch_agg_double(v, k).alias("kll")
    )
    added.write.mode("append").parquet(path)


def _merged(state: DataFrame, by: Sequence[str]) -> DataFrame:
    return state.groupBy(*by).agg(
        F.sum("n").alias("_total"), F.min("low").alias("_min"), F.max("high").alias("_max"), F.kll_merge_agg_double("kll").alias("_kll")
    )


def quantiles_from_state(state: DataFrame, by: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """Each group's rows, ends and estimated quantiles over all shards, from the state alone."""
    found = [F.kll_sketch_get_quantile_double("_kll", F.lit(p)).alias(name) for name, p in probs.items()]
    return _merged(state, by).select(*by, F.col("_total").alias("n_rows"), F.col("_min").alias("min"), F.col("_max").alias("max"), *found)


def brackets_from_state(state: DataFrame, by: Sequence[str], probs: Sequence[float], k: int = KLL) -> DataFrame:
    """For each group and rank the values it lies between: four rank errors to each side."""
    reach = 4 * rank_error(k)

    def end(p: float, edge: str) -> Column:
        return F.col(edge) if not 0 < p < 1 else F.kll_sketch_get_quantile_double("_kll", F.lit(float(p)))

    low = F.array(*[end(p - reach, "_min") for p in probs])
    high = F.array(*[end(p + reach, "_max") for p in probs])
    return _merged(state, by).select(*by, "_total", low.alias("_low"), high.alias("_high"))


def exact_from_state(
    values: DataFrame, state: DataFrame, by: Sequence[str], value: str, probs: dict[str, float], k: int = KLL
) -> DataFrame:
    """Exact quantiles in one pass: the state's brackets replace the passes that count and sketch. The state must cover all rows."""
    return exact_quantiles(values, by, value, probs, brackets=brackets_from_state(state, by, list(probs.values()), k))


def extend_lengths(spark: SparkSession, lengths: DataFrame, path: str, shard: str, sides: Sequence[str]) -> None:
    """Add the new shards' length counts (side, length, n) to the state; ``lengths`` has the shard and a column a side."""
    tall = new_shards(spark, lengths, path, shard).unpivot([shard], list(sides), "side", "length").filter("length IS NOT NULL")
    tall.groupBy(shard, "side", "length").agg(F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)


def counts_from_state(state: DataFrame) -> DataFrame:
    """Length counts over all shards, for ``length_stats`` and ``length_histogram``: the same as those of one full run."""
    return state.groupBy("side", "length").agg(F.sum("n").alias("n"))
