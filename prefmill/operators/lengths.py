"""Token-length statistics of prompt, chosen and rejected texts.

Every text is tokenised once. What moves between machines is one row per side and distinct length,
so all statistics after the first shuffle work on a table no larger than the longest text.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefmill.functions import text
from prefmill.functions.messages import unwrap_content
from prefmill.operators.batch import Loader, count_tokens_with

SIDES = ("prompt", "chosen", "rejected")

# The quantiles of the summary, and the bins of the histogram (edges, room above the maximum).
QUANTILES = {"median": 0.5, "q25": 0.25, "q75": 0.75, "q90": 0.90, "q95": 0.95, "q99": 0.99}
BIN_EDGES = 50
HEADROOM = 50

_WIDE = "decimal(38,0)"


def token_lengths(
    df: DataFrame,
    sides: Sequence[str] = SIDES,
    counter: Callable[[Column], Column] = text.token_count,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Token count per side; only these numbers (and ``keep``) go on."""
    return df.select(*keep, *[counter(unwrap_content(df, s)).alias(s) for s in sides])


def length_counts(lengths: DataFrame, sides: Sequence[str] = SIDES) -> DataFrame:
    """Rows per side and length."""
    tall = lengths.unpivot([], list(sides), "side", "length")
    return tall.filter("length is not null").groupBy("side", "length").agg(F.count("*").alias("n"))


def length_counts_with(df: DataFrame, loader: Loader, sides: Sequence[str] = SIDES) -> DataFrame:
    """Rows per side and length by a user's batch tokeniser, called once over the texts of all sides."""
    entries = [F.struct(F.lit(s).alias("side"), unwrap_content(df, s).alias("text")) for s in sides]
    tall = df.select(F.inline(F.array(*entries))).filter("text IS NOT NULL")
    counted = count_tokens_with(tall, "text", loader, "length")
    return counted.groupBy("side", "length").agg(F.count("*").alias("n"))


def length_stats(counts: DataFrame) -> DataFrame:
    """Mean, median, min, max, population deviation and upper quantiles per side.

    Sums are whole numbers, so the result does not depend on the order of rows. ``percentile`` holds
    one entry per distinct length.
    """
    value, n = F.col("length").cast(_WIDE), F.col("n").cast(_WIDE)
    sums = counts.groupBy("side").agg(
        F.sum(F.col("n")).alias("n_rows"),
        F.sum(F.col("length") * F.col("n")).cast("decimal(38,0)").alias("s1"),
        F.sum((value * value * n).cast(_WIDE)).alias("s2"),
        F.min("length").cast("double").alias("min"),
        F.max("length").cast("double").alias("max"),
        F.percentile("length", list(QUANTILES.values()), F.col("n")).alias("q"),
    )
    rows = F.col("n_rows").cast(_WIDE)
    spread = (rows * F.col("s2") - F.col("s1") * F.col("s1")).cast("double")
    return sums.select(
        "side",
        "n_rows",
        (F.col("s1").cast("double") / F.col("n_rows")).alias("mean"),
        "min",
        "max",
        (F.sqrt(spread) / F.col("n_rows")).alias("std"),
        *[F.get("q", F.lit(i)).alias(name) for i, name in enumerate(QUANTILES)],
    )


def length_histogram(counts: DataFrame, edges: int = BIN_EDGES, headroom: int = HEADROOM) -> DataFrame:
    """Rows per side in equal bins from 0 to the overall maximum plus headroom; empty bins included.

    The upper end is a scalar subquery over the count table. Bins are found with whole numbers, so no
    length falls on the wrong side of an edge. ``density`` is the share of the side's rows per unit.
    """
    bins = edges - 1
    top = (
        counts.agg((F.max(F.when(F.col("n") > 0, F.col("length"))) + headroom).alias("top")).scalar()
    ).cast("long")
    placed = counts.select("side", "n", top.alias("top"), F.expr(f"length * {bins}L").alias("scaled"))
    per_bin = placed.groupBy("side", "top", F.floor(F.col("scaled") / F.col("top")).alias("bin")).agg(
        F.sum("n").alias("n")
    )
    per_side = per_bin.groupBy("side", "top").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("filled"), F.sum("n").alias("total")
    )
    every_bin = per_side.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)).cast("array<long>")))
    n = F.coalesce(F.try_element_at("filled", F.col("bin")), F.lit(0))
    return every_bin.select(
        "side",
        "bin",
        (F.col("bin") * F.col("top") / bins).alias("bin_start"),
        ((F.col("bin") + 1) * F.col("top") / bins).alias("bin_end"),
        n.alias("n"),
        (n * bins / (F.col("total") * F.col("top"))).alias("density"),
    )


def length_density(counts: DataFrame, edges: int = BIN_EDGES, headroom: int = HEADROOM) -> DataFrame:
    """The histogram normalised so that each side's bins cover an area of one."""
    return length_histogram(counts, edges, headroom).select("side", "bin", "bin_start", "bin_end", "density")
