"""Token-length statistics of a saved dataset."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from prefmill.functions.text import token_count
from prefmill.operators.batch import Loader
from prefmill.operators.lengths import length_counts, length_counts_with, length_histogram, length_stats, token_lengths
from prefmill.sources.readers import read_split
from prefmill.sources.writers import write_length_stats


def statistics(
    spark: SparkSession,
    address: str,
    out: str,
    counter: Callable[[Column], Column] = token_count,
    tokenizer: str = "words",
    loader: Loader | None = None,
) -> dict[str, DataFrame]:
    """Write the count table, summary and histogram below ``out``; texts are read and tokenised once.

    Tokens are counted by a column expression, or by the batch tokeniser that ``loader`` gives
    (see :mod:`prefmill.operators.batch`).
    """
    counts_path = f"{out}/length_counts"
    rows = read_split(spark, address)
    counted = length_counts_with(rows, loader) if loader else length_counts(token_lengths(rows, counter=counter))
    counted.write.parquet(counts_path)
    counts = spark.read.parquet(counts_path)
    stats, histogram = length_stats(counts), length_histogram(counts)
    write_length_stats(stats, f"{out}/token_length_stats", address, tokenizer)
    histogram.write.parquet(f"{out}/token_length_histogram")
    return {"counts": counts, "stats": stats, "histogram": histogram}
