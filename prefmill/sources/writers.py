"""Writers. All go through Spark's commit protocol, so a lost executor leaves no partial file."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefmill.sources.readers import unscored_only

# Member names of the length summary file.
STAT_NAMES = ("mean", "median", "min", "max", "std", "q25", "q75", "q90", "q95", "q99")


def write_pairs(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), kind: str = "parquet", mode: str = "errorifexists"
) -> None:
    """Save a dataset, with one folder per value of the partition columns (such as ``split``)."""
    writer = df.write.mode(mode).format(kind)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_bucketed(df: DataFrame, table: str, key: Sequence[str], buckets: int, mode: str = "errorifexists") -> None:
    """Save a table bucketed and sorted by key, so later joins on that key need no shuffle."""
    df.write.mode(mode).format("parquet").bucketBy(buckets, *key).sortBy(*key).saveAsTable(table)


def write_responses(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Save stage results as JSON lines; null members are kept."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_prompts_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Save prompts as JSON lines in UTF-8 without escapes."""
    df.write.mode(mode).option("encoding", "UTF-8").json(path)


def length_summary(stats: DataFrame, path: str, tokenizer: str) -> DataFrame:
    """The length statistics of one dataset as a single nested row."""
    sides = [
        F.max(F.when(F.col("side") == side, F.struct(*STAT_NAMES))).alias(side)
        for side in ("prompt", "chosen", "rejected")
    ]
    info = F.struct(
        F.lit(path).alias("path"), F.max("n_rows").alias("size"), F.lit(tokenizer).alias("tokenizer")
    )
    return stats.agg(info.alias("dataset_info"), *sides)


def write_length_stats(stats: DataFrame, path: str, dataset: str, tokenizer: str, mode: str = "errorifexists") -> None:
    """Save the length statistics as one JSON object."""
    length_summary(stats, dataset, tokenizer).write.mode(mode).json(path)


def eval_summary_row(summary: DataFrame) -> DataFrame:
    """Summary rows (null prompt type = overall) as the maps of one summary object.

    The rows are one per metric and prompt type, so the maps are small whatever was evaluated.
    """
    entry = F.struct("metric", "value")
    per_type = summary.groupBy("prompt_type").agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
    typed = F.col("prompt_type").isNotNull()
    return per_type.agg(
        F.max_by("m", (~typed).cast("int")).alias("metrics"),
        F.map_from_entries(F.collect_list(F.when(typed, F.struct("prompt_type", "m")))).alias("prompt_type_metrics"),
    )


def write_eval_results(
    scored: DataFrame | None, summary: DataFrame, path: str, mode: str = "errorifexists"
) -> None:
    """Save per-example results (parquet; None when saved before) and the summary object (JSON)."""
    if scored is not None:
        scored.write.mode(mode).parquet(f"{path}/results")
    eval_summary_row(summary).write.mode(mode).option("ignoreNullFields", "false").json(f"{path}/summary")


def score_incremental(
    pairs: DataFrame, results: DataFrame | None, key: Sequence[str], score: Callable[[DataFrame], DataFrame], path: str
) -> None:
    """Score the rows that have no result yet and append them to the results folder."""
    todo = pairs if results is None else unscored_only(pairs, results, key)
    score(todo).write.mode("append").parquet(path)
