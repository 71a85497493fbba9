"""File-to-file jobs that pick up new rows only."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from prefmill.operators.pairs import build_pairs, build_test_pairs
from prefmill.operators.quality import score_pairs
from prefmill.operators.responses import parse_responses


def follow(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    work: Callable[[DataFrame], DataFrame],
    target: str,
    checkpoint: str,
    source_format: str = "json",
    files_per_trigger: int = 1000,
) -> StreamingQuery:
    """Run ``work`` on every file not seen before and append the result to ``target``.

    Stops when the files present at the start are done. ``checkpoint`` must stay with ``target``.
    """
    rows = (
        spark.readStream.schema(schema)
        .format(source_format)
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(source)
    )
    return (
        work(rows)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(target)
    )


def pairs_from_responses(mode: str = "train", keep: Sequence[str] = ()) -> Callable[[DataFrame], DataFrame]:
    """Finished responses to pairs, for :func:`follow`."""
    build = build_test_pairs if mode == "test" else build_pairs
    return lambda responses: build(parse_responses(responses, mode), keep)


def scores_from_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs to scored pairs, for :func:`follow`."""
    return score_pairs(pairs)
