"""Evaluation of predictions as they arrive: running sums in the stream's state, a summary after every batch.

The state holds a row for each prompt type: rows, successes, and sum and count of each metric, which any number of new rows
only add to. After a batch its rows are saved under the batch's number; a batch that is done again after a failure finds
its files counted once by the checkpoint and writes the same folder again. So every row counts exactly once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from prefmill.operators.evaluation import EVAL_METRICS
from prefmill.session import exists

RATE = "execution_success_rate"


def eval_state(scored: DataFrame) -> DataFrame:
    """Sums of scored predictions (``prompt_type``, ``exec_success``, metrics) by prompt type."""
    sums = [F.count(F.lit(1)).alias("n_rows"), F.count_if("exec_success").alias("n_success")]
    for m in EVAL_METRICS:
        if m != RATE and m in scored.columns:
            sums += [F.sum(F.col(m).cast("double")).alias(f"sum_{m}"), F.count(m).alias(f"n_{m}")]
    return scored.groupBy("prompt_type").agg(*sums)


def summary_of(state: DataFrame) -> DataFrame:
    """Overall (null prompt type) and per-type means, as ``eval_summary`` gives them."""
    values = []
    for m in EVAL_METRICS:
        if m == RATE:
            values.append((F.sum("n_success") / F.sum("n_rows")).alias(m))
        elif f"n_{m}" in state.columns:
            values.append(F.when(F.sum(f"n_{m}") > 0, F.sum(f"sum_{m}") / F.sum(f"n_{m}")).alias(m))
        else:
            values.append(F.lit(None).cast("double").alias(m))
    wide = state.groupingSets([[], ["prompt_type"]], "prompt_type").agg(*values)
    return wide.unpivot(["prompt_type"], list(EVAL_METRICS), "metric", "value")


def follow_evaluation(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    score: Callable[[DataFrame], DataFrame],
    target: str,
    checkpoint: str,
    source_format: str = "parquet",
    files_per_trigger: int = 1000,
    after_batch: Callable[[int], None] | None = None,
) -> StreamingQuery:
    """Score the predictions in every file not seen before and save the sums so far below ``target``.

    Stops when the files present at the start are done. ``checkpoint`` must stay with ``target``. ``after_batch`` is called
    with the number of each saved batch.
    """

    def save(state: DataFrame, batch: int) -> None:
        state.write.mode("overwrite").parquet(f"{target}/batch={batch}")
        if after_batch:
            after_batch(batch)

    rows = spark.readStream.schema(schema).format(source_format).option("maxFilesPerTrigger", files_per_trigger).load(source)
    sums = eval_state(score(rows)).writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
    return sums.trigger(availableNow=True).foreachBatch(save).start()


def followed_summary(spark: SparkSession, target: str) -> DataFrame:
    """The summary after the latest batch that was saved as a whole."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    listed = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(place)
    batches = [int(s.getPath().getName().removeprefix("batch=")) for s in listed if s.getPath().getName().startswith("batch=")]
    for batch in sorted(batches, reverse=True):
        if exists(spark, f"{target}/batch={batch}/_SUCCESS"):
            return summary_of(spark.read.parquet(f"{target}/batch={batch}"))
    raise FileNotFoundError(f"{target} holds no saved batch")
