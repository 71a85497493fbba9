"""Comparison of evaluated models by prompt type."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefmill.operators.evaluation import EVAL_METRICS

# Model kinds in report order, default metrics and prompt types of the comparison.
MODEL_TYPES = ("base", "fine-tuned")
COMPARED_METRICS = tuple(m for m in EVAL_METRICS if m != "pep8_compliance")
COMPARED_PROMPT_TYPES = ("default", "code_form", "code_form_types")


def join_registry(df: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """Rows of registered runs or models with their display name (and type).

    No broadcast is forced: Spark broadcasts the registry while it is under its size limit.
    """
    return df.join(registry, key, "inner")


def summary_rows(summaries: DataFrame, keep: Sequence[str] = ("model", "type")) -> DataFrame:
    """Long form of evaluation summaries (:data:`prefmill.schemas.EVAL_SUMMARY` plus ``keep``).

    Overall metrics get a null prompt type.
    """
    by_type = summaries.select(*keep, F.explode("prompt_type_metrics").alias("prompt_type", "m"))
    whole = summaries.select(*keep, F.lit(None).cast("string").alias("prompt_type"), F.col("metrics").alias("m"))
    both = whole.unionByName(by_type)
    return both.select(*keep, "prompt_type", F.explode("m").alias("metric", "value"))


def valid_metrics(
    rows: DataFrame,
    metrics: Sequence[str] = COMPARED_METRICS,
    prompt_types: Sequence[str] = COMPARED_PROMPT_TYPES,
) -> DataFrame:
    """Metrics that have a value for some model and wanted prompt type."""
    wanted = rows.filter(F.col("metric").isin(*metrics) & F.col("prompt_type").isin(*prompt_types))
    return wanted.groupBy("metric").agg(F.count("value").alias("n_values")).filter("n_values > 0")


def model_comparison(
    rows: DataFrame,
    metrics: Sequence[str] = COMPARED_METRICS,
    prompt_types: Sequence[str] = COMPARED_PROMPT_TYPES,
) -> DataFrame:
    """Value per metric, prompt type and model, with the mean of the base models and the change to it.

    ``type_rank`` puts base models before fine-tuned ones. A metric without any value leaves no row.
    """
    wanted = rows.filter(
        F.col("metric").isin(*metrics) & F.col("prompt_type").isin(*prompt_types) & F.col("value").isNotNull()
    )
    is_base = F.col("type") == MODEL_TYPES[0]
    # A group has one row per model, so the base mean comes from a window and the rows are made once.
    base = F.avg(F.when(is_base, F.col("value"))).over(Window.partitionBy("metric", "prompt_type"))
    return (
        wanted.withColumn("type_rank", F.when(is_base, F.lit(0)).otherwise(F.lit(1)))
        .withColumn("base_value", base)
        .withColumn("delta", F.when(F.col("type") != MODEL_TYPES[0], F.col("value") - F.col("base_value")))
        .select("metric", "prompt_type", "model", "type", "type_rank", "value", "base_value", "delta")
    )


def metrics_wide_by_model(rows: DataFrame, models: Sequence[str]) -> DataFrame:
    """One row per metric and prompt type, one column per named model."""
    return rows.groupBy("metric", "prompt_type").pivot("model", list(models)).agg(F.first("value", ignorenulls=True))
