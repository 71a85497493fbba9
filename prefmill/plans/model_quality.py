"""Evaluation of a model's generations, and comparison of evaluated models."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from prefmill.operators.batch import Loader, generate_batch
from prefmill.operators.compare import COMPARED_METRICS, COMPARED_PROMPT_TYPES, model_comparison, summary_rows
from prefmill.operators.evaluation import (
    drop_null_prompt,
    eval_summary,
    join_predictions,
    no_code_rows,
    prepare_prompts,
    score_predictions,
    with_similarities,
)
from prefmill.operators.selection import first_n
from prefmill.sources.readers import read_eval_results
from prefmill.sources.writers import write_eval_results


def generate_predictions(
    spark: SparkSession, examples: DataFrame, loader: Loader, out: str, key: str = "example_id", boost: bool = False
) -> DataFrame:
    """Write and return the generated text of every example that has a prompt."""
    prompts = drop_null_prompt(prepare_prompts(examples, boost)).select(key, "prompt_text")
    path = f"{out}/predictions"
    generate_batch(prompts, "prompt_text", loader, "generated_text").select(key, "generated_text", "error").write.parquet(path)
    return spark.read.parquet(path)


def evaluate(
    spark: SparkSession,
    examples: DataFrame,
    predictions: DataFrame,
    out: str,
    key: str = "example_id",
    num_examples: int | None = None,
    embedder: Loader | None = None,
) -> dict[str, DataFrame]:
    """Write per-example scores and the summary below ``out``.

    Execution outcomes and similarities are used when ``predictions`` brings them (``exec_success``,
    ``similarity_to_*``); with an ``embedder`` the similarities come from its vectors."""
    if num_examples:
        examples = first_n(examples, num_examples, [key])
    joined = join_predictions(prepare_prompts(examples), predictions, key)
    results_path = f"{out}/results"
    rows = score_predictions(joined)
    (with_similarities(rows, embedder) if embedder else rows).write.parquet(results_path)
    scored = spark.read.parquet(results_path)
    summary = eval_summary(scored)
    write_eval_results(None, summary, out)
    return {"results": scored, "summary": summary, "fails": no_code_rows(scored)}


def compare_models(
    spark: SparkSession,
    paths: Mapping[str, tuple[str, str]],
    metrics=COMPARED_METRICS,
    prompt_types=COMPARED_PROMPT_TYPES,
) -> DataFrame:
    """Comparison rows of saved summaries; ``paths`` maps a summary to (model, type)."""
    return model_comparison(summary_rows(read_eval_results(spark, paths)), metrics, prompt_types)
