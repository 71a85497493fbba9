"""Evaluation of generated code against chosen and rejected answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefmill.functions.codescore import CODE_METRICS
from prefmill.functions.messages import unwrap_content
from prefmill.functions.vectors import cosine_similarity
from prefmill.operators.batch import Loader, embed_columns
from prefmill.operators.prompts import prompt_boost
from prefmill.operators.quality import with_code_blocks

# The type of rows without a prompt type and the metrics of a summary, in report order.
DEFAULT_PROMPT_TYPE = "default"
EVAL_METRICS = (
    "type_annotation_coverage",
    "comment_density",
    "docstring_coverage",
    "code_complexity",
    "pep8_compliance",
    "execution_success_rate",
    "similarity_to_chosen",
    "similarity_to_rejected",
)


def prepare_prompts(examples: DataFrame, boost: bool = False) -> DataFrame:
    """Add ``prompt_text`` (null when the row has no prompt) and a prompt type for every row."""
    text = unwrap_content(examples, "prompt")
    shown = F.when(F.col("prompt").isNotNull() & (text != ""), prompt_boost(text, boost))
    kind = F.col("prompt_type") if "prompt_type" in examples.columns else F.lit(None).cast("string")
    named = F.when(kind != "", kind).otherwise(F.lit(DEFAULT_PROMPT_TYPE))
    return examples.withColumns({"prompt_text": shown, "prompt_type": named})


def drop_null_prompt(prepared: DataFrame) -> DataFrame:
    """Rows that can be sent to a model. The others still count in the summaries."""
    return prepared.filter(F.col("prompt_text").isNotNull())


def join_predictions(examples: DataFrame, predictions: DataFrame, key: str = "example_id") -> DataFrame:
    """Examples with their generated text; every example stays, generated or not.

    Both sides are unique by key, so the join spreads evenly.
    """
    return examples.join(predictions, key, "left")


def block_mean(block_metrics: Column, metric: str) -> Column:
    """Mean of one metric over the blocks of a row, nulls left out; null without any value."""
    values = F.array_compact(F.transform(block_metrics, lambda m: m.getField(metric)))
    total = F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(values) > 0, total / F.size(values))


def score_predictions(joined: DataFrame, generated: str = "generated_text", level: int = 2) -> DataFrame:
    """Add the code blocks of the generated text, their metrics and the row means.

    ``exec_success`` (boolean) and the similarities, where the table has them, are kept only for rows
    with code. Rows without code stay, with ``has_code`` false.
    """
    out = with_code_blocks(joined, F.col(generated), level=level)
    out = out.withColumn("has_code", F.coalesce(F.size("blocks") > 0, F.lit(False)))
    out = out.withColumns({m: block_mean(F.col("block_metrics"), m) for m in CODE_METRICS})
    present = [c for c in ("exec_success", "similarity_to_chosen", "similarity_to_rejected") if c in joined.columns]
    return out.withColumns({c: F.when(F.col("has_code"), F.col(c)) for c in present})


def no_code_rows(scored: DataFrame, generated: str = "generated_text") -> DataFrame:
    """Generated texts without usable code, for the list of fails."""
    return scored.filter(F.col(generated).isNotNull() & ~F.col("has_code"))


def embedding_similarities(
    df: DataFrame, generated: str = "generated_vector", chosen: str = "chosen_vector", rejected: str = "rejected_vector"
) -> DataFrame:
    """Add the similarity of the generated code to both answers, from given vectors."""
    return df.withColumns(
        {
            "similarity_to_chosen": cosine_similarity(F.col(generated), F.col(chosen)),
            "similarity_to_rejected": cosine_similarity(F.col(generated), F.col(rejected)),
        }
    )


def with_similarities(scored: DataFrame, loader: Loader, generated: str = "generated_text") -> DataFrame:
    """Scored rows with the similarity of the generated text to both answers, by a user's embedder.

    Rows without code, and sides that are missing or empty, have no similarity.
    """
    answers = {f"_{side}": unwrap_content(scored, side) for side in ("chosen", "rejected")}
    texts = {"_generated": F.col(generated)} | answers
    texts = {name: F.when(F.col("has_code") & (text != ""), text) for name, text in texts.items()}
    vectors = {name: f"{name}_vector" for name in texts}
    bare = scored.drop("similarity_to_chosen", "similarity_to_rejected")
    embedded = embed_columns(bare.withColumns(texts), vectors, loader)
    return embedding_similarities(embedded, *vectors.values()).drop(*texts, *vectors.values())


def exec_rate(success: Column) -> Column:
    """Successful runs over all rows of the group, whether they ran or not."""
    return F.count_if(success) / F.count("*")


def exec_rollup(df: DataFrame, success: str = "exec_success", by: Sequence[str] = ()) -> DataFrame:
    """Rows, successes and success rate of execution outcomes."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col(success)).alias("n_success"),
        exec_rate(F.col(success)).alias("execution_success_rate"),
    )


def _summary_aggregates(scored: DataFrame) -> list[Column]:
    source = {m: m for m in EVAL_METRICS} | {"execution_success_rate": "exec_success"}
    aggregates = []
    for metric in EVAL_METRICS:
        if source[metric] not in scored.columns:
            aggregates.append(F.lit(None).cast("double").alias(metric))
        elif metric == "execution_success_rate":
            aggregates.append(exec_rate(F.col(source[metric])).alias(metric))
        else:
            aggregates.append(F.avg(source[metric]).alias(metric))
    return aggregates


def _to_rows(wide: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return wide.unpivot(list(keep), list(EVAL_METRICS), "metric", "value")


def eval_overall(scored: DataFrame) -> DataFrame:
    """Summary over all rows: means of row means, and success rate over every selected row."""
    return _to_rows(scored.agg(*_summary_aggregates(scored)))


def eval_by_group(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """The same per group."""
    return _to_rows(scored.groupBy(*by).agg(*_summary_aggregates(scored)), by)


def eval_by_prompt_type(scored: DataFrame) -> DataFrame:
    """The same per prompt type; rows without prompt or code count for their type."""
    return eval_by_group(scored, ["prompt_type"])


def eval_summary(scored: DataFrame) -> DataFrame:
    """Overall (null prompt type) and per-type summary from one pass over the rows."""
    grouped = scored.groupingSets([[], ["prompt_type"]], "prompt_type").agg(*_summary_aggregates(scored))
    return _to_rows(grouped, ["prompt_type"])


def similarity_mean(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean similarity to chosen and rejected."""
    names = ("similarity_to_chosen", "similarity_to_rejected")
    return df.groupBy(*by).agg(*[F.avg(n).alias(n) for n in names])
