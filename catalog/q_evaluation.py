"""Evaluation of generated text."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from catalog.inputs import view
from catalog.registry import query, rounded
from prefmill.functions.codescore import CODE_METRICS
from prefmill.operators import evaluation as E
from prefmill.session import scratch_path
from prefmill.streaming.evaluation import follow_evaluation, followed_summary

MEANS = ", ".join(f"round({m}, 6) AS {m}" for m in CODE_METRICS)


def predictions(spark, sf_dir):
    return view(spark, sf_dir, "fx_predictions").select("example_id", "prompt_type", "domain", "generated_text", "exec_success")


def scored(spark, sf_dir):
    return E.score_predictions(predictions(spark, sf_dir))


@query(
    "join_predictions",
    "SELECT example_id, task, prompt_text, chosen_code, rejected_code, generated_text, exec_success FROM fx_predictions",
    ("fx_predictions",),
)
def join_predictions(spark, sf_dir):
    examples = view(spark, sf_dir, "fx_code").selectExpr("k AS example_id", "task", "prompt_text", "chosen_code", "rejected_code")
    generated = view(spark, sf_dir, "fx_predictions").select("example_id", "generated_text", "exec_success")
    return E.join_predictions(examples, generated)


@query(
    "no_code_rows",
    "SELECT example_id, generated_text FROM fx_predictions WHERE example_id % 7 = 0",
    ("fx_predictions",),
)
def no_code_rows(spark, sf_dir):
    return E.no_code_rows(scored(spark, sf_dir)).select("example_id", "generated_text")


@query(
    "score_predictions",
    f"SELECT example_id, has_code, CAST(CASE WHEN has_code THEN blocks ELSE 0 END AS INT) AS n_blocks, {MEANS}, exec_success FROM fx_row_means",
    ("fx_row_means",),
)
def score_predictions(spark, sf_dir):
    rows = scored(spark, sf_dir)
    return rows.select("example_id", "has_code", F.size("blocks").alias("n_blocks"), *rounded(*CODE_METRICS), "exec_success")


@query("block_mean", f"SELECT example_id, {MEANS} FROM fx_row_means", ("fx_row_means",))
def block_mean(spark, sf_dir):
    rows = scored(spark, sf_dir)
    means = rows.select("example_id", *[E.block_mean(F.col("block_metrics"), m).alias(m) for m in CODE_METRICS])
    return means.select("example_id", *rounded(*CODE_METRICS))


def summary_sql(keep: str = "", group: str = "") -> str:
    def part(metric: str) -> str:
        if metric == "execution_success_rate":
            value = "CAST(count(*) FILTER (WHERE exec_success) AS DOUBLE) / count(*)"
        elif metric.startswith("similarity"):
            value = "max(CAST(NULL AS DOUBLE))"
        else:
            value = f"avg({metric})"
        return f"SELECT {keep}'{metric}' AS metric, round({value}, 6) AS value FROM fx_row_means {group}"

    return "\nUNION ALL ".join(part(m) for m in E.EVAL_METRICS)


@query("eval_overall", summary_sql(), ("fx_row_means",))
def eval_overall(spark, sf_dir):
    return E.eval_overall(scored(spark, sf_dir)).select("metric", *rounded("value"))


@query("eval_by_prompt_type", summary_sql("prompt_type, ", "GROUP BY prompt_type"), ("fx_row_means",))
def eval_by_prompt_type(spark, sf_dir):
    return E.eval_by_prompt_type(scored(spark, sf_dir)).select("prompt_type", "metric", *rounded("value"))


@query(
    "stream_evaluation",
    summary_sql("prompt_type, ", "GROUP BY prompt_type") + "\nUNION ALL " + summary_sql("CAST(NULL AS VARCHAR) AS prompt_type, "),
    ("fx_row_means",),
)
def stream_evaluation(spark, sf_dir):
    source, target, checkpoint = (scratch_path(spark, f"evaluated-{n}") for n in ("in", "out", "checkpoint"))
    scored(spark, sf_dir).repartition(6).write.parquet(source)
    schema = spark.read.parquet(source).schema
    follow_evaluation(spark, source, schema, lambda rows: rows, target, checkpoint, files_per_trigger=2).awaitTermination()
    return followed_summary(spark, target).select("prompt_type", "metric", *rounded("value"))


@query(
    "eval_summary",
    summary_sql("prompt_type, ", "GROUP BY prompt_type") + "\nUNION ALL " + summary_sql("CAST(NULL AS VARCHAR) AS prompt_type, "),
    ("fx_row_means",),
)
def eval_summary(spark, sf_dir):
    return E.eval_summary(scored(spark, sf_dir)).select("prompt_type", "metric", *rounded("value"))


@query(
    "exec_rollup",
    """
SELECT prompt_type, count(*) AS n_rows, count(*) FILTER (WHERE exec_success) AS n_success,
       round(CAST(count(*) FILTER (WHERE exec_success) AS DOUBLE) / count(*), 6) AS execution_success_rate
FROM fx_predictions GROUP BY prompt_type""",
    ("fx_predictions",),
)
def exec_rollup(spark, sf_dir):
    rows = E.exec_rollup(predictions(spark, sf_dir), by=["prompt_type"])
    return rows.select("prompt_type", "n_rows", "n_success", *rounded("execution_success_rate"))


def letter_counts():
    """An embedder whose vectors SQL can repeat: length, letters e, line feeds."""
    return lambda texts: [[float(len(t)), float(t.count("e")), float(t.count("\n"))] for t in texts]


def _vector(column: str) -> str:
    return f"[length({column})::DOUBLE, (length({column}) - length(replace({column}, 'e', '')))::DOUBLE, (length({column}) - length(replace({column}, chr(10), '')))::DOUBLE]"


def _similarity(metric: str) -> str:
    side = metric.removeprefix("similarity_to_")
    return (
        f"SELECT prompt_type, '{metric}' AS metric, round(avg(list_cosine_similarity({_vector('generated_text')}, {_vector(side + '_code')})) "
        "FILTER (WHERE example_id % 7 <> 0), 6) AS value FROM fx_predictions GROUP BY prompt_type"
    )


@query(
    "eval_by_prompt_type_similarity",
    f"SELECT * FROM ({summary_sql('prompt_type, ', 'GROUP BY prompt_type')}) s WHERE metric NOT LIKE 'similarity%'\nUNION ALL "
    + "\nUNION ALL ".join(_similarity(m) for m in E.EVAL_METRICS if m.startswith("similarity")),
    ("fx_row_means",),
)
def eval_by_prompt_type_similarity(spark, sf_dir):
    answers = view(spark, sf_dir, "fx_predictions").select(
        "example_id", "prompt_type", "generated_text", "exec_success", F.col("chosen_code").alias("chosen"), F.col("rejected_code").alias("rejected")
    )
    rows = E.with_similarities(E.score_predictions(answers), letter_counts)
    return E.eval_by_prompt_type(rows).select("prompt_type", "metric", *rounded("value"))


# The workers get the embedder by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
