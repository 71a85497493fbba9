"""Model comparison: the generations of each domain stand for one model."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.inputs import table, view
from catalog.q_evaluation import scored, summary_sql
from catalog.registry import query, rounded
from prefmill.operators import compare as M
from prefmill.operators.evaluation import eval_by_group

MODELS = """
, models AS (SELECT DISTINCT domain AS model, CASE WHEN domain < 'M' THEN 'base' ELSE 'fine-tuned' END AS type FROM fx_code),
summary AS ({summary}),
wanted AS (SELECT * FROM summary JOIN models USING (model) WHERE metric <> 'pep8_compliance' AND value IS NOT NULL)"""


def models_sql(body: str) -> str:
    summary = summary_sql("domain AS model, prompt_type, ", "GROUP BY domain, prompt_type")
    return f"{MODELS.strip().replace('{summary}', summary)}\n{body.strip()}"


def rows(spark, sf_dir):
    """Summary values per model, with the model's type joined from a registry."""
    values = eval_by_group(scored(spark, sf_dir), ["domain", "prompt_type"]).withColumnRenamed("domain", "model")
    registry = view(spark, sf_dir, "fx_code").select(F.col("domain").alias("model")).distinct()
    registry = registry.withColumn("type", F.when(F.col("model") < "M", "base").otherwise("fine-tuned"))
    return M.join_registry(values, registry, "model")


@query(
    "join_registry",
    models_sql("SELECT model, type, prompt_type, metric, round(value, 6) AS value FROM summary JOIN models USING (model)"),
    ("fx_row_means",),
)
def join_registry(spark, sf_dir):
    return rows(spark, sf_dir).select("model", "type", "prompt_type", "metric", *rounded("value"))


@query("valid_metrics", models_sql("SELECT metric, count(*) AS n_values FROM wanted GROUP BY metric"), ("fx_row_means",))
def valid_metrics(spark, sf_dir):
    return M.valid_metrics(rows(spark, sf_dir))


@query(
    "model_comparison",
    models_sql("""
SELECT metric, prompt_type, model, type, CAST(CASE WHEN type = 'base' THEN 0 ELSE 1 END AS INT) AS type_rank, round(value, 4) AS value,
       round(base_value, 4) AS base_value, CASE WHEN type <> 'base' THEN round(value - base_value, 4) END AS delta
FROM wanted LEFT JOIN (SELECT metric, prompt_type, avg(value) AS base_value FROM wanted WHERE type = 'base' GROUP BY ALL) b USING (metric, prompt_type)"""),
    ("fx_row_means",),
)
def model_comparison(spark, sf_dir):
    compared = M.model_comparison(rows(spark, sf_dir))
    return compared.select(
        "metric", "prompt_type", "model", "type", "type_rank", *rounded("value", "base_value", "delta", digits=4)
    )


NAMES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


@query(
    "metrics_wide_by_model",
    models_sql(
        "SELECT metric, prompt_type, "
        + ", ".join(f"round(max(value) FILTER (WHERE model = '{n}'), 6) AS {n.lower()}" for n in NAMES)
        + " FROM summary GROUP BY metric, prompt_type"
    ),
    ("fx_row_means",),
)
def metrics_wide_by_model(spark, sf_dir):
    wide = M.metrics_wide_by_model(rows(spark, sf_dir), NAMES)
    return wide.select("metric", "prompt_type", *[F.round(F.col(n), 6).alias(n.lower()) for n in NAMES])


@query(
    "model_comparison_documents",
    """
WITH rows AS (SELECT source AS model, CASE WHEN source < 'src2' THEN 'base' ELSE 'fine-tuned' END AS type, lang AS prompt_type,
                     avg(quality) AS value FROM documents JOIN labels USING (doc_id) GROUP BY ALL)
SELECT 'quality' AS metric, prompt_type, model, type, CAST(CASE WHEN type = 'base' THEN 0 ELSE 1 END AS INT) AS type_rank,
       round(value, 6) AS value, round(base_value, 6) AS base_value, CASE WHEN type <> 'base' THEN round(value - base_value, 6) END AS delta
FROM rows LEFT JOIN (SELECT prompt_type, avg(value) AS base_value FROM rows WHERE type = 'base' GROUP BY ALL) b USING (prompt_type)
WHERE prompt_type IN ('de', 'en', 'es', 'fr') AND value IS NOT NULL""",
)
def model_comparison_documents(spark, sf_dir):
    labelled = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    kind = F.when(F.col("source") < "src2", "base").otherwise("fine-tuned")
    values = (
        labelled.groupBy(F.col("source").alias("model"), kind.alias("type"), F.col("lang").alias("prompt_type"))
        .agg(F.avg("quality").alias("value"))
        .withColumn("metric", F.lit("quality"))
    )
    compared = M.model_comparison(values, ["quality"], ["de", "en", "es", "fr"])
    return compared.select("metric", "prompt_type", "model", "type", "type_rank", *rounded("value", "base_value", "delta"))
