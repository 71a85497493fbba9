"""Quality of chosen against rejected code, overall and by category."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.inputs import table, view
from catalog.registry import query, rounded
from prefmill.functions.messages import as_messages
from prefmill.operators import quality as Q
from prefmill.operators import sketches
from prefmill.operators.quantiles import box_summary, exact_quantiles
from prefmill.session import scratch_path

EXECUTIONS = """
, truth AS (
  SELECT k, domain, task, code_form, side, metric, CAST(value AS DOUBLE) AS value FROM fx_truth
  UNION ALL SELECT k, domain, task, code_form, 'chosen', 'execution_result', CASE WHEN k % 23 = 0 THEN NULL WHEN k % 2 = 0 THEN 1.0 ELSE 0.0 END FROM fx_code
  UNION ALL SELECT k, domain, task, code_form, 'rejected', 'execution_result', CASE WHEN k % 3 = 0 THEN 1.0 ELSE 0.0 END FROM fx_code WHERE k % 11 <> 0)"""


def truth_sql(body: str) -> str:
    return f"{EXECUTIONS.strip()}\n{body.strip()}"


def pairs(spark, sf_dir):
    """Snippets as pairs, with execution outcomes given as columns."""
    return view(spark, sf_dir, "fx_code").select(
        "k",
        "domain",
        "task",
        "code_form",
        as_messages("user", F.col("prompt_text")).alias("prompt"),
        as_messages("assistant", F.col("chosen_code")).alias("chosen"),
        as_messages("assistant", F.col("rejected_code")).alias("rejected"),
        F.expr("named_struct('success', CASE WHEN k % 23 = 0 THEN NULL ELSE k % 2 = 0 END, 'output', '', 'error', '')").alias("chosen_execution"),
        F.expr("named_struct('success', k % 3 = 0, 'output', '', 'error', '')").alias("rejected_execution"),
    )


def scored(spark, sf_dir):
    return Q.score_pairs(pairs(spark, sf_dir))


@query(
    "score_pairs",
    truth_sql("SELECT k, domain, side, metric, round(value, 6) AS value FROM truth WHERE value IS NOT NULL"),
    ("fx_truth",),
)
def score_pairs(spark, sf_dir):
    rows = Q.metrics_long(scored(spark, sf_dir), ["k", "domain"])
    return rows.select("k", "domain", "side", "metric", *rounded("value"))


@query(
    "metrics_long",
    truth_sql("SELECT side, metric, count(value) AS n, round(sum(value), 4) AS total FROM truth GROUP BY ALL"),
    ("fx_truth",),
)
def metrics_long(spark, sf_dir):
    rows = Q.metrics_long(scored(spark, sf_dir)).groupBy("side", "metric")
    return rows.agg(F.count("value").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(
    "drop_null_metric",
    truth_sql("SELECT k, count(value) AS n_values FROM truth GROUP BY k"),
    ("fx_truth",),
)
def drop_null_metric(spark, sf_dir):
    return Q.metrics_long(scored(spark, sf_dir), ["k"]).groupBy("k").agg(F.count("*").alias("n_values"))


@query(
    "result_meta",
    "SELECT k, domain, task, code_form, prompt_text AS prompt, chosen_code, rejected_code FROM fx_code",
    ("fx_code",),
)
def result_meta(spark, sf_dir):
    return scored(spark, sf_dir).drop("chosen_metrics", "rejected_metrics")


@query(
    "category_columns",
    "SELECT 'domain' AS category, count(DISTINCT domain) AS n_values FROM fx_code "
    "UNION ALL SELECT 'task', count(DISTINCT task) FROM fx_code UNION ALL SELECT 'code_form', count(DISTINCT code_form) FROM fx_code",
    ("fx_code",),
)
def category_columns(spark, sf_dir):
    rows = scored(spark, sf_dir)
    names = Q.category_columns(rows, exclude=["k"])
    wide = rows.agg(*[F.count_distinct(n).alias(n) for n in names])
    return wide.unpivot([], names, "category", "n_values")


@query(
    "exec_to_int",
    "SELECT example_id, CAST(CASE WHEN exec_success THEN 1 WHEN NOT exec_success THEN 0 END AS INT) AS success FROM fx_predictions",
    ("fx_predictions",),
)
def exec_to_int(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_predictions").select("example_id", F.struct(F.col("exec_success").alias("success")).alias("e"))
    return rows.select("example_id", Q.exec_to_int(F.col("e")).alias("success"))


@query(
    "side_means",
    truth_sql("SELECT metric, side, round(avg(value), 6) AS mean, count(value) AS n FROM truth GROUP BY ALL"),
    ("fx_truth",),
)
def side_means(spark, sf_dir):
    return Q.side_means(scored(spark, sf_dir)).select("metric", "side", *rounded("mean"), "n")


CATEGORIES = ("domain", "task", "code_form")


def per_category(select: str) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{c}' AS category, {c} AS category_value, metric, side, {select} FROM truth WHERE value IS NOT NULL "
        f"AND ({c}, metric) IN (SELECT ({c}, metric) FROM truth WHERE value IS NOT NULL GROUP BY {c}, metric HAVING count(DISTINCT side) = 2) "
        f"GROUP BY {c}, metric, side"
        for c in CATEGORIES
    )


@query("category_means", truth_sql(per_category("round(avg(value), 6) AS mean, count(value) AS n")), ("fx_truth",))
def category_means(spark, sf_dir):
    rows = Q.category_means(scored(spark, sf_dir), CATEGORIES)
    return rows.select("category", "category_value", "metric", "side", *rounded("mean"), "n")


def box_sql(by: str, source: str) -> str:
    """Box summary of the column ``value`` of a source by grouping columns."""
    return f"""
SELECT {by}, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       round(min(value) FILTER (WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_low,
       round(max(value) FILTER (WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
       count(*) AS n_values
FROM (SELECT {by}, value, quantile_cont(value, 0.25) OVER w AS q1, quantile_cont(value, 0.5) OVER w AS median,
             quantile_cont(value, 0.75) OVER w AS q3 FROM {source} WHERE value IS NOT NULL WINDOW w AS (PARTITION BY {by})) t
GROUP BY {by}, q1, median, q3"""


BOX = ("q1", "median", "q3", "whisker_low", "whisker_high")


@query("side_box", truth_sql(box_sql("metric, side", "truth")), ("fx_truth",))
def side_box(spark, sf_dir):
    return Q.side_box(scored(spark, sf_dir)).select("metric", "side", *rounded(*BOX), "n_values")


@query(
    "category_box",
    truth_sql(
        ", tall AS ("
        + " UNION ALL ".join(f"SELECT '{c}' AS category, {c} AS category_value, metric, side, value FROM truth" for c in CATEGORIES)
        + ")"
        + box_sql("category, category_value, metric, side", "tall")
        + " QUALIFY count(*) OVER (PARTITION BY category, category_value, metric) = 2"
    ),
    ("fx_truth",),
)
def category_box(spark, sf_dir):
    rows = Q.category_box(scored(spark, sf_dir), CATEGORIES)
    return rows.select("category", "category_value", "metric", "side", *rounded(*BOX), "n_values")


@query(
    "value_quantiles",
    """
SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.01), 4) AS p01, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50,
       round(quantile_cont(l_extendedprice, 0.999), 4) AS p999 FROM lineitem GROUP BY ALL""",
)
def value_quantiles(spark, sf_dir):
    by = ["l_returnflag", "l_linestatus"]
    rows = exact_quantiles(table(spark, sf_dir, "lineitem"), by, "l_extendedprice", {"p01": 0.01, "p50": 0.5, "p999": 0.999})
    return rows.select(*by, *rounded("p01", "p50", "p999", digits=4))


@query(
    "value_quantiles_state",
    """
SELECT l_returnflag, count(*) AS n_rows, round(quantile_cont(l_extendedprice, 0.01), 4) AS p01, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50,
       round(quantile_cont(l_extendedprice, 0.999), 4) AS p999, true AS near FROM lineitem GROUP BY ALL""",
)
def value_quantiles_state(spark, sf_dir):
    path, by, probs = scratch_path(spark, "quantiles"), ["l_returnflag"], {"p01": 0.01, "p50": 0.5, "p999": 0.999}
    rows = table(spark, sf_dir, "lineitem").withColumn("value", F.col("l_extendedprice").cast("double"))
    for some in (rows.filter("l_linenumber < 4"), rows):
        sketches.extend_quantiles(spark, some, path, "l_linenumber", by, "value")
    state = spark.read.parquet(path)
    exact = sketches.exact_from_state(rows, state, by, "value", probs)
    # The state's own estimate lies between the exact values one rank error to each side.
    error = sketches.rank_error()
    ends = {f"{n}_{side}": min(1.0, max(0.0, p + sign * error)) for n, p in probs.items() for side, sign in (("low", -1), ("high", 1))}
    around = sketches.exact_from_state(rows, state, by, "value", ends)
    estimated = sketches.quantiles_from_state(state, by, probs).select(*by, "n_rows", *[F.col(n).alias(f"about_{n}") for n in probs])
    near = F.lit(True)
    for n in probs:
        near = near & F.col(f"about_{n}").between(F.col(f"{n}_low"), F.col(f"{n}_high"))
    return exact.join(estimated, by).join(around, by).select(*by, "n_rows", *rounded(*probs, digits=4), near.alias("near"))


@query(
    "dataset_card_state",
    """
SELECT l_returnflag, count(*) AS n_rows, true AS orders_near, true AS parts_near FROM lineitem GROUP BY ALL""",
)
def dataset_card_state(spark, sf_dir):
    path, by, columns = scratch_path(spark, "card"), ["l_returnflag"], ("l_orderkey", "l_partkey")
    rows = table(spark, sf_dir, "lineitem")
    for some in (rows.filter("l_linenumber < 4"), rows):
        sketches.extend_card(spark, some, path, "l_linenumber", by, columns)
    card = sketches.card_from_state(spark.read.parquet(path), by, columns)
    exact = rows.groupBy(*by).agg(*[F.count_distinct(c).alias(f"exact_{c}") for c in columns])
    near = {c: F.abs(F.col(f"n_{c}s") - F.col(f"exact_{c}")) <= sketches.distinct_error() * F.col(f"exact_{c}") for c in columns}
    return card.join(exact, by).select(*by, "n_rows", near["l_orderkey"].alias("orders_near"), near["l_partkey"].alias("parts_near"))


@query("value_box", box_sql("l_returnflag", "(SELECT l_returnflag, l_extendedprice AS value FROM lineitem) s").strip())
def value_box(spark, sf_dir):
    boxes = box_summary(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return boxes.select("l_returnflag", *rounded(*BOX), "n_values")


LABELLED = "SELECT source, CASE WHEN quality = 1 THEN 'chosen' ELSE 'rejected' END AS side, n_chars FROM documents JOIN labels USING (doc_id)"


@query(
    "both_sides_only",
    f"""
WITH s AS (SELECT source, side, round(avg(n_chars), 6) AS mean FROM ({LABELLED}) t GROUP BY ALL)
SELECT source, side, mean FROM s WHERE source IN (SELECT source FROM s GROUP BY source HAVING count(*) = 2)""",
)
def both_sides_only(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    side = F.when(F.col("quality") == 1, "chosen").otherwise("rejected").alias("side")
    means = rows.groupBy("source", side).agg(F.round(F.avg("n_chars"), 6).alias("mean"))
    return Q.both_sides_only(means, ["source"])
