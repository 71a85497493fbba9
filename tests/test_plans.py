"""Shapes of physical plans: what is scanned, shuffled and sent to Python."""

import re

import pytest
from pyspark.sql import functions as F

from prefmill.functions.codescore import score_code
from prefmill.functions.text import token_count
from prefmill.operators import lengths, quality, quantiles, selection, series
from prefmill.operators.pairs import build_pairs, dataset_card
from prefmill.operators.responses import drop_errors, parse_responses
from prefmill.session import scratch_path
from prefmill.sources import readers, writers

RESPONSES = "id long, domain string, task string, code_form string, first_content string, second_content string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def count(df, node):
    return len(re.findall(rf"\b{node}\b", plan(df)))


@pytest.fixture(scope="module")
def responses(spark):
    path = scratch_path(spark, "responses")
    rows = [(i, "d", "t", "f", '{"examples":[]}', '{"improved_examples":[]}') for i in range(20)]
    spark.createDataFrame(rows, RESPONSES).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def pairs(spark):
    path = scratch_path(spark, "pairs")
    spark.range(50).selectExpr(
        "id AS k", "'p' AS prompt", "'x = 1' AS chosen", "'y' AS rejected", "CAST(id % 3 AS STRING) AS domain", "'unused' AS extra"
    ).write.parquet(path)
    return spark.read.parquet(path)


def test_pairs_are_built_without_a_shuffle(responses):
    assert count(build_pairs(parse_responses(responses)), "Exchange") == 0


def test_each_response_is_parsed_once(responses):
    """The filter on the outcome does not repeat the parse below itself."""
    for df in (drop_errors(parse_responses(responses)), build_pairs(parse_responses(responses))):
        assert plan(df).count("parseJson") == 2


def test_the_scan_reads_only_the_needed_columns(pairs):
    scan = plan(lengths.length_counts(lengths.token_lengths(pairs, ("prompt", "chosen")), ("prompt", "chosen")))
    assert "ReadSchema: struct<prompt:string,chosen:string>" in scan


def test_wanted_tags_reach_the_scan(spark):
    path = scratch_path(spark, "logs")
    spark.range(9).selectExpr("'r' AS run", "'f' AS event_file", "'train/loss' AS tag", "id AS step", "0.5D AS value").write.parquet(path)
    series_plan = plan(series.run_series(readers.read_scalar_logs(spark, path), sort=False))
    assert re.search(r"PushedFilters: \[.*In\(tag", series_plan)
    assert "Exchange" not in series_plan
    assert "Join" not in series_plan


def test_one_python_pass_per_scored_table(pairs):
    scored = quality.score_pairs(pairs.drop("k"))
    assert count(scored, "ArrowEvalPython") == 1
    assert count(quality.side_means(scored), "ArrowEvalPython") == 1
    assert count(quality.category_means(scored, ["domain"]), "ArrowEvalPython") == 1
    code = pairs.select(score_code(F.col("chosen")).alias("m")).select("m.*")
    assert count(code, "ArrowEvalPython") == 1


def test_boxes_shuffle_little(pairs):
    """The values are saved, so the parser is in none of these plans."""
    scored = quality.score_pairs(pairs.drop("k"))
    for df, most in ((quality.side_box(scored), 5), (quality.category_box(scored, ["domain"]), 6)):
        df.collect()
        final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "ArrowEvalPython" not in final
        assert len(re.findall(r"\bExchange\b", final)) <= most


def test_histogram_tokenises_once(pairs):
    df = lengths.length_histogram(lengths.length_counts(lengths.token_lengths(pairs)))
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # The scan is that of the scalar subquery; the histogram takes its shuffled counts.
    assert final.count("FileScan parquet") == 0
    assert "ReusedExchange" in final


def test_no_cross_join_anywhere(spark, pairs):
    counts = lengths.length_counts(lengths.token_lengths(pairs))
    scored = quality.score_pairs(pairs.drop("k"))
    for df in (lengths.length_histogram(counts), lengths.length_stats(counts), quality.side_box(scored), quality.category_box(scored, ["domain"])):
        assert "CartesianProduct" not in plan(df)
        assert "BroadcastNestedLoopJoin" not in plan(df)


def test_splits_and_counts_move_no_text(pairs):
    assert count(selection.train_test_split(pairs, ["k"]), "Exchange") == 0
    assert count(pairs.select(token_count(F.col("chosen"))), "Exchange") == 0
    card = plan(dataset_card(pairs.withColumn("task", F.col("domain")).withColumn("code_form", F.col("domain"))))
    assert "ReadSchema: struct<domain:string>" in card


def test_large_selections_stay_spread(spark):
    path = scratch_path(spark, "many")
    spark.range(0, 60_000, 1, 12).selectExpr("id AS k", "repeat('x', 50) AS t").write.parquet(path)
    many = spark.read.option("basePath", path).parquet(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        for part in (selection.first_n(many, 50_000, ["k"]), selection.sample_n(many, 50_000, ["k"])):
            filled = part.groupBy(F.spark_partition_id()).count().collect()
            assert sum(r["count"] for r in filled) == 50_000 and len(filled) > 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_comparison_scores_once(pairs):
    from prefmill.operators import compare, evaluation

    rows = evaluation.score_predictions(pairs.selectExpr("k AS example_id", "chosen AS generated_text", "domain", "'default' AS prompt_type"))
    values = evaluation.eval_by_group(rows, ["domain", "prompt_type"]).withColumnRenamed("domain", "model")
    compared = compare.model_comparison(values.withColumn("type", F.lit("base")))
    assert count(compared, "ArrowEvalPython") == 1
    assert count(compared, "FileScan") == 1


def test_a_split_reads_its_folder_only(spark, pairs):
    path = scratch_path(spark, "splits")
    writers.write_pairs(selection.train_test_split(pairs, ["k"], 0.5), path, ["split"])
    assert re.search(r"PartitionFilters: \[.*split.* = test", plan(readers.read_split(spark, path + ":test")))


def test_bucketed_tables_are_compared_without_a_shuffle(spark, pairs):
    writers.write_bucketed(pairs, "plan_pairs", ["k"], 4, "overwrite")
    writers.write_bucketed(pairs.filter("k < 20").select("k"), "plan_scored", ["k"], 4, "overwrite")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        todo = readers.unscored_only(spark.table("plan_pairs"), spark.table("plan_scored"), ["k"])
        assert count(todo, "Exchange") == 0
        assert todo.count() == 30
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_quantiles_of_one_large_group(spark):
    df = spark.range(20_000).selectExpr("'g' AS g", "CAST(id AS DOUBLE) AS x")
    quartiles = quantiles.exact_quantiles(df, ["g"], "x", quantiles.QUARTILES, 1000, 100)
    assert tuple(quartiles.first()) == ("g", 4999.75, 9999.5, 14999.25)
