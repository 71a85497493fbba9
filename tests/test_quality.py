import pytest
from pyspark.sql import functions as F

from prefmill.functions.vectors import cosine_similarity
from prefmill.operators import compare as M
from prefmill.operators import evaluation as E
from prefmill.operators import quality as Q

TYPED = "```python\ndef f(a: int) -> int:\n    return a\n```"
PLAIN = "def f(a):\n    return a"


@pytest.fixture(scope="module")
def scored(spark):
    rows = [
        (1, "d1", [("user", "p")], TYPED, PLAIN, (True,), (True,)),
        (2, "d1", [("user", "p")], TYPED, "no code here", (False,), (None,)),
        (3, "d2", [("user", "p")], TYPED, "def f(", (None,), (False,)),
        (4, None, None, None, PLAIN, None, (True,)),
        (5, "d1", [("user", "p")], "```\npip install x\n```\n```\nx = 1\n```", PLAIN, (True,), (True,)),
    ]
    schema = (
        "k int, domain string, prompt array<struct<role string, content string>>, chosen string, rejected string, "
        "chosen_execution struct<success boolean>, rejected_execution struct<success boolean>"
    )
    return Q.score_pairs(spark.createDataFrame(rows, schema)).cache()


def test_only_the_first_clean_block_is_scored(scored):
    rows = {r.k: r for r in scored.collect()}
    assert rows[1].chosen_metrics.type_annotation_coverage == 1.0
    assert rows[5].chosen_metrics.type_annotation_coverage == 0.0
    assert rows[5].chosen_metrics.code_complexity == 0.0


def test_rows_without_code_have_no_metrics_of_other_rows(scored):
    rows = {r.k: r for r in scored.collect()}
    assert rows[2].rejected_metrics is None
    assert rows[3].rejected_metrics is None
    assert rows[4].chosen_metrics is None
    assert rows[4].chosen_code is None


def test_unparsable_fenced_code_keeps_its_execution(spark):
    df = spark.createDataFrame([("```\ndef f(\n```", PLAIN, (False,))], "chosen string, rejected string, chosen_execution struct<success boolean>")
    row = Q.score_pairs(df).first()
    assert row.chosen_metrics.execution_result.success is False
    assert row.chosen_metrics.comment_density is None


def test_side_means_need_both_sides(scored):
    got = {(r.metric, r.side): (r.mean, r.n) for r in Q.side_means(scored).collect()}
    assert got["type_annotation_coverage", "chosen"] == (0.75, 4)
    assert got["type_annotation_coverage", "rejected"] == (0.0, 3)
    assert got["execution_result", "chosen"] == (pytest.approx(2 / 3), 3)


def test_category_means_leave_out_one_sided_values(scored):
    rows = Q.category_means(scored, ["domain"]).filter("metric = 'docstring_coverage'").collect()
    # d2 has no rejected value and the null domain has no chosen value
    assert {(r.category, r.category_value, r.side, r.n) for r in rows} == {("domain", "d1", "chosen", 3), ("domain", "d1", "rejected", 2)}


def test_boxes_follow_the_same_rule(scored):
    overall = {(r.metric, r.side): r for r in Q.side_box(scored).collect()}
    assert overall["type_annotation_coverage", "chosen"].median == 1.0
    assert overall["type_annotation_coverage", "chosen"].n_values == 4
    boxes = Q.category_box(scored, ["domain", "k"]).collect()
    assert {(r.category, r.category_value) for r in boxes if r.metric == "docstring_coverage"} == {("domain", "d1"), ("k", "1"), ("k", "5")}


def test_a_side_with_only_nulls_is_not_reported(spark):
    df = spark.createDataFrame([(TYPED, "def f(")], "chosen string, rejected string")
    assert Q.side_means(Q.score_pairs(df)).count() == 0


def test_schema_checks(spark, scored):
    with pytest.raises(ValueError, match="rejected"):
        Q.require_columns(spark.createDataFrame([("a",)], "chosen string"))
    assert Q.category_columns(scored, exclude=["k"]) == ["domain"]


def predictions(spark):
    rows = [
        (1, "default", TYPED + "\n" + "```\nx = 1\n```", True, 0.5),
        (2, "default", "```\ndef f(\n```", False, 0.7),
        (3, "code_form", "sorry, no code", True, 0.9),
        (4, "code_form", None, None, None),
    ]
    schema = "example_id int, prompt_type string, generated_text string, exec_success boolean, similarity_to_chosen double"
    return E.score_predictions(spark.createDataFrame(rows, schema))


def test_row_means_and_denominators(spark):
    scored = predictions(spark)
    rows = {r.example_id: r for r in scored.collect()}
    assert rows[1].type_annotation_coverage == 0.5
    assert rows[2].type_annotation_coverage is None
    assert [rows[i].has_code for i in (1, 2, 3, 4)] == [True, True, False, False]
    overall = {r.metric: r.value for r in E.eval_overall(scored).collect()}
    assert overall["type_annotation_coverage"] == 0.5
    assert overall["execution_success_rate"] == 0.25
    assert overall["similarity_to_chosen"] == pytest.approx(0.6)
    assert overall["similarity_to_rejected"] is None
    by_type = {(r.prompt_type, r.metric): r.value for r in E.eval_by_prompt_type(scored).collect()}
    assert by_type["code_form", "execution_success_rate"] == 0.0
    assert by_type["code_form", "type_annotation_coverage"] is None
    both = {(r.prompt_type, r.metric): r.value for r in E.eval_summary(scored).collect()}
    assert both == by_type | {(None, m): v for m, v in overall.items()}
    assert [r.example_id for r in E.no_code_rows(scored).collect()] == [3]


def test_untyped_rows_count_as_default(spark):
    df = spark.createDataFrame([("p", None), ("p", ""), (None, "code_form")], "prompt string, prompt_type string")
    rows = E.prepare_prompts(df, boost=True).collect()
    assert [r.prompt_type for r in rows] == ["default", "default", "code_form"]
    assert [r.prompt_text for r in rows] == ["pUse docstrings and mypy typing."] * 2 + [None]


def test_cosine(spark):
    rows = [([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0]), (None, [1.0])]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>")
    got = [r[0] for r in df.select(cosine_similarity(F.col("a"), F.col("b"))).collect()]
    assert got == [0.0, pytest.approx(1.0), 0.0, None, None]


def test_model_comparison(spark):
    rows = [("b", "base", "default", "comment_density", 0.1), ("t", "fine-tuned", "default", "comment_density", 0.4),
            ("b", "base", "default", "code_complexity", None), ("t", "fine-tuned", "code_form", "comment_density", 0.3),
            ("t", "fine-tuned", "other", "comment_density", 0.9)]
    df = spark.createDataFrame(rows, "model string, type string, prompt_type string, metric string, value double")
    got = {(r.prompt_type, r.model): (r.type_rank, r.value, r.delta) for r in M.model_comparison(df).collect()}
    assert got == {("default", "b"): (0, 0.1, None), ("default", "t"): (1, 0.4, pytest.approx(0.3)), ("code_form", "t"): (1, 0.3, None)}
    assert [(r.metric, r.n_values) for r in M.valid_metrics(df).collect()] == [("comment_density", 3)]
    wide = {(r.metric, r.prompt_type): (r.b, r.t) for r in M.metrics_wide_by_model(df, ["b", "t"]).collect()}
    assert wide["comment_density", "default"] == (0.1, 0.4)
