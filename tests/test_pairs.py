import pytest
from pyspark.sql import functions as F

from prefmill.functions.messages import is_message_list, unwrap_content, wrap_messages
from prefmill.operators import pairs as P
from prefmill.operators import prompts as R

ITEMS = "array<struct<use_case string, code string, prompt string>>"
IMPROVED = "array<struct<use_case string, original_code string, improved_code string>>"
SCHEMA = f"domain string, task string, code_form array<string>, error string, first_items {ITEMS}, second_items {IMPROVED}"


def results(spark, first, second, error=None):
    return spark.createDataFrame([("d", "t", ["a", "b"], error, first, second)], SCHEMA)


def texts(pairs):
    rows = pairs.select(*[unwrap_content(pairs, s).alias(s) for s in ("prompt", "chosen", "rejected")]).collect()
    return sorted(tuple(r) for r in rows)


def test_first_equal_code_wins_even_with_an_empty_prompt(spark):
    first = [("u", "x", ""), ("u", "x", "later"), ("u", "y", "p")]
    second = [("u", "x", "X"), ("u", "y", "Y"), ("u", "z", "Z")]
    assert texts(P.build_pairs(results(spark, first, second))) == [("p", "Y", "y")]


def test_missing_code_equals_missing_original(spark):
    first, second = [("u", None, "p")], [("u", None, "X"), ("u", "", "Y")]
    pairs = P.build_pairs(results(spark, first, second))
    assert [t[:2] for t in texts(pairs)] == [("p", "X"), ("p", "Y")]


def test_error_rows_give_no_pair(spark):
    df = results(spark, [("u", "x", "p")], [("u", "x", "X")], "Processing error: x")
    assert P.build_pairs(df).count() == 0


def test_pair_row_shape(spark):
    pairs = P.build_pairs(results(spark, [("u", "x", "p")], [("u", "x", "X")]))
    row = pairs.first()
    assert pairs.columns == list(P.PAIR_COLUMNS)
    assert [(m.role, m.content) for m in (*row.prompt, *row.chosen, *row.rejected)] == [("user", "p"), ("assistant", "X"), ("assistant", "x")]
    assert row.code_form == "['a', 'b']"


def test_match_across_tables_equals_match_in_rows(spark):
    first = [("u", "x", "1"), ("u", "x", "2"), ("u", None, "3")]
    second = [("u", "x", "a"), ("u", "x", "b"), ("u", None, "c"), ("u", "q", "d")]
    df = results(spark, first, second).withColumn("id", F.lit(1))
    inside = {(r.item_pos, r.prompt_text) for r in P.match_prompts(df, ["id"]).collect()}
    items = df.select("id", F.posexplode("first_items").alias("pos", "i")).select("id", "pos", "i.*")
    improved = df.select("id", F.posexplode("second_items").alias("item_pos", "i")).select("id", "item_pos", "i.original_code")
    across = {(r.item_pos, r.prompt_text) for r in P.match_first_across(improved, items, "id").collect()}
    assert inside == across == {(0, "1"), (1, "1"), (2, "3"), (3, None)}


def test_test_pairs_take_the_first_form_and_skip_empty_prompts(spark):
    item = "array<struct<use_case string, original_code string, improved_code string, prompt_default string, prompt_code_form string, prompt_code_form_types string>>"
    df = spark.createDataFrame(
        [("d", "t", ["a", "b"], None, [("u", "o", "i", "p1", "", "p3")])],
        f"domain string, task string, code_form array<string>, error string, second_items {item}",
    )
    rows = P.build_test_pairs(df).select("prompt_type", "code_form", F.col("prompt")[0].content.alias("p")).collect()
    assert sorted(tuple(r) for r in rows) == [("code_form_types", "a", "p3"), ("default", "a", "p1")]


def test_unwrap(spark):
    df = spark.createDataFrame([([("user", "x")], "p"), ([], None), (None, "")], "m array<struct<role string, content string>>, t string")
    assert is_message_list(df, "m")
    assert not is_message_list(df, "t")
    rows = df.select(unwrap_content(df, "m").alias("m"), unwrap_content(df, "t").alias("t")).collect()
    assert [tuple(r) for r in rows] == [("x", "p"), ("", ""), ("", "")]


def test_wrap(column):
    x = F.col("x")
    assert [len(m) for m in column(wrap_messages(F.lit("u"), x), ["s", "", None])] == [2, 1, 1]
    assert [m[0].role for m in column(wrap_messages(x), ["u"])] == ["user"]


def test_modes():
    assert [R.mode_guard(False, False), R.mode_guard(True, False), R.mode_guard(False, True)] == ["train", "test", "header"]
    with pytest.raises(ValueError, match="header"):
        R.mode_guard(True, True)


def test_rendered_prompts_keep_awkward_text(spark):
    df = spark.createDataFrame([("d{x}", "t'q", ["l1", "l2"], ["a'b"])], "domain string, task string, libraries array<string>, code_form array<string>")
    text = R.render_stage1(df).first().first_prompt
    for part in ("d{x}", "t'q", "l1, l2", '["a\'b"]', '{"examples": ['):
        assert part in text


def test_items_json_is_json(spark):
    import json

    items = [("u\n", 'c"1"', "p"), (None, "c2", "p")]
    df = spark.createDataFrame([(items,), ([],)], f"first_items {ITEMS}")
    full, empty = [r[0] for r in df.select(R.items_json(F.col("first_items"), "code")).collect()]
    assert json.loads(full) == [{"use_case": "u\n", "code": 'c"1"'}, {"use_case": None, "code": "c2"}]
    assert full == json.dumps(json.loads(full), indent=2)
    assert empty == "[]"


def test_dataset_card(spark):
    df = spark.createDataFrame([("d", "t1", "f"), ("d", "t2", "f"), ("e", "t1", None)], "domain string, task string, code_form string")
    assert tuple(P.dataset_card(df).first()) == (3, 2, 2, 1)
