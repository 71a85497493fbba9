import pytest
from pyspark.sql import functions as F

from prefmill.functions import strict_json as J
from prefmill.operators.responses import classify_error, parse_responses, parse_stage

X = F.col("x")

VALID = ['{"a":1}', "[1,2]", "null", '"t"', " {} ", "1", '{"a":[1,{"b":"]}"}]}', "true"]
INVALID = [
    "", " ", "{'a':1}", '{"a":1} x', '{"a":1}{"b":2}', '{"a":1}]', '{"a":1}}', "1]}", "1,2", '{"a":NaN}', '{"a":1,"a":2}',
    '{"a":"x\ny"}', "[1", "not json", '1],"sum":1} {"v":[2', '{"a":1},', "//c\n1", "01",
]


def test_strictness(column):
    valid = J.is_json(J.json_wrapped(X), X)
    assert column(valid, VALID) == [True] * len(VALID)
    assert column(valid, INVALID) == [False] * len(INVALID)
    assert column(valid, [None]) == [False]


def test_objects(column):
    texts = ['{"e":[{"a":"1"},{"a":2,"b":null}]}', '{"e":[]}', "{}", '{"e":null}', '{"e":"t"}', '{"e":[1]}', '{"e":[{},null]}', "[1]"]
    got = column(J.json_objects(J.json_wrapped(X), "e"), texts)
    assert got == [[{"a": "1"}, {"a": "2", "b": None}], [], [], None, None, None, None, None]


GOOD1 = '{"examples":[{"use_case":"u","code":"c","prompt":"p"}]}'
GOOD2 = '{"improved_examples":[{"use_case":"u","original_code":"c","improved_code":"d"}]}'


@pytest.mark.parametrize(
    ("first", "second", "kind", "stage"),
    [
        (GOOD1, GOOD2, None, None),
        ("{}", "{}", None, None),
        ('{"examples":[{"use_case":null,"code":"c"}]}', GOOD2, None, None),
        (None, GOOD2, "request", 1),
        (GOOD1, None, "request", 2),
        ("oops", GOOD2, "json", 1),
        (GOOD1, GOOD2 + " tail", "json", 2),
        ("oops", "oops", "json", 1),
        ("[1,2]", GOOD2, "processing", 1),
        ('{"examples":[{"code":"c"}]}', GOOD2, "processing", 1),
        ('{"examples":[{"use_case":"u"}]}', GOOD2, "processing", 1),
        ('{"examples":["u"]}', GOOD2, "processing", 1),
        ('{"examples":"u"}', GOOD2, "processing", 1),
        (GOOD1, "null", "processing", 2),
        (GOOD1, '{"improved_examples":{}}', "processing", 2),
    ],
)
def test_errors_per_row(spark, first, second, kind, stage):
    df = spark.createDataFrame([("d", first, second)], "domain string, first_content string, second_content string")
    row = parse_responses(df).first()
    assert (row.error_kind, row.error_stage) == (kind, stage)
    assert (row.error is None) == (kind is None)
    if kind:
        assert row.second_items is None


def test_error_texts_name_their_kind(spark):
    df = spark.createDataFrame([("x", None), (None, "timeout"), ("[1]", None)], "first_content string, request_error string")
    rows = classify_error(parse_stage(df, 1)).select("error").collect()
    assert sorted(r.error.split(":")[0] for r in rows) == ["JSON parse error", "Processing error", "Request error"]
    assert "Request error: timeout" in [r.error for r in rows]


def test_missing_members_read_as_empty(spark):
    df = spark.createDataFrame(
        [('{"examples":[{"use_case":"u","code":1}]}', '{"improved_examples":[{}]}')], "first_content string, second_content string"
    )
    row = parse_responses(df).first()
    assert row.error is None
    assert row.first_items[0].asDict() == {"use_case": "u", "code": "1", "prompt": None}
    assert row.second_items[0].asDict() == {"use_case": None, "original_code": "", "improved_code": ""}


def test_a_text_beyond_the_parser_says_so(spark):
    from prefmill.operators.responses import parse_stage

    df = spark.createDataFrame([(1, '{"examples":["' + "x" * (20 << 20) + '"]}'), (2, "{")], "id int, first_content string")
    found = {r.id: r.error_info.detail for r in parse_stage(df, 1).select("id", "error_info").collect()}
    assert "too large" in found[1] and "too large" not in found[2]
