import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prefmill.functions import text as T

X = F.col("x")

LINES = [
    "", "\n", "a", "a\n", "a\r\nb", "a\rb\r", "\x0b#\x0c", "a\x1cb\x1dc\x1e", "\x85", "a\u2028b\u2029", "\r\n\r\n", "x\n\n\ny", "\n\r",
]


def test_line_and_blank_sets_are_pythons():
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    assert set(T.LINE_ENDS) == {c for c in every if len(f"a{c}b".splitlines()) == 2}
    assert set(T.BLANKS) == {c for c in every if c.isspace()}


def test_lines(column):
    assert column(T.split_lines(X), LINES) == [s.splitlines() for s in LINES]
    assert column(T.line_count(T.plain_breaks(X)), LINES) == [len(s.splitlines()) for s in LINES]


def test_strip(column):
    values = ["", " a ", "\u3000a b\x1f\n", "\x85\u00a0", "a", "\ufeffa "]
    assert column(T.strip_text(X), values) == [v.strip() for v in values]


def test_tokens(column):
    values = ["", "a b", "don't stop", "été – 12_3!", "  \t\n", "日本語 ok", "a\u00a0b", "😀x"]
    word = re.compile(r"\w+|[^\w \t\n\x0b\x0c\r]")
    assert column(T.tokens(X), values) == [word.findall(v) for v in values]
    assert column(T.token_count(X), values) == [len(word.findall(v)) for v in values]


def test_list_repr(column):
    values = [[], ["a"], ["it's"], ['say "x"'], ["it's \"x\""], ["a\\b\n\t"], ["a", "b c"]]
    assert column(T.list_repr(X), values, "array<string>") == [str(v) for v in values]


def test_json_string(column):
    import json

    values = ["", 'a"b', "line\nbreak\\", "\t", "é"]
    assert column(T.json_string(X), values) == [json.dumps(v, ensure_ascii=False) for v in values]


def test_fill(column):
    assert column(T.fill("{{a}} {x}-{x}", {"x": X}), ["1", "2"]) == ["{a} 1-1", "{a} 2-2"]


def test_let_computes_the_value_for_null_too(column):
    assert column(T.let(X, lambda v: F.coalesce(v, F.lit("none"))), ["a", None]) == ["a", "none"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab #'\"\\\n\r\t\x0b\x1c\x85\u2028", max_size=12), min_size=1, max_size=40))
def test_lines_match_python_on_any_text(column, values):
    assert column(T.split_lines(X), values) == [v.splitlines() for v in values]
