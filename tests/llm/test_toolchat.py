import json
import random

import pytest
from pyspark.sql import functions as F

from prefmill.llm import toolchat

CALL = "conv_id string, call_id string, turn long, name string, arguments string, depends_on array<string>, json string"
RESULT = "conv_id string, call_id string, turn long, content string, step long"
SCHEMA = {"add": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": "string"}}, "additionalProperties": False}}


def linked(spark, calls, results=()):
    given = spark.createDataFrame([(*c, "clash") for c in calls], CALL)
    came = spark.createDataFrame([(*r, 1) for r in results], RESULT)
    return toolchat.link(given, came, SCHEMA)


def levels(deps):
    """Steps by walking back; None on a cycle or behind one."""

    def walk(node, path):
        if node in path:
            return None
        found = [walk(d, path | {node}) for d in deps[node] if d in deps]
        return None if None in found else 1 + max(found, default=-1)

    return {node: walk(node, frozenset()) for node in deps}


@pytest.mark.parametrize("seed", range(3))
def test_steps_equal_walking_back(spark, seed):
    r = random.Random(seed)
    names = [f"c{k}" for k in range(30)]
    deps = {n: r.sample(names[:k], min(k, r.choice((0, 1, 1, 1, 2, 3)))) for k, n in enumerate(names)}
    deps |= {"x": ["y"], "y": ["z"], "z": ["x"], "after": ["x"], "both": ["c3", "x"], "self": ["self"], "lost": ["nowhere"], "twice": ["c1", "c1"]}
    rows = [("v", n, k, "add", "{}", d) for k, (n, d) in enumerate(deps.items())] + [("w", n, 0, "add", "{}", None) for n in names]
    got = {(x["conv_id"], x["call_id"]): x for x in linked(spark, rows).collect()}
    truth = levels(deps)
    assert {n: got["v", n]["step"] for n in deps} == truth
    assert all(got["w", n]["step"] == 0 for n in names)
    assert {n for n in deps if "cycle" in got["v", n]["errors"]} == {n for n, s in truth.items() if s is None}
    assert {n for n in deps if "missing dependency" in got["v", n]["errors"]} == {"lost"}


def test_a_long_chain(spark):
    rows = [("v", f"c{k}", k, "add", "{}", [f"c{k - 1}"] if k else []) for k in range(700)]
    got = {x["call_id"]: x["step"] for x in linked(spark, rows).collect()}
    assert got == {f"c{k}": k for k in range(700)}


def test_states_errors_and_lines(spark):
    calls = [
        ("v", "1", 0, "add", '{"b": "é\\n", "a": 1.0}', None),
        ("v", "2", 1, "add", '{"a": -1, "c": 0}', ["1"]),
        ("v", "3", 2, "add", "{broken", ["2"]),
        ("v", "4", 3, "sub", "{}", []),
        ("v", "4", 9, "add", '{"a": 1}', []),
        ("v", "5", 4, "add", '{"a":1,"a":2}', []),
        (None, "6", 4, "add", '{"a":1}', []),
        ("v", None, 4, "add", None, []),
    ]
    results = [("v", "1", 1, "two"), ("v", "1", 0, "one"), ("v", "9", 5, "lonely"), ("u", "2", 1, "other"), (None, None, None, None)]
    got = linked(spark, calls, results).collect()
    by = {(r["conv_id"], r["call_id"], r["state"]): r for r in got}
    assert len(got) == 10
    one = by["v", "1", "answered"]
    assert one["json"] == '{"arguments":{"a":1,"b":"é\\n"},"content":"one","id":"1","name":"add"}' and one["errors"] == [] and one["n_results"] == 2
    assert by["v", "2", "unanswered"]["errors"] == ["a: too small", "arguments: unknown c"] and by["v", "2", "unanswered"]["step"] == 1
    assert by["v", "3", "unanswered"]["errors"] == ["arguments: not JSON"] and json.loads(by["v", "3", "unanswered"]["json"])["arguments"] == "{broken"
    assert by["v", "4", "unanswered"]["errors"] == ["no schema"] and by["v", "4", "unanswered"]["n_calls"] == 2
    assert by["v", "5", "unanswered"]["errors"] == ["arguments: a repeated key"]
    assert by["v", "9", "orphan"]["json"] == '{"content":"lonely","id":"9"}' and ("u", "2", "orphan") in by
    assert sum(r["state"] == "unidentified" for r in got) == 3


def test_empty(spark):
    assert linked(spark, [], []).count() == 0


NUMBERS = {
    "0": "0", "-0.0": "0", "1.0": "1", "1e21": "1e+21", "1e20": "100000000000000000000", "123456789012345680000": "123456789012345680000", "1e-7": "1e-7",
    "0.000001": "0.000001", "1.5e300": "1.5e+300", "4.50": "4.5", "333333333.33333329": "333333333.3333333", "-2e-3": "-0.002", "9007199254740993": "9007199254740992",
}


@pytest.mark.parametrize("given", NUMBERS)
def test_numbers(given):
    assert toolchat.canonical(json.loads(given)) == NUMBERS[given]


def test_canonical_is_stable_and_sorted():
    value = {"\u20ac": 1, "\r": 2, "1": [True, None, {"b": 0, "a": ""}], "\U0001f600": 3, "\ufb33": 4}
    text = toolchat.canonical(value)
    assert text == '{"\\r":2,"1":[true,null,{"a":"","b":0}],"\u20ac":1,"\U0001f600":3,"\ufb33":4}'
    assert toolchat.canonical(toolchat.parsed(text)) == text
    for bad in ("NaN", "[Infinity]", '{"a":1,"a":1}', "1e999"):
        with pytest.raises(ValueError):
            toolchat.canonical(toolchat.parsed(bad))


@pytest.mark.parametrize(
    ("value", "schema", "found"),
    [
        (True, {"type": "integer"}, ["arguments: not of type integer"]),
        (2.0, {"type": "integer"}, []),
        (None, {"type": ["string", "null"]}, []),
        ("abc", {"type": "string", "pattern": "^b", "maxLength": 2}, ["arguments: too long", "arguments: not of the pattern"]),
        ([1, "a"], {"type": "array", "minItems": 3, "items": {"type": "number"}}, ["arguments: too few items", "[1]: not of type number"]),
        ({"k": {"x": 5}}, {"properties": {"k": {"properties": {"x": {"maximum": 4}}, "required": ["y"]}}}, ["k: without y", "k.x: too large"]),
        ("c", {"enum": ["a", "b"]}, ["arguments: not one of the values"]),
    ],
)
def test_schema(value, schema, found):
    assert toolchat.faults(value, schema) == found


def test_conversations_as_calls(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "q1"), (1, 2, "assistant", "a1"), (1, 3, "user", None), (2, 0, "assistant", "a"), (None, 0, "user", "q")]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("json", F.lit(1))
    calls, results = toolchat.turns_as_calls(talks)
    got = {(r["conv_id"], r["call_id"]): r for r in toolchat.link(calls, results, {"reply": {"type": "object"}}).collect()}
    assert got["1", "t1"]["state"] == "answered" and got["1", "t3"]["step"] == 1 and got["2", "t-1"]["state"] == "orphan"
    assert got[None, "t0"]["state"] == "unidentified"


def test_arguments_that_cannot_be_written_are_errors_of_their_row(spark):
    texts = {"deep": "[" * 2000 + "]" * 2000, "half": r'{"a": "\ud800"}', "large": "1" * 401, "digits": "1" * 5000, "fine": "[1]"}
    calls = spark.createDataFrame([("c", k, i, "f", t, []) for i, (k, t) in enumerate(texts.items())], "conv_id string, call_id string, turn long, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([], "conv_id string, call_id string, turn long, content string")
    rows = {r["call_id"]: r for r in toolchat.link(calls, results, {"f": {}}).collect()}
    assert rows["deep"]["errors"] == ["arguments: nested too deep"] and rows["half"]["errors"] == ["arguments: half a surrogate pair"]
    assert rows["large"]["errors"] == ["arguments: a number out of range"] and len(rows["digits"]["errors"]) == 1 and rows["fine"]["errors"] == []
    assert all(json.loads(rows[k]["json"])["arguments"] == t for k, t in texts.items() if k != "fine")
