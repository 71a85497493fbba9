"""Operator 6, chat formatting: tool-call linking.

Calls and results are joined by conversation and call id, calls are put in an order in which each follows the
calls it depends on, their arguments are checked against the tool's schema, and every exchange becomes one line
of canonical JSON (sorted keys, no blanks, shortest numbers).

Order. ``step`` is 0 for a call without dependencies and one more than the largest step it depends on otherwise.
Chains, in which each call depends on one other, are shortened by pointer doubling, so a chain of n calls takes
log2(n) rounds however much of the table one conversation holds; calls with several dependencies then take a round
per level. Rounds move ids, never texts, and are written to the shared folder. Calls on a cycle have no step.

Defined results: a call without result is ``unanswered``, a result without call ``orphan``, a row without
conversation or call id ``unidentified`` and linked to nothing. Of several calls or results with one id the first by
turn, then by text, counts, and their numbers are told. Dependencies that name no call are an error of the row and
wait for nothing. Arguments that are no JSON object are an error and are kept as they are. A tool
without a schema is an error. Empty tables give an empty result. Other columns are left alone.
"""

from __future__ import annotations

import json
import math
import re
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefmill.llm.tables import cut, map_batches

CALLS = "conv_id, call_id, turn, name, arguments, depends_on"
RESULTS = "conv_id, call_id, turn, content"
LINKED = "conv_id string, call_id string, turn long, step long, state string, n_calls long, n_results long, errors array<string>, json string"


def number(value: float | int) -> str:
    """A JSON number in its shortest form: integers up to 2 ** 53 as they are, others as the double they stand for."""
    if isinstance(value, int) and abs(value) <= 1 << 53:
        return str(value)
    value = float(value)
    if not math.isfinite(value):
        raise ValueError("a number out of range")
    if value == 0:
        return "0"
    digits, _, power = repr(value).partition("e")
    sign = "-" if digits[0] == "-" else ""
    whole, _, part = digits.lstrip("-").partition(".")
    part = "" if part == "0" else part
    point = len(whole) + int(power or 0)
    figures = (whole + part).lstrip("0")
    point -= len(whole + part) - len((whole + part).lstrip("0"))
    figures = figures.rstrip("0")
    n = len(figures)
    if n <= point <= 21:
        return sign + figures + "0" * (point - n)
    if 0 < point <= 21:
        return f"{sign}{figures[:point]}.{figures[point:]}"
    if -6 < point <= 0:
        return f"{sign}0.{'0' * -point}{figures}"
    shown = figures[0] + ("." + figures[1:] if n > 1 else "")
    return f"{sign}{shown}e{'+' if point > 0 else '-'}{abs(point - 1)}"


def canonical(value: Any) -> str:
    """The canonical JSON text of a parsed value; keys in the order of their UTF-16 code units."""
    if value is None or value is True or value is False:
        return {None: "null", True: "true", False: "false"}[value]
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, (int, float)):
        return number(value)
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
    return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k])}" for k in keys) + "}"


def _once(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("a repeated key")
    return out


def _refuse(name: str) -> None:
    raise ValueError(f"the number {name}")


def parsed(text: str) -> Any:
    """Strict JSON: no repeated keys, no NaN or infinity."""
    return json.loads(text, object_pairs_hook=_once, parse_constant=_refuse)


_KINDS = {
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str),
    "integer": lambda v: not isinstance(v, bool) and (isinstance(v, int) or isinstance(v, float) and v.is_integer()),
    "number": lambda v: not isinstance(v, bool) and isinstance(v, (int, float)),
    "boolean": lambda v: isinstance(v, bool),
    "null": lambda v: v is None,
}


def faults(value: Any, schema: dict[str, Any], at: str = "") -> list[str]:
    """What of a schema a value breaks: type, enum, lengths, bounds, pattern, required and further properties, items."""
    here = at or "arguments"
    kinds = schema.get("type")
    if kinds is not None and not any(_KINDS[k](value) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{here}: not of type {kinds if isinstance(kinds, str) else ' or '.join(kinds)}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{here}: not one of the values")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            out.append(f"{here}: too short")
        if len(value) > schema.get("maxLength", math.inf):
            out.append(f"{here}: too long")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{here}: not of the pattern")
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", -math.inf):
            out.append(f"{here}: too small")
        if value > schema.get("maximum", math.inf):
            out.append(f"{here}: too large")
    elif isinstance(value, list):
        if len(value) < schema.get("minItems", 0):
            out.append(f"{here}: too few items")
        for i, item in enumerate(value if "items" in schema else []):
            out += faults(item, schema["items"], f"{at}[{i}]")
    elif isinstance(value, dict):
        own = schema.get("properties", {})
        out += [f"{here}: without {key}" for key in sorted(schema.get("required", [])) if key not in value]
        for key in sorted(value):
            if key in own:
                out += faults(value[key], own[key], f"{at}.{key}" if at else key)
            elif schema.get("additionalProperties") is False:
                out.append(f"{here}: unknown {key}")
    return out


def steps(calls: DataFrame) -> DataFrame:
    """Rows (conv_id, call_id, step, missing) for unique calls (conv_id, call_id, depends_on)."""
    edges = cut(calls.select("conv_id", "call_id", F.explode(F.array_distinct("depends_on")).alias("dep")).filter("dep IS NOT NULL"), "edges")
    nodes = calls.select("conv_id", F.col("call_id").alias("dep")).withColumn("there", F.lit(True))
    found = edges.join(nodes, ["conv_id", "dep"], "left")
    waits = found.groupBy("conv_id", "call_id").agg(
        F.count("there").alias("n"),
        F.min(F.when(F.col("there"), F.col("dep"))).alias("first"),
        (F.count(F.lit(1)) > F.count("there")).alias("missing"),
    )
    table = calls.select("conv_id", "call_id").join(waits, ["conv_id", "call_id"], "left")
    table = table.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("missing", F.coalesce("missing", F.lit(False)))
    # Each call points to the nearest call before it on its chain that has no or several dependencies.
    jump = cut(
        table.select(
            "conv_id", "call_id", "n", "missing",
            F.when(F.col("n") == 1, F.col("first")).otherwise(F.col("call_id")).alias("to"),
            F.when(F.col("n") == 1, 1).otherwise(0).cast("long").alias("far"),
            (F.col("n") != 1).alias("ended"),
        ),
        "jumps",
    )
    total = jump.count()
    for _ in range(total.bit_length() + 1):
        if not jump.filter("NOT ended").limit(1).count():
            break
        ahead = jump.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("far").alias("more"), F.col("ended").alias("done"))
        moved = jump.filter("NOT ended").join(ahead, ["conv_id", "to"]).select(
            "conv_id", "call_id", "n", "missing", F.col("next").alias("to"), (F.col("far") + F.col("more")).alias("far"), F.col("done").alias("ended")
        )
        jump = cut(jump.filter("ended").unionByName(moved), "jumps")
    # Now calls with several dependencies, level by level; a dependency's step is its anchor's plus the way to it.
    known = cut(jump.filter("ended AND n = 0").select("conv_id", F.col("call_id").alias("anchor"), F.lit(0).cast("long").alias("level")), "levels")
    anchors = jump.filter("ended").select("conv_id", F.col("call_id").alias("dep"), F.col("to").alias("anchor"), "far")
    several = jump.filter("n > 1").select("conv_id", "call_id")
    many = cut(found.filter("there").join(several, ["conv_id", "call_id"]).join(anchors, ["conv_id", "dep"], "left").select("conv_id", "call_id", "anchor", "far"), "many")
    left = many.select("conv_id", "call_id").distinct().count()
    while left:
        ready = many.join(known, ["conv_id", "anchor"], "left").groupBy("conv_id", "call_id").agg(
            F.bool_and(F.col("level").isNotNull()).alias("all"), (F.max(F.col("level") + F.col("far")) + 1).alias("level")
        )
        known = cut(
            known.unionByName(ready.filter("all").select("conv_id", F.col("call_id").alias("anchor"), "level")).groupBy("conv_id", "anchor").agg(F.max("level").alias("level")),
            "levels",
        )
        done = known.join(several, (known["conv_id"] == several["conv_id"]) & (known["anchor"] == several["call_id"]), "left_semi").count()
        total_several = many.select("conv_id", "call_id").distinct().count()
        if total_several - done == left:
            break  # what is left waits for itself
        left = total_several - done
    return (
        jump.withColumnRenamed("to", "anchor")
        .join(known, ["conv_id", "anchor"], "left")
        .select("conv_id", "call_id", F.when(F.col("ended"), F.col("level") + F.col("far")).alias("step"), "missing")
    )


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, Any]]) -> DataFrame:
    """One row for each call or orphan result; calls have the columns of ``CALLS``, results those of ``RESULTS``."""
    given = calls.select(F.col("conv_id").cast("string").alias("conv_id"), *[F.col(c.strip()) for c in CALLS.split(",")[1:]])
    came = results.select(F.col("conv_id").cast("string").alias("conv_id"), *[F.col(c.strip()) for c in RESULTS.split(",")[1:]])
    whole = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    first_call = F.min(F.struct("turn", "name", "arguments", "depends_on")).alias("c")
    one = given.filter(whole).groupBy("conv_id", "call_id").agg(first_call, F.count(F.lit(1)).alias("n_calls"))
    one = cut(one.select("conv_id", "call_id", "c.*", "n_calls"), "calls")
    first_result = F.min(F.struct(F.col("turn").alias("answer_turn"), "content")).alias("r")
    answer = came.filter(whole).groupBy("conv_id", "call_id").agg(first_result, F.count(F.lit(1)).alias("n_results"))
    joined = one.join(answer.select("conv_id", "call_id", "r.*", "n_results"), ["conv_id", "call_id"], "full")
    joined = joined.join(steps(one), ["conv_id", "call_id"], "left")
    state = F.when(F.col("n_calls").isNull(), "orphan").when(F.col("n_results").isNull(), "unanswered").otherwise("answered")
    known = joined.withColumn("state", state).withColumn("turn", F.coalesce("turn", "answer_turn")).drop("answer_turn")
    lost = [
        given.filter(~whole).withColumn("content", F.lit(None).cast("string")).withColumn("n_calls", F.lit(1).cast("long")),
        came.filter(~whole).withColumn("name", F.lit(None).cast("string")).withColumn("n_results", F.lit(1).cast("long")),
    ]
    for rows in lost:
        known = known.unionByName(rows.withColumn("state", F.lit("unidentified")), allowMissingColumns=True)
    columns = ["conv_id", "call_id", "turn", "step", "state", "n_calls", "n_results", "name", "arguments", "content", "missing"]

    def write(batch: pa.RecordBatch) -> pa.RecordBatch:
        errors, lines = [], []
        for row in batch.to_pylist():
            found: list[str] = []
            line: dict[str, Any] = {"content": row["content"], "id": row["call_id"]}
            if row["n_calls"]:
                line |= {"name": row["name"], "arguments": row["arguments"]}
                try:
                    value = parsed(row["arguments"] or "")
                    canonical(value).encode()
                    schema = schemas.get(row["name"])
                    found += ["no schema"] if schema is None else faults(value, schema)
                    line["arguments"] = value
                except json.JSONDecodeError:
                    found.append("arguments: not JSON")
                except RecursionError:
                    found.append("arguments: nested too deep")
                except UnicodeEncodeError:
                    found.append("arguments: half a surrogate pair")
                except (ValueError, OverflowError) as error:
                    found.append(f"arguments: {'a number out of range' if isinstance(error, OverflowError) else error}")
                if row["missing"]:
                    found.append("missing dependency")
                if row["step"] is None and row["state"] != "unidentified":
                    found.append("cycle")
            errors.append(found)
            lines.append(canonical(line))
        keep = [batch.column(i) for i in range(5)]
        counts = [pa.array([x or 0 for x in batch.column(i).to_pylist()], pa.int64()) for i in (5, 6)]
        return pa.RecordBatch.from_arrays(
            [*keep, *counts, pa.array(errors, pa.list_(pa.string())), pa.array(lines, pa.string())],
            names=["conv_id", "call_id", "turn", "step", "state", "n_calls", "n_results", "errors", "json"],
        )

    return map_batches(known.select(*columns).withColumn("turn", F.col("turn").cast("long")), write, LINKED)


def turns_as_calls(conversations: DataFrame, tool: str = "reply") -> tuple[DataFrame, DataFrame]:
    """Plain conversations seen as tool use: a user's turn calls ``tool`` with its text, the assistant's next turn is the result.

    A call's id is its turn; it depends on the call two turns earlier, if there is one. Turns of other roles (``system``)
    neither call nor answer and have no row.
    """
    turn = F.col("turn").cast("long")
    calls = conversations.filter("role = 'user'").select(
        F.col("conv_id").cast("string").alias("conv_id"),
        F.concat(F.lit("t"), turn.cast("string")).alias("call_id"),
        turn.alias("turn"),
        F.lit(tool).alias("name"),
        F.to_json(F.struct(F.col("text").alias("prompt"), turn.alias("turn")), {"ignoreNullFields": "false"}).alias("arguments"),
        F.when(turn >= 2, F.array(F.concat(F.lit("t"), (turn - 2).cast("string")))).otherwise(F.array().cast("array<string>")).alias("depends_on"),
    )
    results = conversations.filter("role = 'assistant'").select(
        F.col("conv_id").cast("string").alias("conv_id"),
        F.concat(F.lit("t"), (turn - 1).cast("string")).alias("call_id"),
        turn.alias("turn"),
        F.col("text").alias("content"),
    )
    return calls, results
