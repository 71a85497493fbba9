"""Taxonomy, prompts, samples and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.inputs import table, view
from catalog.registry import query
from prefmill.functions.messages import wrap_messages
from prefmill.functions.text import list_repr
from prefmill.operators import prompts as P
from prefmill.operators import selection, taxonomy
from prefmill.operators.responses import parse_stage

COMBOS = """
combos AS (
  SELECT f.domain, f.task, l.libraries, f.forms,
         CAST(row_number() OVER (PARTITION BY f.domain ORDER BY f.task) - 1 AS INT) AS task_pos, f.repr
  FROM (SELECT domain, task, string_agg(code_form, ', ' ORDER BY code_form) AS forms,
               '[' || string_agg('''' || code_form || '''', ', ' ORDER BY code_form) || ']' AS repr
        FROM (SELECT DISTINCT domain, task, code_form FROM fx_code) d GROUP BY domain, task) f
  JOIN (SELECT domain, string_agg(library, ', ' ORDER BY library) AS libraries
        FROM (SELECT DISTINCT domain, library FROM fx_code) d GROUP BY domain) l USING (domain))"""


def combos_sql(body: str) -> str:
    """A body over the combinations, to be put behind the view fx_code."""
    return f", {COMBOS.strip()}\n{body.strip()}"


def sql_fill(template: str, fields: dict[str, str]) -> str:
    """SQL text expression for a template."""
    from string import Formatter

    parts = []
    for literal, field, _, _ in Formatter().parse(template):
        if literal:
            parts.append(" || chr(10) || ".join("'" + line.replace("'", "''") + "'" for line in literal.split("\n")))
        if field is not None:
            parts.append(fields[field])
    return " || ".join(parts)


def combos(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = taxonomy.taxonomy_from_table(view(spark, sf_dir, "fx_code"), "domain", "task", "code_form", "library")
    return taxonomy.combinations(rows)


def flat(df: DataFrame) -> DataFrame:
    return df.select(
        "domain",
        "task",
        "task_pos",
        F.array_join("libraries", ", ").alias("libraries"),
        F.array_join("code_form", ", ").alias("forms"),
    )


FLAT = "domain, task, task_pos, libraries, forms"


@query("combinations", combos_sql(f"SELECT {FLAT} FROM combos"), ("fx_code",))
def combinations(spark, sf_dir):
    return flat(combos(spark, sf_dir))


@query(
    "combination_by_index",
    combos_sql(f"SELECT {FLAT} FROM combos ORDER BY domain, task_pos LIMIT 1 OFFSET 31"),
    ("fx_code",),
)
def combination_by_index(spark, sf_dir):
    return flat(taxonomy.combination_by_index(combos(spark, sf_dir), 31, ["domain", "task_pos"]))


SAMPLE_ORDER = "ORDER BY md5('7|' || domain || '|' || task), domain, task"


@query("sample_n", combos_sql(f"SELECT {FLAT} FROM combos {SAMPLE_ORDER} LIMIT 20"), ("fx_code",))
def sample_n(spark, sf_dir):
    return flat(selection.sample_n(combos(spark, sf_dir), 20, ["domain", "task"], seed=7))


@query("random_one", combos_sql(f"SELECT {FLAT} FROM combos {SAMPLE_ORDER} LIMIT 1"), ("fx_code",))
def random_one(spark, sf_dir):
    return flat(selection.random_one(combos(spark, sf_dir), ["domain", "task"], seed=7))


@query(
    "sample_n_large",
    "SELECT o_orderkey, o_custkey FROM orders ORDER BY md5('7|' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 12001",
)
def sample_n_large(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return selection.sample_n(orders, 12001, ["o_orderkey"], seed=7)


FIELDS = {"domain": "domain", "task": "task", "libraries": "libraries", "code_forms": "repr"}


def _stage1(mode: str):
    def run(spark, sf_dir):
        return P.render_stage1(combos(spark, sf_dir), mode).select("domain", "task", "first_prompt")

    return run


for _mode, _name in (("train", "render_stage1"), ("header", "render_stage1_header"), ("test", "render_stage1_test")):
    _text = sql_fill(P.STAGE1_TEMPLATES[_mode], FIELDS)
    query(_name, combos_sql(f"SELECT domain, task, {_text} AS first_prompt FROM combos"), ("fx_code",))(_stage1(_mode))


@query(
    "mode_guard",
    combos_sql(
        "SELECT 'header' AS mode, domain, count(*) AS n, CAST(sum(length("
        + sql_fill(P.STAGE1_TEMPLATES["header"], FIELDS)
        + ")) AS BIGINT) AS prompt_chars FROM combos GROUP BY domain"
    ),
    ("fx_code",),
)
def mode_guard(spark, sf_dir):
    mode = P.mode_guard(is_test=False, is_header=True)
    rows = P.render_stage1(combos(spark, sf_dir), mode).withColumn("mode", F.lit(mode))
    return rows.groupBy("mode", "domain").agg(
        F.count("*").alias("n"), F.sum(F.length("first_prompt")).cast("bigint").alias("prompt_chars")
    )


def _items_sql(code_key: str) -> str:
    def entry(use_case: str, code: str) -> str:
        return (
            f"'  {{' || chr(10) || '    \"use_case\": \"{use_case}\",' || chr(10) || '    \"{code_key}\": ' || {code} "
            "|| chr(10) || '  }'"
        )

    entries = [entry("u0", "CAST(to_json(rejected_code) AS VARCHAR)"), entry("u1", "'\"z = 1\"'"), entry("u2", "'\"z = 1\"'")]
    return "'[' || chr(10) || " + " || ',' || chr(10) || ".join(entries) + " || chr(10) || ']'"


def _stage2_sql(mode: str, code_key: str) -> str:
    text = sql_fill(
        P.STAGE2_TEMPLATES[mode],
        {"domain": "domain", "task": "task", "libraries": "''", "code_forms": "code_form", "items": _items_sql(code_key)},
    )
    return f"SELECT k AS result_id, {text} AS second_prompt FROM fx_code WHERE k % 13 <> 0"


@query("render_stage2", _stage2_sql("train", "code"), ("fx_code",))
def render_stage2(spark, sf_dir):
    parsed = parse_stage(view(spark, sf_dir, "fx_responses"), 1).filter("error_info is null")
    return P.render_stage2(parsed).select("result_id", "second_prompt")


@query("render_stage2_header", _stage2_sql("header", "header"), ("fx_code",))
def render_stage2_header(spark, sf_dir):
    parsed = parse_stage(view(spark, sf_dir, "fx_header_responses"), 1, "header").filter("error_info is null")
    return P.render_stage2(parsed, "header").select("result_id", "second_prompt")


@query(
    "render_stage2_test",
    "SELECT k AS result_id, "
    + sql_fill(
        P.STAGE2_TEMPLATES["test"],
        {
            "domain": "domain",
            "task": "task",
            "libraries": "''",
            "code_forms": "code_form",
            "items": "'{' || chr(10) || '  \"use_case\": \"u\",' || chr(10) || '  \"code\": ' "
            "|| CAST(to_json(rejected_code) AS VARCHAR) || chr(10) || '}'",
        },
    )
    + " AS second_prompt FROM fx_code WHERE k % 13 <> 0",
    ("fx_code",),
)
def render_stage2_test(spark, sf_dir):
    parsed = parse_stage(view(spark, sf_dir, "fx_test_responses"), 1, "test").filter("error_info is null")
    return P.render_stage2(parsed, "test").select("result_id", "second_prompt")


@query(
    "wrap_messages",
    """
SELECT conv_id, turn, CAST(0 AS INT) AS pos, 'system' AS role, domain AS content FROM fx_text_pairs WHERE domain <> 'conv0'
UNION ALL
SELECT conv_id, turn, CAST(CASE WHEN domain <> 'conv0' THEN 1 ELSE 0 END AS INT), 'user', prompt_text FROM fx_text_pairs""",
    ("fx_text_pairs",),
)
def wrap(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_text_pairs")
    system = F.when(F.col("domain") != "conv0", F.col("domain"))
    listed = rows.select("conv_id", "turn", F.posexplode(wrap_messages(F.col("prompt_text"), system)).alias("pos", "m"))
    return listed.select("conv_id", "turn", "pos", "m.role", "m.content")


@query("list_repr", "SELECT p_partkey, '[''' || p_name || ''', ''' || p_brand || ''']' AS repr FROM part")
def list_repr_query(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", list_repr(F.array("p_name", "p_brand")).alias("repr"))


@query(
    "prompt_boost",
    f"SELECT conv_id, turn, prompt_text || '{P.PROMPT_BOOST}' AS boosted FROM fx_text_pairs",
    ("fx_text_pairs",),
)
def prompt_boost(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_text_pairs")
    return rows.select("conv_id", "turn", P.prompt_boost(F.col("prompt_text")).alias("boosted"))


@query("first_n", "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 25")
def first_n(spark, sf_dir):
    return selection.first_n(table(spark, sf_dir, "documents").select("doc_id", "text"), 25, ["doc_id"])


@query(
    "train_test_split",
    "SELECT doc_id, CASE WHEN substr(md5('7|' || CAST(doc_id AS VARCHAR)), 1, 8) < '1999999a' THEN 'test' ELSE 'train' END AS split FROM documents",
)
def train_test_split(spark, sf_dir):
    return selection.train_test_split(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 0.1, seed=7)
