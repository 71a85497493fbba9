"""Inputs derived from the given tables by SQL that reads the same in Spark and in the checking engine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class View:
    sql: str
    tables: tuple[str, ...] = ()
    needs: tuple[str, ...] = ()


def _json_text(column: str) -> str:
    """A code column as a JSON string literal."""
    quoted = f"replace(replace({column}, chr(34), chr(92) || chr(34)), chr(10), chr(92) || 'n')"
    return f"chr(34) || {quoted} || chr(34)"


VIEWS: dict[str, View] = {}

# Python snippets whose scores follow from the key: k % 3, k % 4 and k % 11 decide what they hold.
VIEWS["fx_code"] = View(
    """
SELECT p_partkey AS k,
       split_part(p_type, ' ', 1) AS domain,
       p_brand AS task,
       CASE WHEN p_partkey % 2 = 0 THEN 'utility function' ELSE 'processor class' END AS code_form,
       'lib' || CAST(p_size % 7 AS STRING) AS library,
       'import math' || chr(10) || '# part ' || CAST(p_partkey AS STRING) || chr(10)
         || 'def f(a: int, b: int) -> int:' || chr(10) || '    ' || repeat(chr(34), 3) || 'Add.' || repeat(chr(34), 3) || chr(10)
         || CASE WHEN p_partkey % 3 = 0 THEN '    if a:' || chr(10) || '        return b' || chr(10) ELSE '' END
         || '    return a + b'
         || CASE WHEN p_partkey % 4 = 0 THEN chr(10) || 'def g(x):' || chr(10) || '    return x' ELSE '' END AS chosen_code,
       CASE WHEN p_partkey % 11 = 0 THEN 'def f(a, b:' || chr(10) || '    return a'
            ELSE 'def f(a, b):' || chr(10) || '    return a + b + ' || CAST(p_size AS STRING) END AS rejected_code,
       'Write code for ' || p_name AS prompt_text
FROM part""",
    tables=("part",),
)

VIEWS["fx_json"] = View(
    f"SELECT *, {_json_text('rejected_code')} AS rj, {_json_text('chosen_code')} AS cj FROM fx_code",
    needs=("fx_code",),
)

VIEWS["fx_responses"] = View(
    """
SELECT k AS result_id, domain, task, code_form,
       CASE WHEN k % 13 = 0 THEN 'not json'
            ELSE '{"examples":[{"use_case":"u0","code":' || rj || ',"prompt":"' || CASE WHEN k % 17 = 0 THEN '' ELSE prompt_text END || '"},'
              || '{"use_case":"u1","code":"z = 1","prompt":"second"},'
              || '{"use_case":"u2","code":"z = 1","prompt":"shadowed"}]}' END AS first_content,
       CASE WHEN k % 19 = 0 THEN '{"improved_examples":[]} trailing'
            ELSE '{"improved_examples":[{"use_case":"u0","original_code":' || rj || ',"improved_code":' || cj || '},'
              || '{"use_case":"u1","original_code":"z = 1","improved_code":"z: int = 1"},'
              || '{"use_case":"u9","original_code":"no match","improved_code":"q"}]}' END AS second_content
FROM fx_json""",
    needs=("fx_json",),
)

VIEWS["fx_header_responses"] = View(
    """
SELECT result_id, domain, task, code_form,
       replace(replace(first_content, '"examples"', '"headers"'), '"code"', '"header"') AS first_content,
       replace(replace(replace(second_content, '"improved_examples"', '"improved_headers"'),
               '"original_code"', '"original_header"'), '"improved_code"', '"improved_header"') AS second_content
FROM fx_responses""",
    needs=("fx_responses",),
)

VIEWS["fx_test_responses"] = View(
    """
SELECT k AS result_id, domain, task, code_form,
       CASE WHEN k % 13 = 0 THEN '' ELSE '{"use_case":"u","code":' || rj || '}' END AS first_content,
       CASE WHEN k % 19 = 0 THEN '[]'
            ELSE '{"use_case":"u","original_code":' || rj || ',"improved_code":' || cj
              || ',"prompt_default":"plain ' || prompt_text || '","prompt_code_form":"'
              || CASE WHEN k % 5 = 0 THEN '' ELSE code_form || ': ' || prompt_text END || '"'
              || CASE WHEN k % 6 = 0 THEN '' ELSE ',"prompt_code_form_types":"typed ' || prompt_text || '"' END || '}' END AS second_content
FROM fx_json""",
    needs=("fx_json",),
)

# Every way in which a response can be unusable, by the last digit of the key.
VIEWS["fx_broken"] = View(
    """
SELECT k AS result_id, domain,
       CASE k % 10 WHEN 0 THEN '{"examples":[{"use_case":"u"}]}' WHEN 1 THEN '[1,2]' WHEN 2 THEN '{"examples":[]} {}'
                   WHEN 3 THEN '{"examples":null}' WHEN 4 THEN NULL
                   ELSE '{"examples":[{"use_case":"u","code":' || rj || '}]}' END AS first_content,
       CASE k % 10 WHEN 5 THEN '{"improved_examples":"none"}' WHEN 6 THEN '{"improved_examples":[1]}' WHEN 7 THEN '{' WHEN 8 THEN NULL
                   ELSE '{"improved_examples":[]}' END AS second_content
FROM fx_json""",
    needs=("fx_json",),
)

VIEWS["fx_predictions"] = View(
    """
SELECT k AS example_id,
       CASE k % 3 WHEN 0 THEN 'default' WHEN 1 THEN 'code_form' ELSE 'code_form_types' END AS prompt_type,
       domain, task, prompt_text,
       CASE WHEN k % 7 = 0 THEN 'Sorry, no code here.'
            WHEN k % 5 = 0 THEN chosen_code
            ELSE 'Here you go:' || chr(10) || '```python' || chr(10) || 'pip install x' || chr(10) || chosen_code || chr(10) || '```' || chr(10)
                 || 'and' || chr(10) || '```' || chr(10) || 'import math' || chr(10) || 'print(1)' || chr(10) || '```' END AS generated_text,
       chosen_code, rejected_code,
       CASE WHEN k % 23 = 0 THEN NULL ELSE k % 2 = 0 END AS exec_success
FROM fx_code""",
    needs=("fx_code",),
)

VIEWS["fx_scalars"] = View(
    """
SELECT 'run' || CAST(user_id % 3 AS STRING) AS run, 'file' || CAST(event_id % 2 AS STRING) AS event_file,
       CASE event_type WHEN 'click' THEN 'train/loss' WHEN 'view' THEN 'eval/loss' WHEN 'error' THEN 'train/rewards/margins'
            ELSE 'other/' || event_type END AS tag,
       event_id AS step, value
FROM events""",
    tables=("events",),
)

VIEWS["fx_logps"] = View(
    """
SELECT l_orderkey, l_linenumber, l_returnflag,
       -l_quantity AS policy_chosen_logp, -l_quantity - 10.0 * l_discount AS ref_chosen_logp,
       -l_quantity - 100.0 * l_tax AS policy_rejected_logp, -l_quantity - 1.0 AS ref_rejected_logp
FROM lineitem""",
    tables=("lineitem",),
)

VIEWS["fx_shards"] = View(
    "SELECT doc_id, text, source, CAST(replace(source, 'src', '') AS INT) AS shard_no FROM documents",
    tables=("documents",),
)

# User turns with the assistant turn that follows. Turns are numbered without gaps, so the next turn is
# found by key; a conversation of any length is spread over all partitions.
VIEWS["fx_text_pairs"] = View(
    """
SELECT u.conv_id AS conv_id, u.turn AS turn, u.text AS prompt_text, a.text AS chosen_text,
       'conv' || CAST(u.conv_id % 5 AS STRING) AS domain
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'""",
    tables=("conversations",),
)

# Documents as the three sides of a pair.
VIEWS["fx_sides"] = View(
    """
SELECT doc_id, source || ' ' || lang AS prompt, text AS chosen, replace(text, 'e', ' ') AS rejected, lang, source
FROM documents""",
    tables=("documents",),
)

# True scores of the snippets (only the checking SQL uses these).
VIEWS["fx_truth"] = View(
    """
SELECT k, domain, task, code_form, side, metric, value FROM (
  SELECT k, domain, task, code_form,
         1 + CASE WHEN k % 4 = 0 THEN 1.0 ELSE 0.0 END AS fns,
         CASE WHEN k % 3 = 0 THEN 1.0 ELSE 0.0 END AS c3,
         k % 11 = 0 AS bad FROM fx_code) t,
  LATERAL (VALUES
    ('chosen', 'type_annotation_coverage', 1.0 / fns), ('chosen', 'docstring_coverage', 1.0 / fns),
    ('chosen', 'code_complexity', (fns + c3) / fns), ('chosen', 'pep8_compliance', 1.0),
    ('chosen', 'comment_density', 1.0 / (3.0 + 2.0 * c3 + 2.0 * fns)),
    ('rejected', 'type_annotation_coverage', CASE WHEN bad THEN NULL ELSE 0.0 END),
    ('rejected', 'docstring_coverage', CASE WHEN bad THEN NULL ELSE 0.0 END),
    ('rejected', 'code_complexity', CASE WHEN bad THEN NULL ELSE 1.0 END),
    ('rejected', 'pep8_compliance', CASE WHEN bad THEN NULL ELSE 1.0 END),
    ('rejected', 'comment_density', CASE WHEN bad THEN NULL ELSE 0.0 END)) m(side, metric, value)
WHERE value IS NOT NULL""",
    needs=("fx_code",),
)

# True row means of the predictions, by the rules that decide their text.
VIEWS["fx_row_means"] = View(
    """
SELECT example_id, prompt_type, domain, has_code, CASE WHEN has_code THEN exec_success END AS exec_success,
       CASE WHEN has_code THEN 1.0 / fns / blocks END AS type_annotation_coverage,
       CASE WHEN has_code THEN 1.0 / (3.0 + 2.0 * c3 + 2.0 * fns) / blocks END AS comment_density,
       CASE WHEN has_code THEN 1.0 / fns / blocks END AS docstring_coverage,
       CASE WHEN has_code THEN (fns + c3) / fns / blocks END AS code_complexity,
       CASE WHEN has_code THEN CAST(1.0 AS DOUBLE) END AS pep8_compliance, blocks
FROM (SELECT *, 1 + CASE WHEN example_id % 4 = 0 THEN 1.0 ELSE 0.0 END AS fns,
             CASE WHEN example_id % 3 = 0 THEN 1.0 ELSE 0.0 END AS c3,
             example_id % 7 <> 0 AS has_code,
             CASE WHEN example_id % 5 = 0 THEN 1.0 ELSE 2.0 END AS blocks
      FROM fx_predictions) t""",
    needs=("fx_predictions",),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables whose narrow rows become texts a hundred times their size: they are dealt out before they grow.
GROWING = {"part": "p_partkey"}


def _scan(sf_dir: str, name: str) -> str:
    hint = f"/*+ REPARTITION({GROWING[name]}) */ " if name in GROWING else ""
    return f"SELECT {hint}* FROM parquet.`{sf_dir}/{name}.parquet`"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view over the given tables."""
    tables: list[str] = []
    ordered: list[str] = []

    def add(n: str) -> None:
        for needed in VIEWS[n].needs:
            add(needed)
        tables.extend(t for t in VIEWS[n].tables if t not in tables)
        if n not in ordered:
            ordered.append(n)

    add(name)
    parts = [f"{t} AS ({_scan(sf_dir, t)})" for t in tables]
    parts += [f"{n} AS ({VIEWS[n].sql})" for n in ordered]
    return spark.sql(f"WITH {', '.join(parts)} SELECT * FROM {name}")
