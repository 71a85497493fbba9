"""Operators under SQL names.

``code_fences(text)`` and ``text_lines(text)`` are table functions, called laterally: ``SELECT id, f.n, f.block FROM answers,
LATERAL code_fences(text) AS f``. They are SQL functions: Spark puts their bodies into the query, so a call costs what the
expression costs, and no row leaves the JVM. ``code_scores(text)`` and ``is_python(text)`` are the batch scorers, functions of
one value. ``register`` makes them known to a session.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from prefmill.functions.codescore import ast_scores, is_valid_python
from prefmill.functions.codetext import FENCE


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


#: Name, columns of the result, and the array whose entries are its rows.
TABLE_FUNCTIONS = {
    "code_fences": ("block", f"regexp_extract_all(input, {_literal(FENCE)}, 1)"),
    "text_lines": ("line", "split(input, '\\\\n', -1)"),
}


def register(spark: SparkSession) -> None:
    """Make the functions known to SQL in this session. A null text has no rows and no scores."""
    for name, (column, entries) in TABLE_FUNCTIONS.items():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(input STRING) RETURNS TABLE(n INT, {column} STRING) "
            f"RETURN SELECT pos + 1, col FROM posexplode({entries})"
        )
    spark.udf.register("code_scores", ast_scores)
    spark.udf.register("is_python", is_valid_python)
