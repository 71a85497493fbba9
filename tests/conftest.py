"""One local session for all tests, with a shared folder of its own.

It is made on import, because the test modules build column expressions at their top level.
"""

from __future__ import annotations

import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from prefmill.session import build_session  # noqa: E402

_BASE = tempfile.mkdtemp(prefix="prefmill-tests-")

_SESSION = build_session(
    "tests",
    "local[4]",
    spark__sql__shuffle__partitions="4",
    spark__ui__enabled="false",
    spark__ui__showConsoleProgress="false",
    spark__driver__memory="6g",
    spark__checkpoint__dir=f"{_BASE}/shared",
    spark__sql__warehouse__dir=f"{_BASE}/warehouse",
)
_SESSION.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    yield _SESSION
    _SESSION.stop()


@pytest.fixture(scope="session")
def column(spark):
    """Values of a column expression over a list of inputs, in order."""

    def evaluate(expression, values, kind="string"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
        rows = df.select("i", expression.alias("y")).orderBy("i").collect()
        return [r["y"] for r in rows]

    return evaluate
