"""Registration of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.inputs import VIEWS

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def with_views(body: str, *names: str) -> str:
    """SQL body preceded by the named views and the views those need."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in VIEWS[name].needs:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    if not ordered:
        return body.strip()
    views = ",\n".join(f"{n} AS ({VIEWS[n].sql})" for n in ordered)
    return f"WITH {views}\n{body.strip()}"


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query under a name, with the SQL that gives the same rows."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = with_views(sql, *views)
        return function

    return register


def rounded(*names: str, digits: int = 6) -> list[Column]:
    """Columns rounded for comparison."""
    return [F.round(F.col(n), digits).alias(n) for n in names]
