"""Taxonomy rows to task combinations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefmill.operators.selection import nth_row

#: Names that one list of a taxonomy may hold.
MOST_NAMES = 100_000


def taxonomy_from_table(
    df: DataFrame, domain: str, task: str, code_form: str, library: str | None = None, limit: int = MOST_NAMES
) -> DataFrame:
    """Taxonomy rows from a flat table that names one domain, task and code form per row.

    The table is first cut down to its distinct names, and libraries are gathered apart from tasks, so the
    lists hold each name once. Domains and tasks come in name order. A domain is one row; one with more
    than ``limit`` libraries or tasks, or a task with more code forms, is no taxonomy and fails the job.
    """
    library_col = F.col(library) if library else F.lit(None).cast("string")

    def names(*columns: Column) -> DataFrame:
        return df.select(F.col(domain).alias("domain"), *columns).distinct()

    forms = names(F.col(task).alias("name"), F.col(code_form).alias("form")).groupBy("domain", "name")
    tasks = forms.agg(F.array_sort(F.collect_list("form")).alias("code_forms"), F.count(F.lit(1)).alias("n"))
    tasks = tasks.filter(_at_most("n", limit, "code forms of a task"))
    listed = tasks.groupBy("domain").agg(F.array_sort(F.collect_list(F.struct("name", "code_forms"))).alias("tasks"), F.count(F.lit(1)).alias("n"))
    listed = listed.filter(_at_most("n", limit, "tasks of a domain")).select(F.col("domain").alias("_domain"), "tasks")
    libraries = names(library_col.alias("library")).groupBy("domain").agg(
        F.array_sort(F.collect_list("library")).alias("libraries"), F.count("library").alias("n")
    )
    libraries = libraries.filter(_at_most("n", limit, "libraries of a domain"))
    return libraries.join(listed, F.col("domain").eqNullSafe(F.col("_domain"))).select("domain", "libraries", "tasks")


def _at_most(count: str, limit: int, what: str) -> Column:
    return F.assert_true(F.col(count) <= limit, f"more than {limit} {what}").isNull()


def combinations(taxonomy: DataFrame) -> DataFrame:
    """One row per task of each domain, with the domain's libraries and the task's code forms.

    Missing lists become empty and a missing task name becomes "". ``task_pos`` (and ``domain_pos``
    when the taxonomy has it) keep the order of the source.
    """
    empty = F.array().cast("array<string>")
    order = ["domain_pos"] if "domain_pos" in taxonomy.columns else []
    exploded = taxonomy.select(
        *order, "domain", F.coalesce("libraries", empty).alias("libraries"), F.posexplode("tasks").alias("task_pos", "t")
    )
    return exploded.select(
        *order,
        "task_pos",
        "domain",
        F.coalesce("t.name", F.lit("")).alias("task"),
        "libraries",
        F.coalesce("t.code_forms", empty).alias("code_form"),
    )


def combination_by_index(
    combos: DataFrame, index: int, order: Sequence[str] = ("domain_pos", "task_pos")
) -> DataFrame:
    """The combination at a zero-based place in the given order; no row when out of range."""
    return nth_row(combos, index, order)
