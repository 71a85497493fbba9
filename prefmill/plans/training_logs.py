"""Training-log series by plot title, for one run or several."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from prefmill.operators.series import (
    MULTI_RUN_GROUPS,
    RUN_GROUPS,
    missing_tags,
    multi_run_series,
    run_series,
    wanted_tags,
)
from prefmill.sources.readers import read_scalar_logs


def training_series(
    spark: SparkSession,
    path: str | Sequence[str],
    registry: DataFrame | None = None,
    groups: Mapping[str, Sequence[str]] | None = None,
    kind: str = "parquet",
) -> dict[str, DataFrame]:
    """Sorted series, and the wanted tags that a log file lacks. ``registry`` (run, name) picks runs."""
    groups = groups or (RUN_GROUPS if registry is None else MULTI_RUN_GROUPS)
    points = read_scalar_logs(spark, path, wanted_tags(groups), kind)
    series = run_series(points, groups) if registry is None else multi_run_series(points, registry, groups)
    return {"series": series, "missing": missing_tags(read_scalar_logs(spark, path, None, kind), groups)}
