"""Scalar series of training logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefmill.operators.compare import join_registry
from prefmill.session import saved

# Plot titles and the log tags each one shows, for one run and for several runs.
RUN_GROUPS = {
    "Loss": ["train/loss", "eval/loss"],
    "Gradient Norm": ["train/grad_norm"],
    "Learning Rate": ["train/learning_rate"],
    "Rewards": ["train/rewards/chosen", "train/rewards/rejected", "eval/rewards/chosen", "eval/rewards/rejected"],
    "Reward Accuracies": ["train/rewards/accuracies", "eval/rewards/accuracies"],
    "Reward Margins": ["train/rewards/margins", "eval/rewards/margins"],
    "Log Probabilities": ["train/logps/chosen", "train/logps/rejected", "eval/logps/chosen", "eval/logps/rejected"],
    "Logits": ["train/logits/chosen", "train/logits/rejected", "eval/logits/chosen", "eval/logits/rejected"],
}
MULTI_RUN_GROUPS = {
    "Loss": ["train/loss", "eval/loss"],
    "Gradient Norm": ["train/grad_norm"],
    "Learning Rate": ["train/learning_rate"],
    "Rewards (Chosen)": ["train/rewards/chosen", "eval/rewards/chosen"],
    "Rewards (Rejected)": ["train/rewards/rejected", "eval/rewards/rejected"],
    "Reward Accuracies": ["train/rewards/accuracies", "eval/rewards/accuracies"],
    "Reward Margins": ["train/rewards/margins", "eval/rewards/margins"],
    "Log Probabilities": ["train/logps/chosen", "train/logps/rejected", "eval/logps/chosen", "eval/logps/rejected"],
    "Logits": ["train/logits/chosen", "train/logits/rejected", "eval/logits/chosen", "eval/logits/rejected"],
}


def wanted_tags(groups: Mapping[str, Sequence[str]]) -> list[str]:
    return sorted({tag for tags in groups.values() for tag in tags})


def keep_tags(points: DataFrame, groups: Mapping[str, Sequence[str]] = RUN_GROUPS) -> DataFrame:
    """Points of the wanted tags; a plain filter that reaches the scan."""
    return points.filter(F.col("tag").isin(*wanted_tags(groups)))


def missing_tags(points: DataFrame, groups: Mapping[str, Sequence[str]] = RUN_GROUPS) -> DataFrame:
    """Wanted tags that an event file lacks, one row per run, file and tag."""
    wanted = F.array(*[F.lit(t) for t in wanted_tags(groups)])
    found = points.groupBy("run", "event_file").agg(F.collect_set(F.when(F.col("tag").isin(*wanted_tags(groups)), F.col("tag"))).alias("found"))
    return found.select("run", "event_file", F.explode(F.array_except(wanted, "found")).alias("tag"))


def join_metric_groups(points: DataFrame, groups: Mapping[str, Sequence[str]] = RUN_GROUPS) -> DataFrame:
    """One row per point and plot title that shows its tag.

    The titles are constants of the plan, so they are looked up in a literal map and nothing is joined.
    """
    titles: dict[str, list[str]] = {}
    for title, tags in groups.items():
        for tag in tags:
            titles.setdefault(tag, []).append(title)
    entries = [x for tag, ts in titles.items() for x in (F.lit(tag), F.array(*[F.lit(t) for t in ts]))]
    return keep_tags(points, groups).withColumn("title", F.explode(F.try_element_at(F.create_map(*entries), F.col("tag"))))


def tag_split(tag: Column) -> Column:
    """``Train`` or ``Eval`` as the tag tells, else ""."""
    return F.when(tag.contains("train/"), "Train").when(tag.contains("eval/"), "Eval").otherwise("")


def tag_label(tag: Column) -> Column:
    """Last part of the tag."""
    return F.element_at(F.split(tag, "/"), -1)


def tag_parts(points: DataFrame) -> DataFrame:
    return points.withColumns({"split": tag_split(F.col("tag")), "label": tag_label(F.col("tag"))})


def series_sort(points: DataFrame, *more: str) -> DataFrame:
    """Points in order of run, tag and step over all event files; duplicates stay.

    A range sort: one very long series is cut over many tasks.
    """
    return points.orderBy("run", "tag", "step", "event_file", *more)


def series_index(points: DataFrame, by: Sequence[str] = ("run", "tag"), order: Sequence[str] = ("step", "event_file")) -> DataFrame:
    """Each point's place in its series, from 1, as ``series_index``; null keys are a series like any other.

    A segmented prefix sum: points are dealt by ranges of series and order (a hash of the whole point cuts ties) and saved in that order with
    their place in the range. Only counts, a row for each range and series in it, are gathered and summed up; a
    point's place is its place in the range plus the points of its series in earlier ranges. No task holds a series.
    """
    rest = F.xxhash64(*points.columns)
    dealt = points.repartitionByRange(*by, *order, rest).sortWithinPartitions(*by, *order, rest)
    dealt = saved(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33)), "ranges")
    counts = dealt.groupBy("_range", *by).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    counts = counts.select(F.col("_range").alias("_r"), *[F.col(c).alias(f"_r_{c}") for c in by], "_first", "_before")
    same = F.col("_range") == F.col("_r")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return dealt.join(counts, same).select(*points.columns, (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias("series_index"))


def series_union(parts: Sequence[DataFrame]) -> DataFrame:
    """The points of several event files as one table."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def run_series(points: DataFrame, groups: Mapping[str, Sequence[str]] = RUN_GROUPS, sort: bool = True) -> DataFrame:
    """Series of runs by plot title, with split and label of each line."""
    rows = tag_parts(join_metric_groups(points, groups))
    return series_sort(rows, "title") if sort else rows


def multi_run_series(
    points: DataFrame,
    registry: DataFrame,
    groups: Mapping[str, Sequence[str]] = MULTI_RUN_GROUPS,
    sort: bool = True,
) -> DataFrame:
    """Series of the registered runs (``run``, ``name``); a run without points leaves no row."""
    rows = join_registry(run_series(points, groups, sort=False), registry, "run")
    return series_sort(rows, "title") if sort else rows
