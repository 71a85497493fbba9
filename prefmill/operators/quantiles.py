"""Exact quantiles and box summaries that never bring one group into one task.

``percentile`` keeps every distinct value of a group in one buffer. Here a mergeable sketch first gives, for
each group and wanted rank, two values that the rank lies between for certain: the sketch's error is bounded,
and it is asked for ranks further apart than that. All values outside such brackets are then only counted,
a few numbers per group; the values inside are counted one by one and put in order. So a task orders a small
share of the distinct values of a group, and the ranks are exact. A rank outside its bracket would fail the job.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Groups of up to so many rows are one bracket.
WHOLE = 100_000
#: The sketch keeps at least so many ranks of a group.
ACCURACY = 10_000
#: Tasks that the rows of one group are looked up in, when they have to move.
SALTS = 8
#: Groups that go to every task.
FEW = 10_000

# Quartiles and whisker reach of a box summary.
QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
WHISKER = 1.5


def group_values(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Group columns and the value as ``v``; nulls are left out."""
    return df.select(*by, F.col(value).alias("v")).filter(F.col("v").isNotNull())


def join_groups(rows: DataFrame, groups: DataFrame, by: Sequence[str], few: bool = False) -> DataFrame:
    """Rows with what is known of their group, where null is a group like any other; rows of no known group get nulls.

    ``few`` groups are broadcast. Of more, or an unknown number, rows move by group and a salt from their value, so that no
    group's rows all go to one task, unless Spark measures the groups to be small. A left join never broadcasts the
    rows: files of repeated values measure little, however many rows they hold.
    """
    known = groups.select(*[F.col(c).alias(f"_r_{c}") if c in by else F.col(c) for c in groups.columns])
    condition = F.lit(True)
    if few:
        known = F.broadcast(known)
    else:
        known = known.withColumn("_look", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
        condition = F.col("_salt") == F.col("_look")
    for c in by:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return rows.join(known, condition, "left").drop("_salt", "_look", *[f"_r_{c}" for c in by])


def _sizes(values: DataFrame, by: Sequence[str]) -> tuple[int, bool]:
    """Ranks for the sketch, the square root of the largest group, so neither sketch nor brackets grow faster; and whether
    groups are few."""
    counted = values.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    largest, groups = counted.agg(F.max("n"), F.count(F.lit(1))).first()
    return max(ACCURACY, isqrt(largest or 0)), groups <= FEW


def _brackets(values: DataFrame, by: Sequence[str], probs: Sequence[float], accuracy: int, whole: int) -> DataFrame:
    """For each group its number of rows (``_total``) and the ends of the bracket of each rank (``_low``, ``_high``)."""
    reach = 4 / accuracy + 2 / max(1, whole)
    ends = [max(0.0, p - reach) for p in probs] + [min(1.0, p + reach) for p in probs]
    sketched = values.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_total"),
        F.min("v").alias("_min"),
        F.max("v").alias("_max"),
        F.percentile_approx("v", ends, accuracy).alias("_ends"),
    )
    small = F.col("_total") <= whole
    low = F.array(*[F.when(small | F.lit(p <= reach), F.col("_min")).otherwise(F.get("_ends", F.lit(i))) for i, p in enumerate(probs)])
    high = F.array(
        *[F.when(small | F.lit(p >= 1 - reach), F.col("_max")).otherwise(F.get("_ends", F.lit(len(probs) + i))) for i, p in enumerate(probs)]
    )
    return sketched.select(*by, "_total", low.alias("_low"), high.alias("_high"))


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def exact_quantiles(
    df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float], accuracy: int | None = None, whole: int = WHOLE,
    brackets: DataFrame | None = None, few: bool | None = None,
) -> DataFrame:
    """One column per named probability for each group, with linear interpolation between neighbouring values.

    The table is read three times (its largest group is counted, sketch, ranks), so save what is costly to make. Given
    ``brackets`` (such as those of :mod:`prefmill.operators.sketches`) it is read once. ``few`` tells that groups are known to be.
    """
    values = group_values(df, by, value)
    wanted = list(probs.values())
    if brackets is None:
        if accuracy is None:
            accuracy, few = _sizes(values, by)
        brackets = _brackets(values, by, wanted, accuracy, whole)
    placed = join_groups(values, brackets, by, bool(few))
    places = range(len(wanted))
    inside = _any([F.col("v").between(F.get("_low", F.lit(i)), F.get("_high", F.lit(i))) for i in places])
    above = reduce(lambda a, b: a + b, [(F.get("_high", F.lit(i)) < F.col("v")).cast("int") for i in places])
    # Values outside lie in runs between brackets; a run is told by the brackets below it.
    runs = placed.groupBy(*by, "_total", F.when(inside, F.col("v")).alias("_value"), F.when(~inside, above).alias("_run"))
    counted = runs.agg(F.count(F.lit(1)).alias("_n"), F.min("v").alias("_place"))
    order = Window.partitionBy(*by).orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("_first", F.sum("_n").over(order) - F.col("_n")).filter("_total IS NOT NULL")

    def at(place: Column) -> Column:
        holds = (place >= F.col("_first")) & (place < F.col("_first") + F.col("_n"))
        return F.max(F.when(holds, F.coalesce("_value", F.raise_error(F.lit("a rank lies outside its bracket")).cast("double"))))

    def quantile(p: float) -> Column:
        place = F.lit(p) * (F.col("_total") - 1)
        low, high = at(F.floor(place)), at(F.ceil(place))
        return low + (high - low) * F.max(place - F.floor(place))

    return ranked.groupBy(*by).agg(*[quantile(p).alias(name) for name, p in probs.items()])


def box_summary(df: DataFrame, by: Sequence[str], value: str, accuracy: int | None = None, whole: int = WHOLE) -> DataFrame:
    """Quartiles and whiskers per group; whiskers end at the outermost value within 1.5 box heights."""
    values = group_values(df, by, value)
    ranks, few = _sizes(values, by)
    boxes = exact_quantiles(df, by, value, QUARTILES, accuracy or ranks, whole, few=few)
    reach = F.lit(WHISKER) * (F.col("q3") - F.col("q1"))
    inside = F.col("v").between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        join_groups(values, boxes, by, few)
        .groupBy(*by, *QUARTILES)
        .agg(
            F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
            F.count(F.lit(1)).alias("n_values"),
        )
    )
