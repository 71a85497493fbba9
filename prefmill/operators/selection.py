"""Row selection: first rows, seeded samples and splits. Order always comes from key columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from prefmill.session import saved

#: Default share of rows that go to the test side.
TEST_SHARE = 0.1

#: Hex digits by which one pass over the hashes narrows down a cut.
STEP_DIGITS = 3

_SPLIT_BITS = 32


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns that can be hashed, which puts rows with equal keys in order."""
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    return F.xxhash64(*plain) if plain else F.lit(0).cast("long")


def _key_at(df: DataFrame, order: Sequence[str], index: int) -> tuple[Row, int] | None:
    """Key and row hash at a zero-based place, and how many rows come before the first that has both; None beyond the end.

    Only keys are sorted, spread over tasks by range. Numbers of rows per task tell which task holds the place.
    """
    keys = df.select(*order, row_hash(df).alias("_row"))
    sort = [*[F.col(c).asc_nulls_first() for c in order], F.col("_row")]
    placed = saved(keys.orderBy(*sort).withColumn("_at", F.monotonically_increasing_id()), "places")
    task = F.shiftright("_at", 33)
    sizes = placed.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("n")).orderBy("task").collect()
    before = 0
    for size in sizes:
        if index < before + size["n"]:
            found = placed.filter(F.col("_at") == (size["task"] << 33) + index - before).drop("_at").first()
            first = placed.filter(_same(found, [*order, "_row"])).agg(F.min("_at").alias("m")).first()["m"]
            earlier = sum(s["n"] for s in sizes if s["task"] < first >> 33)
            return found, earlier + (first & ((1 << 33) - 1))
        before += size["n"]
    return None


def _same(key: Row, names: Sequence[str]) -> Column:
    condition = F.lit(True)
    for name in names:
        condition = condition & F.col(name).eqNullSafe(F.lit(key[name]))
    return condition


def _earlier(key: Row, names: Sequence[str]) -> Column:
    """Whether a row comes before a key; nulls come first."""
    condition = F.lit(False)
    for name in reversed(names):
        here, there = F.col(name), F.lit(key[name])
        less = F.lit(False) if key[name] is None else here.isNull() | F.coalesce(here < there, F.lit(False))
        condition = less | (here.eqNullSafe(there) & condition)
    return condition


def first_n(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The first ``n`` rows by key, all when there are fewer; equal keys go by a hash of the row.

    The key of the n-th row is found first, then the rows are filtered where they lie: no more than rows that
    are equal throughout are ever counted out in one place.
    """
    if n <= 0:
        return df.limit(0)
    last = _key_at(df, order, n - 1)
    if last is None:
        return df
    key, before = last
    marked = df.withColumn("_row", row_hash(df))
    names = [*order, "_row"]
    ends = marked.filter(_same(key, names)).limit(n - before)
    return marked.filter(_earlier(key, names)).unionByName(ends).drop("_row")


def nth_row(df: DataFrame, index: int, order: Sequence[str]) -> DataFrame:
    """The row at a zero-based place by key; no row when out of range."""
    found = _key_at(df, order, index) if index >= 0 else None
    if found is None:
        return df.limit(0)
    return df.withColumn("_row", row_hash(df)).filter(_same(found[0], [*order, "_row"])).limit(1).drop("_row")


def seeded_hash(seed: int, key: Sequence[str]) -> Column:
    """A hash of seed and key as hex digits, equal on every run and machine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))


def sample_n(df: DataFrame, n: int | None, key: Sequence[str], seed: int = 0) -> DataFrame:
    """``n`` rows without replacement; all rows when ``n`` is 0, None or more than there are.

    The sample is the rows with the smallest seeded hashes. Passes over the keys narrow down the hash of the
    n-th row, three hex digits each, from at most 4,096 counts; then the rows are filtered where they lie.
    Rows with equal keys have equal hashes; if the cut falls among them, those with smaller row hashes are in.
    """
    if not n:
        return df
    hashed = df.withColumn("_hash", seeded_hash(seed, key))
    prefix, before = "", 0
    while len(prefix) < 32:
        size = len(prefix) + min(STEP_DIGITS, 32 - len(prefix))
        counts = (
            hashed.filter(F.col("_hash").startswith(prefix))
            .groupBy(F.substring("_hash", 1, size).alias("prefix"))
            .agg(F.count(F.lit(1)).alias("n"))
        )
        for part in sorted(counts.collect()):
            if before + part["n"] >= n:
                break
            before += part["n"]
        else:
            return df
        prefix = part["prefix"]
        if before + part["n"] == n:
            return hashed.filter(F.substring("_hash", 1, size) <= prefix).drop("_hash")
    ends = first_n(hashed.filter(F.col("_hash") == prefix).drop("_hash"), n - before, key)
    return hashed.filter(F.col("_hash") < prefix).drop("_hash").unionByName(ends)


def random_one(df: DataFrame, key: Sequence[str], seed: int = 0) -> DataFrame:
    """One row picked by the seed."""
    return sample_n(df, 1, key, seed)


def in_test_split(key: Sequence[str], share: float = TEST_SHARE, seed: int = 0) -> Column:
    """Whether a row belongs to the test side; decided by its key alone, so no row has to move."""
    limit = round(share * 2**_SPLIT_BITS)
    if limit <= 0:
        return F.lit(False)
    if limit >= 2**_SPLIT_BITS:
        return F.lit(True)
    return F.substring(seeded_hash(seed, key), 1, _SPLIT_BITS // 4) < F.lit(f"{limit:08x}")


def train_test_split(
    df: DataFrame, key: Sequence[str], share: float = TEST_SHARE, seed: int = 0
) -> DataFrame:
    """The rows with a ``split`` column, ``train`` or ``test``."""
    return df.withColumn("split", F.when(in_test_split(key, share, seed), "test").otherwise("train"))
