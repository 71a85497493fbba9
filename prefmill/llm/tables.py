"""Tables between steps, and hashes that do not change from run to run."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefmill.session import scratch_path

#: Texts go to Python in batches of at most so many bytes, however long one text is.
BATCH_BYTES = "8m"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by bytes, unless the user has done so."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in (None, str(2**63 - 1), str(2**31 - 1)):
        spark.conf.set(key, BATCH_BYTES)


def cut(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read back; its plan ends here, and lost executors lose nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session that holds inside the block only."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def narrow_batches(spark: SparkSession) -> AbstractContextManager[None]:
    """No bound by bytes inside the block, for rows of a few numbers: with one, Spark adds up a batch's bytes again for every row."""
    return _setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(2**31 - 1))


def cut_and_clear(df: DataFrame, name: str) -> DataFrame:
    """As :func:`cut`, packed tighter; the shuffle files behind the table are removed as soon as it is written."""
    path = scratch_path(df.sparkSession, name)
    with _setting(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(df: DataFrame, name: str) -> str:
    """A column name like this one that the table does not have."""
    while name in df.columns:
        name += "_"
    return name


def fold(doc_id: Column, folds: int) -> Column:
    """The remainder of the CRC-32 of the id as text; null for a null id."""
    return F.crc32(doc_id.cast("string")) % F.lit(folds)


def unit(*parts: Column, seed: int) -> Column:
    """A number from 0 up to 1 that the parts and the seed decide."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11).cast("double") / F.lit(float(1 << 53))


def map_batches(
    df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: T.StructType | str
) -> DataFrame:
    """One output batch for each input batch, inside the tasks."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield function(batch)

    return df.mapInArrow(run, schema)
