"""Model answers that outlive a failed run: a journal of requests.

A task writes the answers of every batch as soon as it has them, to a file of its own that gets its name when it is
whole. So what was answered before a job failed, or before an executor was lost, is there for the next run, which
asks only for requests without an answer. A request is told by its key and its prompt: a changed prompt is asked
again, and so is one that failed. Two attempts of a task may answer a request twice; the first file by name counts, in every reading.

The journal's folder must be one that all executors reach (a path or an address that Arrow's file systems know).
"""

from __future__ import annotations

import io
import sys
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import parquet
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefmill.operators.batch import Loader, _apply
from prefmill.session import exists

ENTRIES = "request string, prompt_hash string, answer string, error string"


def _entry_file(path: str, table: pa.Table) -> None:
    """A new file of the journal, whole or not at all."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    system.create_dir(root, recursive=True)
    mark, packed = uuid.uuid4().hex, io.BytesIO()
    parquet.write_table(table, packed)
    with system.open_output_stream(f"{root}/_writing-{mark}") as file:
        file.write(packed.getvalue())
    system.move(f"{root}/_writing-{mark}", f"{root}/answers-{mark}.parquet")


def entries(spark: SparkSession, path: str) -> DataFrame:
    """All entries of a journal, failed ones included."""
    if not exists(spark, f"{path}/answers-*.parquet"):
        return spark.createDataFrame([], f"{ENTRIES}, file string")
    return spark.read.schema(ENTRIES).parquet(f"{path}/answers-*.parquet").withColumn("file", F.col("_metadata.file_name"))


def answers(spark: SparkSession, path: str) -> DataFrame:
    """One answer for each request and prompt that has one; else its first error."""
    first = F.min(F.struct(F.col("error").isNotNull().alias("failed"), "file", "answer", "error")).alias("e")
    return entries(spark, path).groupBy("request", "prompt_hash").agg(first).select("request", "prompt_hash", "e.answer", "e.error")


def _known(key: str, prompt: str) -> list[Column]:
    return [F.col(key).cast("string").alias("request"), F.md5(F.col(prompt)).alias("prompt_hash")]


def unanswered(df: DataFrame, prompt: str, path: str, key: str) -> DataFrame:
    """Different requests (request, prompt_hash, prompt) without an answer; null prompts are not asked."""
    asked = df.filter(F.assert_true(F.col(key).isNotNull(), "a request has no key").isNull()).select(*_known(key, prompt), F.col(prompt).alias("prompt"))
    done = entries(df.sparkSession, path).filter("error IS NULL").select("request", "prompt_hash")
    return asked.filter("prompt IS NOT NULL").join(done, ["request", "prompt_hash"], "left_anti").dropDuplicates(["request", "prompt_hash"])


def ask(df: DataFrame, prompt: str, loader: Loader, path: str, key: str, partitions: int | None = None) -> None:
    """Send the unanswered prompts and add what comes back to the journal, batch by batch."""
    todo = unanswered(df, prompt, path, key)
    # A file for each batch that a function gets: the batch size is the session's ``maxRecordsPerBatch``.
    todo = todo.repartition(partitions) if partitions else todo

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = None
        for batch in batches:
            if batch.num_rows:
                function = function or loader()
                found, errors = _apply(function, batch.column(2).to_pylist())
                columns = [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(errors, pa.string())]
                _entry_file(path, pa.table(columns, names=[f.split()[0] for f in ENTRIES.split(", ")]))
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    todo.mapInArrow(run, "n long").agg(F.sum("n")).collect()


def generate_resumable(
    df: DataFrame, prompt: str, loader: Loader, path: str, key: str, into: str = "response", partitions: int | None = None
) -> DataFrame:
    """``generate_batch`` by way of a journal: a repeated call asks only for what has no answer."""
    ask(df, prompt, loader, path, key, partitions)
    found = answers(df.sparkSession, path).select(F.col("request").alias("_request"), F.col("prompt_hash").alias("_hash"), F.col("answer").alias(into), "error")
    request, hashed = _known(key, prompt)
    bare = df.drop(into, "error")
    return bare.join(found, (F.col("_request") == request) & (F.col("_hash") == hashed), "left").drop("_request", "_hash")


# The workers get these functions by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
