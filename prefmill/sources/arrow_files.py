"""Datasets saved as Arrow stream files (``data-*.arrow``), one folder per split or none."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from prefmill import schemas

# Fixed value: names of the data files of a saved dataset.
DATA_FILES = "data-*.arrow"


def arrow_files(spark: SparkSession, path: str, pattern: str = DATA_FILES) -> DataFrame:
    """The names of the data files below a path, in a column ``path``."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    return listed.load(path).select("path")


def read_arrow(
    spark: SparkSession, path: str, schema: T.StructType = schemas.PAIR, split: str | None = None, file: str | None = None
) -> DataFrame:
    """Rows of a saved dataset with a declared schema; columns are taken by name, missing ones are null.

    ``split`` picks the folder of one split; ``file`` names a column for the file of each row. Only file
    names are listed on the driver's side of the job; each task streams the batches of its files, so no
    file is held whole.
    """
    return rows_of(arrow_files(spark, f"{path.rstrip('/')}/{split}" if split else path), schema, file)


def rows_of(files: DataFrame, schema: T.StructType, file: str | None = None) -> DataFrame:
    """Rows of the listed files."""
    target = to_arrow_schema(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with opened(name) as source:
                    for part in pa.ipc.open_stream(source):
                        out = _shaped(part, target)
                        yield out.append_column(file, pa.array([name] * out.num_rows, pa.string())) if file else out

    return files.select("path").mapInArrow(rows, schema if file is None else T.StructType([*schema.fields, T.StructField(file, T.StringType())]))


def opened(name: str):
    """A listed file as a stream that can seek. Listed names are plain, not encoded as URIs are."""
    system, place = _place(name)
    return system.open_input_file(place)


def _place(name: str):
    """The file system of a name and the path in it."""
    from pyarrow import fs

    scheme, colon, rest = name.partition(":")
    if not colon or scheme == "file":
        return fs.LocalFileSystem(), "/" + (rest if colon else name).lstrip("/")
    return fs.FileSystem.from_uri(as_uri(name))


def write_arrow(df: DataFrame, path: str, by: str) -> None:
    """Save a dataset as Arrow stream files, one folder per value of a column (``path/value/data-*.arrow``).

    A task writes its file of a folder under another name and renames it when it is whole. The name is that of the
    partition, so a task that is run again replaces its own file.
    """
    schema = T.StructType([f for f in df.schema.fields if f.name != by])
    at, target = df.columns.index(by), to_arrow_schema(schema)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        system, root = _place(path)
        name, draft = f"data-{task.partitionId():05d}.arrow", f"_draft-{task.taskAttemptId()}"
        open_files: dict[str, tuple] = {}
        for batch in batches:
            values = batch.column(at).to_pylist()
            rows = batch.remove_column(at)
            for value in dict.fromkeys(values):
                if value not in open_files:
                    system.create_dir(f"{root}/{value}", recursive=True)
                    sink = system.open_output_stream(f"{root}/{value}/{draft}")
                    open_files[value] = (sink, pa.ipc.new_stream(sink, target))
                open_files[value][1].write_batch(rows.filter(pa.array([v == value for v in values])).cast(target))
        for value, (sink, writer) in open_files.items():
            writer.close()
            sink.close()
            system.move(f"{root}/{value}/{draft}", f"{root}/{value}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([str(v) for v in open_files], pa.string())], names=["folder"])

    df.repartition(F.col(by)).mapInArrow(write, "folder string").count()


def as_uri(name: str) -> str:
    """A listed file name as a URI that Arrow knows; the schemes that Spark has for one object store are one there."""
    scheme, _, rest = name.partition(":")
    return ("s3" if scheme in ("s3a", "s3n") else scheme) + ":" + quote(rest, safe="/:@")


def _shaped(part: pa.RecordBatch, target: pa.Schema) -> pa.RecordBatch:
    """A batch with the columns of the target schema."""
    columns = []
    for field in target:
        place = part.schema.get_field_index(field.name)
        column = pa.nulls(part.num_rows, field.type) if place < 0 else part.column(place).cast(field.type)
        columns.append(column)
    return pa.RecordBatch.from_arrays(columns, schema=target)


# The workers get the reader by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
