"""Readers."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyarrow import parquet
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefmill import schemas
from prefmill.operators.selection import row_hash
from prefmill.session import exists, found_at, saved
from prefmill.sources.arrow_files import DATA_FILES, arrow_files, opened, read_arrow, rows_of
from prefmill.sources.event_files import read_event_files

# Folder names of generated shards and the split names that are tried.
SHARD_GLOB = "gen_data_[0-9]*/dataset"
SHARD_NUMBER = r"gen_data_(\d+)/"
TRAIN, TEST = "train", "test"


def _taxonomy_rows(config: Mapping) -> list[dict]:
    """Rows of one parsed taxonomy file."""
    rows = []
    for pos, (domain, entry) in enumerate(config.items()):
        entry = entry or {}
        tasks = [
            {"name": t.get("name", ""), "code_forms": t.get("code_forms") or []} for t in entry.get("tasks") or []
        ]
        rows.append(
            {"domain_pos": pos, "domain": str(domain), "libraries": entry.get("libraries") or [], "tasks": tasks}
        )
    return rows


def read_taxonomy(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Taxonomy rows from a YAML or JSON file (domain -> libraries and tasks), or from parquet rows.

    ``kind`` is taken from the file name when not given. YAML needs PyYAML on the workers.
    """
    kind = kind or path.rstrip("/").rsplit(".", 1)[-1]
    if kind == "parquet":
        return spark.read.schema(schemas.TAXONOMY).parquet(path)
    if kind == "json":
        text = spark.read.text(path, wholetext=True)
        entries = F.from_json("value", schemas.TAXONOMY_MAP)
        rows = text.select(F.posexplode(entries).alias("domain_pos", "domain", "e"))
        return rows.select("domain_pos", "domain", "e.libraries", "e.tasks")
    if kind in ("yaml", "yml"):

        names = schemas.TAXONOMY.names

        def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import yaml

            for batch in batches:
                for text in batch["value"]:
                    yield pd.DataFrame(_taxonomy_rows(yaml.safe_load(text) or {}), columns=names)

        return spark.read.text(path, wholetext=True).mapInPandas(parse, schemas.TAXONOMY)
    raise ValueError(f"unknown taxonomy format {kind!r}")


def read_pairs(spark: SparkSession, path: str, kind: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """A saved dataset: parquet, JSON lines or Arrow stream files.

    JSON and Arrow are read with the pair schema unless another one is given.
    """
    if kind == "parquet":
        reader = spark.read.schema(schema) if schema else spark.read
        return reader.parquet(path)
    if kind == "json":
        return spark.read.schema(schema or schemas.PAIR).json(path)
    if kind == "arrow":
        return read_arrow(spark, path, schema or schemas.PAIR)
    raise ValueError(f"unknown dataset format {kind!r}")


def has_split(df: DataFrame, name: str) -> bool:
    """Whether a dataset has rows of a split; looks into the folder of that split only."""
    return not df.filter(F.col("split") == name).select("split").isEmpty()


def _split_address(address: str) -> tuple[str, str | None]:
    head, _, tail = address.rpartition(":")
    if head and "/" not in tail and "\\" not in tail:
        return head, tail
    return address, None


def read_split(spark: SparkSession, address: str, split: str | None = None, kind: str = "parquet") -> DataFrame:
    """One split of a saved dataset: the one of a ``path:split`` address or argument, else ``train``
    when there is one, else everything.

    Splits are a partition column, so only the folder of the wanted split is read.
    """
    path, named = _split_address(address)
    wanted = split or named
    if kind == "arrow":
        return _read_arrow_split(spark, path, wanted)
    df = read_pairs(spark, path, kind)
    if "split" not in df.columns:
        if wanted:
            raise ValueError(f"{path} has no splits, so no split {wanted!r}")
        return df
    if wanted and not has_split(df, wanted):
        raise ValueError(f"no split {wanted!r} in {path}")
    if not wanted and not has_split(df, TRAIN):
        return df
    return df.filter(F.col("split") == (wanted or TRAIN))


def _read_arrow_split(spark: SparkSession, path: str, wanted: str | None) -> DataFrame:
    """The same for Arrow files, whose splits are plain folders."""
    if exists(spark, f"{path.rstrip('/')}/{wanted or TRAIN}"):
        return read_arrow(spark, path, split=wanted or TRAIN)
    if wanted:
        raise ValueError(f"no split {wanted!r} in {path}")
    return read_arrow(spark, path)


def eval_split_pick(df: DataFrame) -> DataFrame:
    """The ``test`` split when there is one, else ``train``."""
    return df.filter(F.col("split") == (TEST if has_split(df, TEST) else TRAIN))


def fuse_shards(
    spark: SparkSession,
    base: str,
    pattern: str = SHARD_GLOB,
    number: str = SHARD_NUMBER,
    kind: str = "parquet",
    schema: T.StructType | None = None,
    skip_unreadable: bool = False,
) -> DataFrame:
    """All generated shards below ``base`` as one dataset with their number in ``shard_no``.

    A file that cannot be read fails the job. With ``skip_unreadable`` every file is first decoded from end
    to end, and a shard with an unreadable file is left out whole; :func:`unread_shards` names it. Columns
    are matched by name. Without a declared schema the columns of all parquet shards are merged, which
    opens every footer; Arrow shards are taken as pairs.
    """
    root = f"{base.rstrip('/')}/{pattern}"
    files = _shard_files(spark, root, number, kind)
    if skip_unreadable:
        bad = _decoded(files, kind).filter("error IS NOT NULL").select("shard_no").distinct()
        files = saved(files.join(bad, files["shard_no"].eqNullSafe(bad["shard_no"]), "left_anti"), "shards")
    if kind == "arrow":
        df = rows_of(files, schema or schemas.PAIR, "_file")
        return df.withColumn("shard_no", _number_in("_file", number)).drop("_file")
    # Folders are as many as shards; the files in them are listed by the executors.
    folders = [root] if not skip_unreadable else [r["f"] for r in files.select(F.regexp_replace("path", "/[^/]*$", "").alias("f")).distinct().collect()]
    if not folders:
        return spark.createDataFrame([], T.StructType([*(schema or T.StructType()).fields, T.StructField("shard_no", T.IntegerType())]))
    reader = spark.read.schema(schema) if schema else spark.read.option("mergeSchema", "true")
    return reader.parquet(*folders).withColumn("shard_no", _number_in("_metadata.file_path", number))


def _number_in(path: str, number: str):
    return F.regexp_extract(F.col(path), number, 1).cast("int")


def _shard_files(spark: SparkSession, root: str, number: str, kind: str) -> DataFrame:
    if kind not in ("parquet", "arrow"):
        raise ValueError(f"unknown dataset format {kind!r}")
    pattern = "*.parquet" if kind == "parquet" else DATA_FILES
    return arrow_files(spark, root, pattern).select("path", _number_in("path", number).alias("shard_no"))


def _decoded(files: DataFrame, kind: str) -> DataFrame:
    """Each file with the number of its rows and what is wrong with it; null when nothing is."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_read_through(name, kind) for name in batch.column(0).to_pylist()]
            rows, errors = pa.array([n for n, _ in found], pa.int64()), pa.array([e for _, e in found], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rows, errors], names=["path", "shard_no", "n_rows", "error"])

    # A task each: files are few against their bytes.
    spread = files.repartition(F.col("path"))
    return spread.mapInArrow(check, "path string, shard_no int, n_rows long, error string")


def _read_through(name: str, kind: str) -> tuple[int, str | None]:
    """Rows of a file, decoded batch by batch, and the first error or a difference to the number it declares."""
    rows = 0
    try:
        with opened(name) as source:
            if kind == "arrow":
                for part in pa.ipc.open_stream(source):
                    part.validate(full=True)
                    rows += part.num_rows
                return rows, None
            file = parquet.ParquetFile(source, page_checksum_verification=True)
            for part in file.iter_batches():
                rows += part.num_rows
            declared = file.metadata.num_rows
            return rows, None if rows == declared else f"{rows} of {declared} rows"
    except (pa.ArrowException, OSError, EOFError, UnicodeDecodeError) as error:
        return rows, f"{type(error).__name__}: {error}"[:500]


def unread_shards(
    spark: SparkSession, base: str, pattern: str = SHARD_GLOB, number: str = SHARD_NUMBER, kind: str = "parquet"
) -> DataFrame:
    """The report on what ``skip_unreadable`` leaves out: unreadable files with shard number, rows decoded and error."""
    files = _shard_files(spark, f"{base.rstrip('/')}/{pattern}", number, kind)
    bad = _decoded(files, kind).filter("error IS NOT NULL")
    return bad.select(F.col("path").alias("file"), "shard_no", "n_rows", "error")


def shard_sort(df: DataFrame, *more: str) -> DataFrame:
    """Rows in numeric order of their shard, and in it by the further columns or else by a hash of the row.

    The hash lets one large shard be sorted by several tasks.
    """
    return df.orderBy(F.col("shard_no").cast("int"), *(more or [row_hash(df)]))


def fuse_union(parts: Sequence[DataFrame]) -> DataFrame:
    """Datasets one after the other, matched by column name; duplicates stay."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def read_responses(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Saved stage results (JSON lines)."""
    return spark.read.schema(schema).json(path)


#: Paths looked up at once.
_LOOK_UPS = 16


def _summary_places(spark: SparkSession, paths: Mapping[str, tuple[str, str]]) -> DataFrame:
    """The registry with the full name of what lies at each path in ``at``; null if nothing does."""
    with ThreadPoolExecutor(_LOOK_UPS) as pool:
        places = pool.map(lambda path: found_at(spark, path) or [None], paths)
        rows = [(path, at, *info) for (path, info), found in zip(paths.items(), places, strict=True) for at in found]
    registry = spark.createDataFrame(rows, "path string, at string, model string, type string")
    return registry.withColumn("at", _one_slash(F.col("at")))


def _one_slash(place: Column) -> Column:
    return F.regexp_replace(place, "^file:/+", "file:/")


def _file_name() -> Column:
    """The name of a row's file. Listed names are encoded, but a plus sign is one."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def _summaries(spark: SparkSession, registry: DataFrame) -> DataFrame:
    """The summaries at all registered places, read at once; each has the ``path``, ``model`` and ``type`` of its own place."""
    given = [r["path"] for r in registry.filter("at IS NOT NULL").select("path").distinct().collect()]
    if not given:
        return spark.createDataFrame([], schemas.EVAL_RESULTS).withColumn("path", F.lit(""))
    reader = spark.read.schema(schemas.EVAL_SUMMARY).option("recursiveFileLookup", "true")
    file = _one_slash(_file_name())
    # A summary is registered by its own name or by that of its folder.
    names = F.explode(F.array(file, F.regexp_replace(file, "/[^/]*$", "")))
    rows = reader.json(given, multiLine=True, mode="PERMISSIVE").filter(F.col("metrics").isNotNull()).select("*", names.alias("at"))
    return rows.join(registry, "at").select("path", "model", "type", "metrics", "prompt_type_metrics")


def read_eval_results(spark: SparkSession, paths: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Evaluation summaries of models as ``model``, ``type``, ``metrics``, ``prompt_type_metrics``.

    ``paths`` maps a summary folder or file to (model name, model type). All are read in one scan and joined to their
    models by file name, so the plan does not grow with the models. What is not there, cannot be read as JSON or has
    no ``metrics`` member is left out; :func:`unread_results` names it.
    """
    empty = F.create_map().cast(schemas.EVAL_SUMMARY["prompt_type_metrics"].dataType)
    rows = _summaries(spark, _summary_places(spark, paths))
    return rows.select("model", "type", "metrics", F.coalesce("prompt_type_metrics", empty).alias("prompt_type_metrics"))


def unread_results(spark: SparkSession, paths: Mapping[str, tuple[str, str]]) -> DataFrame:
    """The summaries that give no row, as ``path``, ``model`` and ``reason``."""
    registry = _summary_places(spark, paths)
    given = registry.groupBy("path", "model").agg(F.count("at").alias("n"))
    unread = given.join(_summaries(spark, registry).select("path"), "path", "left_anti")
    return unread.select("path", "model", F.when(F.col("n") == 0, "missing").otherwise("no metrics").alias("reason"))


def read_scalar_logs(
    spark: SparkSession, path: str | Sequence[str], tags: Sequence[str] | None = None, kind: str = "parquet"
) -> DataFrame:
    """Scalar points of training logs (parquet, JSON, CSV or binary event files), cut to the wanted tags at the scan.

    Points without a ``run`` get the name of the folder their file lies in, those without an ``event_file``
    the name of the file. Paths that are not there are left out; :func:`missing_paths` names them.
    """
    if kind not in ("parquet", "json", "csv", "events"):
        raise ValueError(f"unknown log format {kind!r}")
    given = [path] if isinstance(path, str) else list(path)
    there = [p for p in given if exists(spark, p)]
    if not there:
        return spark.createDataFrame([], schemas.SCALARS)
    if kind == "events":
        return reduce(DataFrame.unionByName, [read_event_files(spark, p, tags) for p in there])
    reader = spark.read.schema(schemas.SCALARS).format(kind)
    points = reader.option("header", "true").load(there)
    if tags is not None:
        points = points.filter(F.col("tag").isin(*tags))
    parts = F.split(_file_name(), "/")
    return points.select(
        F.coalesce("run", F.element_at(parts, -2)).alias("run"), F.coalesce("event_file", F.element_at(parts, -1)).alias("event_file"), "tag", "step", "value"
    )


def missing_paths(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The paths that are not there."""
    return [p for p in paths if not exists(spark, p)]


def unscored_only(pairs: DataFrame, scored: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key has no result yet. A row with a null in its key could never be found again and fails the job.

    Only the key columns of the results are read. When both tables are bucketed by the key with equal
    counts, the join moves no row at all; see :func:`prefmill.sources.writers.write_bucketed`.
    """
    whole = F.lit(True)
    for name in key:
        whole = whole & F.col(name).isNotNull()
    checked = pairs.filter(F.assert_true(whole, f"a row has a null in its key {list(key)}").isNull())
    return checked.join(scored.select(*key), list(key), "left_anti")


# The workers get the taxonomy parser by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
