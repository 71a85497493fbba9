"""Results kept by key and content, so that a changed text is scored again and an unchanged one never.

Below a ledger's path lie ``rows``, the results of each run by bucket of the key, with a hash of what was scored; and
``filters``, a Bloom filter for each run and bucket. Rows to be scored first meet the filters. Where a filter says no, the
row was not in that run's bucket for certain; only files of buckets where one says perhaps are read, for an exact join.
A text changed back to what it was finds its earlier result.

A filter is built in the tasks: a row's bit positions are OR-ed by word before anything moves, and words are merged by OR.
Filters go round in broadcasts of at most ``FILTER_BYTES`` (a single bucket's filter may be larger). A run whose filters
were not finished has all its files read. Results and filters appear as a whole or not at all; one job at a time may
write to a ledger.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefmill.session import exists, saved

BUCKETS = 64
#: Bits a row, and positions set by each: about one false answer in a hundred.
BITS, PROBES = 10, 7
FILTER_BYTES = 64 << 20

OWN = ("content_hash", "score_run", "score_bucket")


def content_hash(content: Sequence[str]) -> Column:
    """A hash of the columns' values that tells null from empty and one column from the next."""
    return F.md5(F.to_json(F.struct(*[F.col(c) for c in content]), {"ignoreNullFields": "false"}))


def _marked(df: DataFrame, key: Sequence[str], content: Sequence[str], buckets: int) -> DataFrame:
    clash = [c for c in OWN if c in df.columns]
    if clash:
        raise ValueError(f"columns {clash} are the ledger's own")
    whole = F.lit(True)
    for name in key:
        whole = whole & F.col(name).isNotNull()
    checked = df.filter(F.assert_true(whole, f"a row has a null in its key {list(key)}").isNull())
    return checked.withColumns({"content_hash": content_hash(content), "score_bucket": F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")})


def _hashes(key: Sequence[str]) -> list[Column]:
    """Two numbers of 56 bits from which all bit positions follow; the second is odd."""
    first, second = F.xxhash64(*key, "content_hash"), F.xxhash64(F.lit(1), *key, "content_hash").bitwiseOR(F.lit(256).cast("long"))
    return [F.shiftrightunsigned(first, 8).alias("h1"), F.shiftrightunsigned(second, 8).alias("h2")]


def runs(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the runs in a ledger."""
    if not exists(spark, f"{path}/rows"):
        return []
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/rows")
    listed = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(place)
    names = [status.getPath().getName() for status in listed]
    return sorted(int(n.removeprefix("score_run=")) for n in names if n.startswith("score_run="))


def _filled(spark: SparkSession, path: str) -> list[int]:
    return [r for r in runs(spark, path) if exists(spark, f"{path}/rows/score_run={r}/score_bucket=*")]


def bloom_words(rows: DataFrame, words: int) -> DataFrame:
    """Rows (score_bucket, words, word, bits): the set words of each bucket's filter. ``rows`` has score_bucket, h1, h2."""
    steps = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PROBES - 1).cast("long"))).alias("i")
    placed = rows.select("score_bucket", "h1", "h2", steps).select("score_bucket", F.pmod(F.col("h1") + F.col("i") * F.col("h2"), F.lit(words * 64)).alias("at"))
    spread = placed.select("score_bucket", F.shiftright("at", 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bit"))
    merged = spread.groupBy("score_bucket", "word").agg(F.bit_or("bit").alias("bits"))
    return merged.select("score_bucket", F.lit(words).alias("words"), "word", "bits")


def _write_filters(spark: SparkSession, path: str, run: int, key: Sequence[str], buckets: int) -> None:
    rows = spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows/score_run={run}")
    n = rows.count()
    words = 1 << max(0, (BITS * n // buckets // 64)).bit_length()
    filters = bloom_words(rows.select("score_bucket", *_hashes(key)), words)
    filters.write.parquet(f"{path}/filters/score_run={run}")


def _units(filters: DataFrame) -> Iterator[list[tuple[int, int]]]:
    """(run, bucket) of the filters, in blocks of bounded size."""
    block, held = [], 0
    sizes = filters.groupBy("score_run", "score_bucket").agg(F.max("words").alias("words")).orderBy("score_run", "score_bucket")
    for r in sizes.toLocalIterator():
        size = 8 * r["words"]
        if block and held + size > FILTER_BYTES:
            yield block
            block, held = [], 0
        block.append((r["score_run"], r["score_bucket"]))
        held += size
    if block:
        yield block


def _packed(filters: DataFrame, block: list[tuple[int, int]]) -> dict[tuple[int, int], np.ndarray]:
    chosen = F.struct(F.col("score_run").cast("int"), F.col("score_bucket").cast("int"))
    low, high = block[0], block[-1]
    ends = [F.struct(*[F.lit(x) for x in end]) for end in (low, high)]
    listed = filters.filter((chosen >= ends[0]) & (chosen <= ends[1])).select("score_run", "score_bucket", "words", "word", "bits").toArrow()
    run, bucket, words, word, bits = (listed.column(k).to_numpy() for k in range(5))
    out = {}
    order = np.lexsort((bucket, run))
    starts = np.flatnonzero(np.r_[True, (np.diff(run[order]) != 0) | (np.diff(bucket[order]) != 0)])
    for rows in np.split(order, starts[1:]):
        dense = np.zeros(int(words[rows[0]]), np.uint64)
        dense[word[rows]] = bits[rows].view(np.uint64)
        out[int(run[rows[0]]), int(bucket[rows[0]])] = dense
    return out


def perhaps(rows: DataFrame, filters: DataFrame) -> DataFrame:
    """The rows (with score_bucket, h1, h2) once for each run whose filter does not rule them out, with ``score_run``."""
    spark, out = rows.sparkSession, None
    schema = f"{', '.join(f'`{n}` {t}' for n, t in rows.dtypes)}, score_run int"
    for block in _units(filters):
        shared = spark.sparkContext.broadcast(_packed(filters, block))

        def probe(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            by_bucket: dict[int, list[tuple[int, np.ndarray]]] = {}
            for (run, bucket), words in shared.value.items():
                by_bucket.setdefault(bucket, []).append((run, words))
            for batch in batches:
                buckets = batch.column("score_bucket").to_numpy()
                h1, h2 = (batch.column(c).to_numpy() for c in ("h1", "h2"))
                for bucket in np.unique(buckets).tolist():
                    at = np.flatnonzero(buckets == bucket)
                    for run, words in by_bucket.get(bucket, ()):
                        size, left = np.int64(64 * len(words)), at
                        for i in range(PROBES):
                            place = np.mod(h1[left] + np.int64(i) * h2[left], size)
                            left = left[(words[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1]
                        if len(left):
                            some = batch.take(pa.array(left))
                            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(np.full(len(left), run), pa.int32())], names=[*some.schema.names, "score_run"])

        part = rows.mapInArrow(probe, schema)
        out = part if out is None else out.unionByName(part)
    return rows.limit(0).withColumn("score_run", F.lit(0)) if out is None else out


def files_to_read(spark: SparkSession, hits: DataFrame, path: str, unfiltered: Sequence[int]) -> list[str]:
    """Folders of a ledger that may hold results of the rows; at most one a run and bucket."""
    found = hits.select("score_run", "score_bucket").distinct().collect()
    named = [f"{path}/rows/score_run={r['score_run']}/score_bucket={r['score_bucket']}" for r in found]
    return sorted(p for p in named if exists(spark, p)) + [f"{path}/rows/score_run={r}" for r in unfiltered]


def unscored_content(df: DataFrame, path: str, key: Sequence[str], content: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """The rows whose key has no result for their present content, with ``content_hash`` and ``score_bucket``."""
    spark = df.sparkSession
    marked = _marked(df, key, content, buckets)
    known = _filled(spark, path)
    if not known:
        return marked
    ready = [r for r in known if exists(spark, f"{path}/filters/score_run={r}/_SUCCESS")]
    hits = None
    if ready:
        filters = spark.read.option("basePath", f"{path}/filters").parquet(*[f"{path}/filters/score_run={r}" for r in ready])
        hits = saved(perhaps(marked.select(*key, "content_hash", "score_bucket", *_hashes(key)), filters), "perhaps")
    unfiltered = [r for r in known if r not in ready]
    folders = files_to_read(spark, hits, path, unfiltered) if hits is not None else [f"{path}/rows/score_run={r}" for r in unfiltered]
    if not folders:
        return marked
    done = spark.read.option("basePath", f"{path}/rows").parquet(*folders).select(*key, "content_hash")
    return marked.join(done, [*key, "content_hash"], "left_anti")


def score_changed(
    df: DataFrame, path: str, key: Sequence[str], content: Sequence[str], score: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS
) -> int | None:
    """Score new and changed rows and add them to the ledger as a run; its number, or None if there was nothing to score.

    ``score`` must keep the key columns, ``content_hash`` and ``score_bucket``. A ledger keeps its number of buckets.
    """
    spark = df.sparkSession
    todo = unscored_content(df, path, key, content, buckets)
    known = runs(spark, path)
    run = known[-1] + 1 if known else 1
    scored = score(todo).hint("rebalance", "score_bucket")
    scored.write.partitionBy("score_bucket").parquet(f"{path}/rows/score_run={run}")
    if not exists(spark, f"{path}/rows/score_run={run}/score_bucket=*"):
        return None  # the folder stays without files, and its number is not used again
    _write_filters(spark, path, run, key, buckets)
    return run


def results(spark: SparkSession, path: str) -> DataFrame:
    """All results of a ledger, of every content that was scored."""
    return spark.read.option("basePath", f"{path}/rows").parquet(*[f"{path}/rows/score_run={r}" for r in _filled(spark, path)])


def results_for(df: DataFrame, path: str, key: Sequence[str], content: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """The results of the rows' present content, without the ledger's own columns."""
    now = _marked(df, key, content, buckets).select(*key, "content_hash")
    return results(df.sparkSession, path).join(now, [*key, "content_hash"], "left_semi").drop(*OWN)
