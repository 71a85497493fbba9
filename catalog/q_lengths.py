"""Token counts and length statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.inputs import table, view
from catalog.q_pairs import TOKEN_SQL
from catalog.registry import query, rounded
from prefmill.functions.text import token_count
from prefmill.operators import lengths as L
from prefmill.operators import sketches
from prefmill.session import scratch_path


def count_sql(column: str) -> str:
    return f"CAST(len(regexp_extract_all({column}, '{TOKEN_SQL}')) AS BIGINT)"


SIDES = f"""
sides AS (
  SELECT 'prompt' AS side, {count_sql('prompt')} AS v FROM fx_sides
  UNION ALL SELECT 'chosen', {count_sql('chosen')} FROM fx_sides
  UNION ALL SELECT 'rejected', {count_sql('rejected')} FROM fx_sides)"""

HISTOGRAM = """
, top AS (SELECT max(v) + 50 AS t FROM sides),
bins AS (SELECT side, bin FROM (SELECT DISTINCT side FROM sides) s, range(49) r(bin)),
filled AS (SELECT side, (v * 49) // t AS bin, count(*) AS n FROM sides, top GROUP BY ALL),
total AS (SELECT side, count(*) AS n_all FROM sides GROUP BY side)
SELECT side, bin, round(bin * t / 49.0, 6) AS bin_start, round((bin + 1) * t / 49.0, 6) AS bin_end,
       coalesce(n, 0) AS n, round(CAST(coalesce(n, 0) AS DOUBLE) * 49 / (CAST(n_all AS DOUBLE) * t), 12) AS density
FROM bins JOIN total USING (side) LEFT JOIN filled USING (side, bin), top"""


def sides_sql(body: str) -> str:
    return f", {SIDES.strip()}{body if body.startswith(chr(10) + ',') else chr(10) + body}"


@query("token_count", f"SELECT doc_id, {count_sql('text')} AS n_tokens FROM documents")
def token_count_query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", token_count(F.col("text")).cast("bigint").alias("n_tokens"))


def counts(spark, sf_dir):
    return L.length_counts(L.token_lengths(view(spark, sf_dir, "fx_sides")))


@query("length_counts", sides_sql("SELECT side, CAST(v AS INT) AS length, count(*) AS n FROM sides GROUP BY ALL"), ("fx_sides",))
def length_counts(spark, sf_dir):
    return counts(spark, sf_dir)


STATS = """
SELECT side, count(*) AS n_rows, round(avg(v), 6) AS mean, CAST(min(v) AS DOUBLE) AS min, CAST(max(v) AS DOUBLE) AS max,
       round(stddev_pop(v), 6) AS std, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.25), 6) AS q25,
       round(quantile_cont(v, 0.75), 6) AS q75, round(quantile_cont(v, 0.9), 6) AS q90,
       round(quantile_cont(v, 0.95), 6) AS q95, round(quantile_cont(v, 0.99), 6) AS q99
FROM sides GROUP BY side"""


@query("length_stats", sides_sql(STATS), ("fx_sides",))
def length_stats(spark, sf_dir):
    stats = L.length_stats(counts(spark, sf_dir))
    return stats.select("side", "n_rows", "min", "max", *rounded("mean", "std", *L.QUANTILES))


@query("length_stats_state", sides_sql(STATS), ("fx_sides",))
def length_stats_state(spark, sf_dir):
    """The documents of half of the sources first, then all: only the other half is tokenised then."""
    path, rows = scratch_path(spark, "lengths"), view(spark, sf_dir, "fx_sides").fillna("", ["source"])
    for some in (rows.filter("crc32(source) % 2 = 0"), rows):
        sketches.extend_lengths(spark, L.token_lengths(some, keep=["source"]), path, "source", L.SIDES)
    stats = L.length_stats(sketches.counts_from_state(spark.read.parquet(path)))
    return stats.select("side", "n_rows", "min", "max", *rounded("mean", "std", *L.QUANTILES))


def _histogram(spark, sf_dir):
    rows = L.length_histogram(counts(spark, sf_dir))
    return rows.select("side", "bin", "n", *rounded("bin_start", "bin_end"), *rounded("density", digits=12))


@query("length_histogram", sides_sql(HISTOGRAM.replace(", round(CAST(coalesce(n, 0) AS DOUBLE) * 49 / (CAST(n_all AS DOUBLE) * t), 12) AS density", "")), ("fx_sides",))
def length_histogram(spark, sf_dir):
    return _histogram(spark, sf_dir).drop("density")


@query("length_density", sides_sql(HISTOGRAM.replace("coalesce(n, 0) AS n, ", "")), ("fx_sides",))
def length_density(spark, sf_dir):
    rows = L.length_density(counts(spark, sf_dir))
    return rows.select("side", "bin", *rounded("bin_start", "bin_end"), *rounded("density", digits=12))


@query("length_stats_conversations", f"""
, sides AS (SELECT 'prompt' AS side, {count_sql('prompt_text')} AS v FROM fx_text_pairs
  UNION ALL SELECT 'chosen', {count_sql('chosen_text')} FROM fx_text_pairs){STATS}""", ("fx_text_pairs",))
def length_stats_conversations(spark, sf_dir):
    pairs = view(spark, sf_dir, "fx_text_pairs").selectExpr("prompt_text AS prompt", "chosen_text AS chosen")
    lengths = L.token_lengths(pairs, ("prompt", "chosen"))
    stats = L.length_stats(L.length_counts(lengths, ("prompt", "chosen")))
    return stats.select("side", "n_rows", "min", "max", *rounded("mean", "std", *L.QUANTILES))
