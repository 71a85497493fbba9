"""A corpus from raw documents to a training mix, stage by stage.

Each stage is one operator of ``prefmill.llm`` over all that the stage before kept, written as Parquet and
read again, so that a lost executor costs no more than its tasks. All stages but the last keep the columns of
``documents``; the last emits one row for each copy taken, numbered in ``copy``.

The stages use counts and hashes that SQL cannot repeat (learned histograms and centroids, XXH64), so there is no
SQL for the whole; ``tests/llm`` holds it against a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from prefmill.llm import decontaminate, langid, mixing, nearcopies, quality
from prefmill.llm.tables import cut

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that break a rule or are far from every language go."""
    return quality.quality_filter(docs, quality.fit_references(docs))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents without letters or unlike every learned language go."""
    return langid.language_filter(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles alike to 0.8: one document of each component stays, the one with the smallest id."""
    return nearcopies.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that hold benchmark passages go."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: each document as often as its source's rate says."""
    return mixing.mixed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mix),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
