"""Quality of a pair dataset: score once, then summarise overall and by category."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from prefmill.operators.quality import category_box, category_columns, category_means, score_pairs, side_box, side_means
from prefmill.operators.selection import first_n
from prefmill.sources import ledger
from prefmill.sources.readers import read_split


def dataset_quality(
    spark: SparkSession,
    address: str,
    out: str,
    key: Sequence[str],
    split: str | None = None,
    num_examples: int | None = None,
    categories: Sequence[str] | None = None,
) -> dict[str, DataFrame]:
    """Score new and changed rows, add them to the ledger below ``out`` and return the summaries of the dataset as it is now.

    The summaries read the saved scores, so the parser runs once per row and content however many summaries are
    used. ``num_examples`` cuts to the first rows by key, before scoring.
    """
    pairs = read_split(spark, address, split)
    if num_examples:
        pairs = first_n(pairs, num_examples, key)
    path = f"{out}/scored"
    content = [c for c in pairs.columns if c not in key]
    ledger.score_changed(pairs, path, key, content, score_pairs)
    scored = ledger.results_for(pairs, path, key, content)
    names = list(categories or category_columns(scored, exclude=[*key, "split"]))
    return {
        "scored": scored,
        "side_means": side_means(scored),
        "side_box": side_box(scored),
        "category_means": category_means(scored, names),
        "category_box": category_box(scored, names),
    }
