"""Prompt / chosen / rejected rows from parsed responses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefmill.functions.messages import as_messages
from prefmill.functions.text import list_repr
from prefmill.operators.responses import drop_errors

# The prompt variants of test data and the response members that hold them.
PROMPT_TYPES = {
    "default": "prompt_default",
    "code_form": "prompt_code_form",
    "code_form_types": "prompt_code_form_types",
}

PAIR_COLUMNS = ("prompt", "chosen", "rejected", "domain", "task", "code_form")


def match_first(items: Column, original: Column) -> Column:
    """Prompt of the first stage-1 item whose code equals ``original`` (missing equals "")."""
    wanted = F.coalesce(original, F.lit(""))
    same = F.filter(items, lambda x: F.coalesce(x.getField("code"), F.lit("")) == wanted)
    return F.get(same, F.lit(0)).getField("prompt")


def match_prompts(results: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per improved item with the matched prompt (null when no item matches).

    The match stays inside the row, so nothing is shuffled.
    """
    matched = F.transform(
        "second_items",
        lambda e: F.struct(
            match_first(F.col("first_items"), e.getField("original_code")).alias("prompt_text"),
            e.getField("improved_code").alias("chosen_text"),
            e.getField("original_code").alias("rejected_text"),
        ),
    )
    carried = [c for c in (*keep, "domain", "task", "code_form") if c in results.columns]
    rows = results.select(*carried, F.posexplode(matched).alias("item_pos", "m"))
    return rows.select(*carried, "item_pos", "m.*")


def match_first_across(
    improved: DataFrame, items: DataFrame, key: str, code: str = "code", original: str = "original_code", pos: str = "pos"
) -> DataFrame:
    """:func:`match_first` for item tables: one row per item instead of one list per response.

    Stage-1 items are first cut to one row per (key, code), so the join cannot multiply rows. The join
    key holds the code text itself, which spreads one large response over many partitions.
    """
    firsts = items.groupBy(key, F.coalesce(code, F.lit("")).alias("_code")).agg(
        F.min_by("prompt", pos).alias("prompt_text")
    )
    wanted = improved.withColumn("_code", F.coalesce(original, F.lit("")))
    return wanted.join(firsts, [key, "_code"], "left").drop("_code")


def drop_unmatched(matched: DataFrame) -> DataFrame:
    """Rows whose prompt was found and is not empty."""
    return matched.filter(F.col("prompt_text") != "")


def pair_messages(rows: DataFrame) -> DataFrame:
    """Turn the three text columns into the message lists of a preference row."""
    roles = {"prompt": "user", "chosen": "assistant", "rejected": "assistant"}
    made = [as_messages(role, F.col(f"{side}_text")).alias(side) for side, role in roles.items()]
    rest = [c for c in rows.columns if c not in {f"{side}_text" for side in roles}]
    return rows.select(*rest, *made)


def _form_text(df: DataFrame) -> Column:
    is_list = isinstance(df.schema["code_form"].dataType, T.ArrayType)
    return list_repr(F.col("code_form")) if is_list else F.col("code_form")


def _first_form(df: DataFrame) -> Column:
    is_list = isinstance(df.schema["code_form"].dataType, T.ArrayType)
    return F.get("code_form", F.lit(0)) if is_list else F.col("code_form")


def build_pairs(results: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Training pairs of parsed results (train or header mode): improved code against original code."""
    good = drop_errors(results)
    rows = drop_unmatched(match_prompts(good.withColumn("code_form", _form_text(good)), keep))
    return pair_messages(rows).select(*keep, *PAIR_COLUMNS)


def drop_empty_prompt_type(variants: DataFrame) -> DataFrame:
    """Rows whose prompt variant has a text."""
    return variants.filter(F.col("prompt_text") != "")


def prompt_variants(results: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per prompt variant of each test result, all sharing chosen and rejected code."""
    item = F.get("second_items", F.lit(0))
    variants = F.array(
        *[
            F.struct(F.lit(kind).alias("prompt_type"), item.getField(field).alias("prompt_text"))
            for kind, field in PROMPT_TYPES.items()
        ]
    )
    return results.select(
        *keep,
        "domain",
        "task",
        _first_form(results).alias("code_form"),
        item.getField("improved_code").alias("chosen_text"),
        item.getField("original_code").alias("rejected_text"),
        F.inline(variants),
    )


def build_test_pairs(results: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Test pairs of parsed results (test mode), one per prompt variant that has a text."""
    rows = drop_empty_prompt_type(prompt_variants(drop_errors(results), keep))
    return pair_messages(rows).select(*keep, *PAIR_COLUMNS, "prompt_type")


def dataset_card(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows and distinct domains, tasks and code forms of a pair dataset."""
    return pairs.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("domain").alias("n_domains"),
        F.count_distinct("task").alias("n_tasks"),
        F.count_distinct("code_form").alias("n_code_forms"),
    )
