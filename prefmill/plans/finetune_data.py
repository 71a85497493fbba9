"""Training text and token lists for supervised fine-tuning, with a stable split."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefmill.functions.messages import unwrap_content
from prefmill.functions.text import tokens
from prefmill.operators.prompts import sft_text
from prefmill.operators.selection import TEST_SHARE, train_test_split

# Fixed value: default longest example.
MAX_LENGTH = 1024


def sft_tokens(text: Column, max_length: int = MAX_LENGTH, tokenize: Callable[[Column], Column] = tokens) -> Column:
    """The first ``max_length`` tokens of a text."""
    return F.slice(tokenize(text), 1, max_length)


def finetune_data(
    pairs: DataFrame,
    key: Sequence[str],
    combine: bool = True,
    max_length: int = MAX_LENGTH,
    test_share: float = TEST_SHARE,
    seed: int = 0,
) -> DataFrame:
    """Pairs with ``text``, ``tokens`` and, unless they have one, ``split``. Row-wise; no shuffle."""
    text = sft_text(unwrap_content(pairs, "prompt"), unwrap_content(pairs, "chosen"), combine)
    out = pairs.withColumn("text", text).withColumn("tokens", sft_tokens(F.col("text"), max_length))
    return out if "split" in pairs.columns else train_test_split(out, key, test_share, seed)
