"""Chat message lists: array<struct<role, content>>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefmill.schemas import MESSAGES


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def as_messages(role: str, content: Column) -> Column:
    """A list holding one message."""
    return F.array(message(role, content)).cast(MESSAGES)


def wrap_messages(user: Column, system: Column | None = None) -> Column:
    """An optional system message (left out when null or empty), then the user message."""
    if system is None:
        return as_messages("user", user)
    first = F.when(system != "", message("system", system))
    return F.array_compact(F.array(first, message("user", user))).cast(MESSAGES)


def is_message_list(df: DataFrame, name: str) -> bool:
    """Whether a column holds message lists, judged by the schema."""
    kind = df.schema[name].dataType
    return (
        isinstance(kind, T.ArrayType)
        and isinstance(kind.elementType, T.StructType)
        and "content" in kind.elementType.names
    )


def content_of(messages: Column) -> Column:
    """Content of the first message, "" when there is none."""
    return F.coalesce(F.get(messages, F.lit(0)).getField("content"), F.lit(""))


def unwrap_content(df: DataFrame, name: str) -> Column:
    """Text of a column that holds either message lists or plain values."""
    if is_message_list(df, name):
        return content_of(F.col(name))
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
