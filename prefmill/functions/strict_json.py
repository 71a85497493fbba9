"""Strict JSON: a text counts only when it is exactly one JSON value.

``from_json`` forgives single quotes and trailing text, and ``try_parse_json`` stops after the first
value. Here the text is parsed once as the only element of a list that is followed by a checksum of
the text. Leftover text either breaks the syntax or closes the list early, and then the checksum or
the single element is missing.

Kept apart from Python's parser: NaN/Infinity and repeated keys are refused here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prefmill.functions.text import let

_VALUE = "$.v[0]"


def json_wrapped(text: Column) -> Column:
    """Variant that holds the value of the text and its checksum; read it with the functions below."""
    head, tail = F.lit('{"v":['), F.lit('],"sum":')
    return F.try_parse_json(F.concat(head, text, tail, F.xxhash64(text).cast("string"), F.lit("}")))


def is_json(wrapped: Column, text: Column) -> Column:
    """Whether the text is one JSON value; never null."""
    whole = F.try_variant_get(wrapped, "$.sum", "bigint") == F.xxhash64(text)
    single = F.try_variant_get(wrapped, "$.v[1]", "variant").isNull()
    return F.coalesce(whole & single & F.try_variant_get(wrapped, _VALUE, "variant").isNotNull(), F.lit(False))


def json_object(wrapped: Column) -> Column:
    """The value as a map of texts, null unless it is an object."""
    return F.try_variant_get(wrapped, _VALUE, "map<string,string>")


def json_objects(wrapped: Column, member: str) -> Column:
    """A list member of the value as maps of texts.

    Empty when the member is missing; null when it is no list of objects, or the value is no object.
    """
    path = f"{_VALUE}.{member}"
    elements = F.try_variant_get(wrapped, path, "array<map<string,string>>")
    missing = F.try_variant_get(wrapped, path, "variant").isNull()
    is_object = F.try_variant_get(wrapped, _VALUE, "map<string,variant>").isNotNull()
    empty = F.array().cast("array<map<string,string>>")
    # An element that is no object reads as null.
    objects = let(elements, lambda es: F.when(F.forall(es, lambda e: e.isNotNull()), es))
    return F.when(~missing, objects).when(is_object, empty)
