"""User-given functions on text columns: model calls, embedders and tokenisers.

A function is given as a *loader*: it is called once per task and returns the function that takes a
list of texts. Rows go to it in Arrow batches (``spark.sql.execution.arrow.maxRecordsPerBatch``), and a
batch that fails is halved again and again, so that one bad text gives one error value and not a failed
job, at the price of about two calls for each halving. A lost executor repeats its tasks; write the result of costly calls before using it further.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

TextFunction = Callable[[Sequence[str]], Sequence[Any]]
Loader = Callable[[], TextFunction]


def _apply(function: TextFunction, texts: list[str | None]) -> tuple[list[Any], list[str | None]]:
    """Values and errors in the order of the texts; null texts are not sent."""
    values: list[Any] = [None] * len(texts)
    errors: list[str | None] = [None] * len(texts)
    sent = [i for i, t in enumerate(texts) if t is not None]

    def call(places: list[int]) -> None:
        """Send some texts; a part that fails is halved until the bad texts stand alone."""
        try:
            answers = list(function([texts[i] for i in places]))
            if len(answers) != len(places):
                raise ValueError(f"{len(places)} texts gave {len(answers)} values")
        except MemoryError:
            raise
        except Exception as error:  # noqa: BLE001 - any failure of the user's function becomes a value
            if len(places) == 1:
                errors[places[0]] = str(error) or type(error).__name__
                return
            half = len(places) // 2
            call(places[:half])
            call(places[half:])
            return
        for i, answer in zip(places, answers):
            values[i] = answer

    if sent:
        call(sent)
    return values, errors


def map_text(
    df: DataFrame,
    text: str,
    loader: Loader,
    into: str,
    kind: T.DataType,
    error: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Add ``into`` (and an ``error`` column when named) by a user's function over ``text``.

    Without an error column a failing text fails the job. ``partitions`` spreads few, slow rows over
    more tasks than their input files give.
    """
    columns = [c for c in df.columns if c not in (into, error)]
    source = df.select(*columns)
    fields = [*source.schema.fields, T.StructField(into, kind)]
    if error:
        fields.append(T.StructField(error, T.StringType()))
    arrow_kind = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = loader()
        for batch in batches:
            values, errors = _apply(function, batch.column(batch.schema.get_field_index(text)).to_pylist())
            if not error and any(e is not None for e in errors):
                raise RuntimeError(next(e for e in errors if e is not None))
            out = [*batch.columns, pa.array(values, arrow_kind)]
            names = [*batch.schema.names, into]
            if error:
                out.append(pa.array(errors, pa.string()))
                names.append(error)
            yield pa.RecordBatch.from_arrays(out, names=names)

    if partitions:
        source = source.repartition(partitions)
    return source.mapInArrow(run, T.StructType(fields))


def generate_batch(
    df: DataFrame, prompt: str, loader: Loader, into: str = "response", partitions: int | None = None
) -> DataFrame:
    """Responses of a model function ``list[str] -> list[str]``; ``error`` tells which prompts failed."""
    return map_text(df, prompt, loader, into, T.StringType(), "error", partitions)


def embed_batch(df: DataFrame, text: str, loader: Loader, into: str = "vector") -> DataFrame:
    """Vectors of an embedding function ``list[str] -> list[list[float]]``."""
    return map_text(df, text, loader, into, T.ArrayType(T.DoubleType()))


def tokenize_with(df: DataFrame, text: str, loader: Loader, into: str = "tokens", max_length: int | None = None) -> DataFrame:
    """Token ids or texts of a tokeniser ``list[str] -> list[list]``, as texts, cut to ``max_length``."""

    def load() -> TextFunction:
        tokenize = loader()
        return lambda texts: [[str(t) for t in row][:max_length] for row in tokenize(texts)]

    return map_text(df, text, load, into, T.ArrayType(T.StringType()))


def embed_columns(df: DataFrame, texts: Mapping[str, str], loader: Loader) -> DataFrame:
    """Vectors of several text columns (text column -> vector column), in one pass through the workers."""
    source = df.drop(*texts.values())
    kind = T.ArrayType(T.DoubleType())
    fields = [*source.schema.fields, *[T.StructField(into, kind) for into in texts.values()]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = loader()
        for batch in batches:
            out = list(batch.columns)
            for text in texts:
                values, errors = _apply(function, batch.column(batch.schema.get_field_index(text)).to_pylist())
                if any(e is not None for e in errors):
                    raise RuntimeError(next(e for e in errors if e is not None))
                out.append(pa.array(values, to_arrow_type(kind)))
            yield pa.RecordBatch.from_arrays(out, names=[*batch.schema.names, *texts.values()])

    return source.mapInArrow(run, T.StructType(fields))


def count_tokens_with(df: DataFrame, text: str, loader: Loader, into: str = "n_tokens") -> DataFrame:
    """Number of tokens by a tokeniser ``list[str] -> list[list]``; the tokens themselves stay in the workers."""

    def load() -> TextFunction:
        tokenize = loader()
        return lambda texts: [len(row) for row in tokenize(texts)]

    return map_text(df, text, load, into, T.LongType())


# The workers get these functions by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
