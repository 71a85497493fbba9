"""Vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prefmill.functions.text import let


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of two number arrays; 0 when one has no length, null when sizes differ or one is null."""

    def on_doubles(pair: Column) -> Column:
        x, y = pair.getField("x"), pair.getField("y")
        norms = F.sqrt(_dot(x, x)) * F.sqrt(_dot(y, y))
        return F.when(F.size(x) == F.size(y), F.when(norms == 0, F.lit(0.0)).otherwise(_dot(x, y) / norms))

    doubles = F.struct(a.cast("array<double>").alias("x"), b.cast("array<double>").alias("y"))
    return F.when(a.isNotNull() & b.isNotNull(), let(doubles, on_doubles))
