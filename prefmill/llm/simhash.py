"""Operator 1, SimHash near-dedup: pivot distance tables.

A document's fingerprint has a bit set where over half of its shingles' XXH64 hashes have it. Fingerprints
that differ in few bits are linked; documents of one connected component are near-duplicates.

Finding links. Distances to reference fingerprints (pivots) are computed once for each distinct
fingerprint. One set of pivots, zero and the 64 single bits, comes in five blocks: the distances to a
block's pivots, less that to zero, spell the fingerprint's bits there. Two fingerprints at most two bits
apart agree in three of the five blocks at least, so every link lies in a cell of one of ten tables (pairs
of blocks left free). A second set of many scattered pivots discards pairs of a cell: distances to a pivot
differ by no more than the pair does, so a coordinate that differs by more rules the pair out. What
survives is verified bit by bit.

Size. Exact copies share a fingerprint and are one row. Cells hold few fingerprints in general; one with
more than ``CELL`` is not paired but solved by balls: fingerprints at most two bits apart both lie at most
one bit from some centre, all around one centre are linked, and no more than 27 of a cell lie around any.
So nothing is capped, and work is linear in the number of fingerprints there.

Defined results: null and wordless texts have fingerprint zero and link like any other; fewer words than a
shingle make one shingle. Rows with a null id get a fingerprint and their component's smallest id, if it
has one. Repeated rows are copies. Equal ids are one document for the component.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefmill.llm import wordbytes as wb
from prefmill.llm.components import components
from prefmill.llm.tables import cut, free, map_batches

SHINGLE = 3
SEED = 42
MOST_BITS = 2
#: Distinct fingerprints a cell may hold to be paired.
CELL = 32
#: Scattered pivots whose distances are kept, eight to a long.
PIVOTS = 16
_BLOCKS = ((0, 13), (13, 26), (26, 39), (39, 52), (52, 64))
_SALTS = 8
_CHUNK = 1 << 16

_bits_of_byte = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text, as a signed number."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, n, _CHUNK):
        to = min(n, at + _CHUNK)
        last = ends[at + shingle - 1 : to + shingle - 1] if len(words) >= shingle else ends[-1:]
        hashed = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts[at:to].tolist(), last.tolist())])
        columns = np.frombuffer(hashed, np.uint8).reshape(-1, 8)
        for byte in range(8):
            ones[8 * byte : 8 * byte + 8] += np.bincount(columns[:, byte], minlength=256) @ _bits_of_byte
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, fp)."""

    def compute(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [fingerprint(part.text(i), shingle) for part in wb.slices(batch.column(1)) for i in range(len(part))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return map_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), compute, "doc_id long, fp long")


def scattered_pivots(n: int = PIVOTS) -> list[int]:
    """The reference fingerprints of the second set: hashes of 0, 1, 2, ..."""
    return [_signed(xxhash.xxh64_intdigest(str(i).encode(), SEED)) for i in range(n)]


def pivot_distances(fp: Column, n: int = PIVOTS) -> list[Column]:
    """Hamming distances to the scattered pivots, eight packed into each long."""
    packed = []
    for at in range(0, n, 8):
        total = F.lit(0).cast("long")
        for k, pivot in enumerate(scattered_pivots(n)[at : at + 8]):
            total = total.bitwiseOR(F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(pivot))).cast("long"), 8 * k))
        packed.append(total.alias(f"d{at // 8}"))
    return packed


def _within(a: Column, b: Column, most: int) -> Column:
    """Whether none of eight packed distances differs by more than ``most``."""
    fine = F.lit(True)
    for k in range(8):
        x, y = (F.shiftright(c, 8 * k).bitwiseAND(F.lit(255)) for c in (a, b))
        fine = fine & (F.abs(x - y) <= most)
    return fine


def _masks() -> list[int]:
    """For each two blocks left free, the bits of the other three."""
    spelled = [sum(1 << i for i in range(*block)) for block in _BLOCKS]
    return [_signed(sum(spelled) & ~(spelled[i] | spelled[j])) for i, j in combinations(range(len(_BLOCKS)), 2)]


def links(distinct: DataFrame, cell: int = CELL) -> DataFrame:
    """Rows (a, b) of fingerprints at most two bits apart: every such pair of small cells, and enough of large ones to connect them."""
    packed = pivot_distances(F.col("fp"))
    names = [f"d{i}" for i in range(len(packed))]
    places = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(_masks())])
    cells = distinct.select("fp", *packed, F.explode(places).alias("p")).select("p.t", "p.key", "fp", *names)
    sizes = cells.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    full = cut(cells.join(sizes, ["t", "key"]), "cells")
    small = full.filter(F.col("n") <= cell)
    a, b = small.alias("a"), small.alias("b")
    same = (F.col("a.t") == F.col("b.t")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp"))
    for name in names:
        same = same & _within(F.col(f"a.{name}"), F.col(f"b.{name}"), MOST_BITS)
    paired = a.join(b, same).filter(F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= MOST_BITS)
    paired = paired.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    return paired.unionByName(_balls(full.filter(F.col("n") > cell)))


def _balls(large: DataFrame) -> DataFrame:
    """Links of large cells: each fingerprint to the smallest around every centre one bit from it."""
    flips = F.lit(None)
    for i, mask in reversed(list(enumerate(_masks()))):
        free = [0, *(_signed(1 << k) for k in range(64) if not (mask >> k) & 1)]
        flips = F.when(F.col("t") == i, F.array(*[F.lit(x) for x in free])).otherwise(flips)
    around = large.select("t", "fp", F.explode(flips).alias("flip")).select("t", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("centre"))
    least = around.groupBy("t", "centre").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return around.join(least, ["t", "centre"]).filter("fp <> b").select(F.col("fp").alias("a"), "b")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id, is_kept); one document of each component is kept, the one with the smallest id."""
    marked = cut(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    found = cut(components(links(distinct.select("fp"))), "components")
    joined = distinct.join(found, distinct["fp"] == found["node"], "left").select(
        "fp", "least", "n", "component"
    ).filter("n > 1 OR component IS NOT NULL")
    least = joined.filter("component IS NOT NULL").groupBy("component").agg(F.min("least").alias("smallest"))
    # A fingerprint that many documents share is looked up under several salts, so that no task gets all of them.
    labels = joined.join(least, "component", "left").select("fp", F.coalesce("smallest", "least").alias("label"))
    labels = labels.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    salted = marked.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS)).cast("int"))
    named = salted.join(labels, ["fp", "salt"], "left")
    component = F.coalesce("label", "doc_id")
    return named.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("is_kept"),
    )


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, with the input's columns; of rows with the kept id, the first by text hash.

    Rows without an id cannot be told apart and stay. Documents move once, by id.
    """
    ids = near_duplicates(docs, doc_id, text).filter("is_kept").select("doc_id").distinct()
    return only(docs, ids, doc_id, text)


def only(docs: DataFrame, ids: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row for each of the given ids (one column), the first by text hash; rows without an id stay."""
    kept, row = free(docs, "_kept"), free(docs, "_row")
    ids = ids.toDF(kept)
    first = Window.partitionBy(doc_id).orderBy(F.xxhash64(text))
    known = docs.filter(F.col(doc_id).isNotNull()).join(ids, F.col(doc_id) == F.col(kept), "left_semi")
    known = known.withColumn(row, F.row_number().over(first)).filter(F.col(row) == 1).drop(row)
    return known.unionByName(docs.filter(F.col(doc_id).isNull()))
