"""Operator 11, ranked lexical search: dense blocked BLAS multiplication.

Items are queries, documents are ranked for each by a sum of integers: a term's weight times the impact it has in the
document. Items go round in blocks. For a block, one pass over the documents leaves, for each document, its number of
terms and the frequencies of the block's terms in it (``matches``); the statistics come from that table. A second
pass lays the frequencies out as dense float64 tiles, documents by vocabulary, and multiplies them with the items'
tiles. A vocabulary tile ends before any item's weights in it times the largest impact reach 2^53, so that every
partial sum of the product is an exact integer; tiles are summed in 64-bit integers. Of a tile's scores those at or
above the item's current last place stay, ties included, and are put in their total order (score down, id up), so a
cut never depends on how documents were dealt.

Size. A block holds at most ``items`` items and, but for a single longer item, ``postings`` different (item, term)
pairs: that bounds what is broadcast and collected. The driver holds one block at a time. A task holds one document
tile, one vocabulary tile and the best of each item. Winners of the tasks are merged in two steps, salted first.

Defined results: terms are the longest runs of ASCII letters and digits and non-ASCII characters, A-Z in lower case.
Null and termless texts count nowhere and are never ranked. Equal rows of items are one item; rows of one id with
different texts are items of their own, each with ranks from 1. Items without terms, and an empty table of items or
documents, return no rows. Repeated documents are ranked each; null ids come last among equal scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefmill.llm import wordbytes as wb
from prefmill.llm.tables import bounded_batches, cut, map_batches

#: Impacts are below this, see ``impacts``.
MOST_IMPACT = 10**6
#: An item's weights in one vocabulary tile add up to less than this.
MOST_WEIGHT = (1 << 53) // MOST_IMPACT
_SALTS = 64


@dataclass(frozen=True)
class Settings:
    top: int = 20
    #: Items, and different terms of items, in a block.
    items: int = 2048
    postings: int = 1 << 18
    #: Columns and rows of a tile.
    tile_terms: int = 2048
    tile_docs: int = 512


@dataclass
class Block:
    """Some items: their ids, the vocabulary in order of its hashes, and item, term and count of each posting."""

    ids: pa.Array
    terms: list[bytes]
    hashes: np.ndarray
    item: np.ndarray
    term: np.ndarray
    count: np.ndarray


@dataclass
class Tile:
    """Vocabulary columns, and the weights of the items in them."""

    terms: np.ndarray
    item: np.ndarray = field(repr=False)
    column: np.ndarray = field(repr=False)
    weight: np.ndarray = field(repr=False)

    def dense(self, items: int) -> np.ndarray:
        out = np.zeros((items, len(self.terms)))
        out[self.item, self.column] = self.weight
        return out


def terms_of(part: wb.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes in lower case, starts and ends of the terms, and each text's first."""
    low = wb.LOWER[part.data]
    return (low, *wb.spans(wb.Texts(part.first, low, part.offsets), wb.BARE))


def _item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """Rows (id, terms) of different items."""

    def compute(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = []
        for part in wb.slices(batch.column(1)):
            low, starts, ends, bounds = terms_of(part)
            data = low.tobytes()
            found = [data[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
            lists += [found[bounds[i] : bounds[i + 1]] for i in range(len(part))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.binary()))], names=["id", "terms"])

    chosen = items.select(F.col(item_id).alias("id"), F.col(text).alias("text")).distinct()
    schema = T.StructType([chosen.schema["id"], T.StructField("terms", T.ArrayType(T.BinaryType()))])
    return map_batches(chosen, compute, schema).filter(F.size("terms") > 0)


def _block(ids: list, counts: list[dict[bytes, int]], id_type: pa.DataType) -> Block:
    terms = sorted({t for c in counts for t in c})
    ends = np.cumsum([len(t) for t in terms])
    hashes = wb.hashes(np.frombuffer(b"".join(terms), np.uint8), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends.astype(np.int64))
    order = np.argsort(hashes, kind="stable")
    terms = [terms[i] for i in order]
    place = {t: i for i, t in enumerate(terms)}
    postings = [(i, place[t], n) for i, c in enumerate(counts) for t, n in sorted(c.items())]
    item, term, count = np.array(postings, np.int64).T
    return Block(pa.array(ids, id_type), terms, hashes[order], item, term, count)


def blocks(items: DataFrame, item_id: str = "item_id", text: str = "text", settings: Settings = Settings()) -> Iterator[Block]:
    """The items, a block at a time."""
    listed = _item_terms(items, item_id, text)
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(listed.schema["id"].dataType)
    ids, counts, held = [], [], 0
    for row in listed.toLocalIterator():
        own: dict[bytes, int] = {}
        for term in row["terms"]:
            own[bytes(term)] = own.get(bytes(term), 0) + 1
        if ids and (len(ids) == settings.items or held + len(own) > settings.postings):
            yield _block(ids, counts, id_type)
            ids, counts, held = [], [], 0
        ids.append(row["id"])
        counts.append(own)
        held += len(own)
    if ids:
        yield _block(ids, counts, id_type)


def _same(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, term: np.ndarray, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each span holds the bytes of its term."""
    lengths = ends - starts
    fine = lengths == at[term + 1] - at[term]
    for length in np.unique(lengths[fine]):
        rows = np.flatnonzero(fine & (lengths == length))
        for some in np.array_split(rows, max(1, len(rows) * int(length) >> 22)):
            steps = np.arange(length)
            fine[some] = (low[starts[some, None] + steps] == flat[at[term[some], None] + steps]).all(axis=1)
    return fine


def matches(docs: DataFrame, block: Block, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n, terms, tfs): number of terms, and which of the block's terms a text holds how often; texts without terms are left out."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((block.terms, block.hashes))

    def find(part: wb.Texts, terms: list[bytes], hashes: np.ndarray, flat: np.ndarray, at: np.ndarray):
        low, starts, ends, bounds = terms_of(part)
        hashed = wb.hashes(low, starts, ends)
        term = np.minimum(np.searchsorted(hashes, hashed), len(hashes) - 1)
        held = np.flatnonzero(hashes[term] == hashed)
        held = held[_same(low, starts[held], ends[held], term[held], flat, at)]
        keys, tf = np.unique(wb.owners(bounds)[held] * len(hashes) + term[held], return_counts=True)
        offsets = np.searchsorted(keys, np.arange(len(part) + 1) * len(hashes))
        return np.diff(bounds), offsets, keys % len(hashes), tf

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, hashes = shared.value
        flat = np.frombuffer(b"".join(terms), np.uint8)
        at = np.concatenate([[0], np.cumsum([len(t) for t in terms])]).astype(np.int64)
        for batch in batches:
            for part in wb.slices(batch.column(1)):
                n, offsets, term, tf = find(part, terms, hashes, flat, at)
                places = pa.array(offsets, pa.int32())
                lists = [pa.ListArray.from_arrays(places, pa.array(x, pa.int32())) for x in (term, tf)]
                ids = batch.column(0).slice(part.first, len(part))
                out = pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])
                yield out.filter(pa.array(n > 0))

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter(F.length("text") > 0)
    return chosen.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """At most 999,999, as m is 75 at least."""
    return (10**9 * tf) // (1000 * tf + 12 * m)


def tiles(block: Block, weight: np.ndarray, width: int = 2048, most: int = MOST_WEIGHT) -> list[Tile]:
    """The items' weights by vocabulary tiles; a posting heavier than a tile allows is split over several."""
    out: list[Tile] = []
    sums = np.zeros(len(block.ids), np.int64)
    terms: list[int] = []
    entries: list[tuple[int, int, int]] = []

    def close() -> None:
        nonlocal terms, entries
        if entries:
            item, column, value = np.array(entries, np.int64).T
            out.append(Tile(np.array(terms, np.int64), item, column, value.astype(np.float64)))
        terms, entries = [], []
        sums[:] = 0

    order = np.argsort(block.term, kind="stable")
    first = np.searchsorted(block.term[order], np.arange(len(weight) + 1))
    for term in np.flatnonzero(weight > 0):
        rows = order[first[term] : first[term + 1]]
        left = block.count[rows] * weight[term]
        while left.any():
            part = np.minimum(left, most - 1)
            if len(terms) == width or (sums[block.item[rows]] + part >= most).any():
                close()
            entries += [(i, len(terms), v) for i, v in zip(block.item[rows].tolist(), part.tolist(), strict=True) if v]
            terms.append(int(term))
            sums[block.item[rows]] += part
            left = left - part
            if left.any():
                close()
    close()
    return out


class Best:
    """The best ``top`` documents of each item so far, in total order."""

    def __init__(self, items: int, top: int):
        self.top, self.floor = top, np.ones(items, np.int64)
        self.item, self.score, self.doc, self.no_id = (np.zeros(0, np.int64) for _ in range(4))

    def add(self, scores: np.ndarray, doc: np.ndarray, no_id: np.ndarray) -> None:
        """``scores`` has a row an item and a column a document."""
        floor = self.floor
        if scores.shape[1] > self.top:
            floor = np.maximum(floor, np.partition(scores, -self.top, axis=1)[:, -self.top])
        item, at = np.nonzero(scores >= floor[:, None])
        if not len(item):
            return
        item, score = np.concatenate([self.item, item]), np.concatenate([self.score, scores[item, at]])
        doc, no_id = np.concatenate([self.doc, doc[at]]), np.concatenate([self.no_id, no_id[at]])
        order = np.lexsort((doc, no_id, -score, item))
        item = item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        kept = order[rank < self.top]
        last = item[rank == self.top - 1]
        self.floor[last] = score[order[rank == self.top - 1]]
        self.item, self.score, self.doc, self.no_id = item[rank < self.top], score[kept], doc[kept], no_id[kept]


def _ranked(matched: DataFrame, block: Block, id_type: T.DataType, n_docs: int, n_terms: int, settings: Settings) -> DataFrame:
    spark = matched.sparkSession
    held = matched.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    df = np.zeros(len(block.terms), np.int64)
    for row in held.collect():  # at most the block's vocabulary
        df[row["term"]] = row["df"]
    laid = tiles(block, weights(df, n_docs), settings.tile_terms)
    shared = spark.sparkContext.broadcast((len(block.ids), len(block.terms), laid, block.ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, vocabulary, laid, ids = shared.value
        best = Best(items, settings.top)
        small = sum(len(t.terms) for t in laid) * items <= 1 << 22
        kept = [t.dense(items) for t in laid] if small else None
        column = np.full(vocabulary, -1, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, settings.tile_docs):
                some = batch.slice(lo, settings.tile_docs)
                sizes = some.column(2).value_lengths().to_numpy(zero_copy_only=False)
                term = some.column(2).flatten().to_numpy().astype(np.int64)
                tf = some.column(3).flatten().to_numpy().astype(np.int64)
                m = np.array([75 + 25 * n * n_docs // n_terms for n in some.column(1).to_pylist()], np.int64)
                row = np.repeat(np.arange(some.num_rows), sizes)
                impact = impacts(tf, m[row])
                scores = np.zeros((items, some.num_rows), np.int64)
                for k, tile in enumerate(laid):
                    column[tile.terms] = np.arange(len(tile.terms))
                    here = column[term] >= 0
                    dense = np.zeros((some.num_rows, len(tile.terms)))
                    dense[row[here], column[term[here]]] = impact[here]
                    scores += ((kept[k] if kept else tile.dense(items)) @ dense.T).astype(np.int64)
                    column[tile.terms] = -1
                doc = some.column(0)
                best.add(scores, doc.fill_null(0).to_numpy(), doc.is_null().to_numpy(zero_copy_only=False).astype(np.int64))
        doc = pa.array(best.doc, pa.int64(), mask=best.no_id.astype(bool))
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.item, pa.int32()), ids.take(pa.array(best.item)), doc, pa.array(best.score)], names=["place", "item_id", "doc_id", "score"]
        )

    schema = T.StructType([
        T.StructField("place", T.IntegerType()), T.StructField("item_id", id_type),
        T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType()),
    ])
    found = matched.filter(F.size("terms") > 0).select("doc_id", "n", "terms", "tfs").mapInArrow(run, schema)
    found = found.withColumn("salt", F.spark_partition_id() % _SALTS)
    for keys in (["place", "salt"], ["place"]):
        order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= settings.top)
    return found.select("item_id", "rank", "doc_id", "score")


def search(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    settings: Settings = Settings(),
) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): each item's best documents, best first."""
    spark: SparkSession = docs.sparkSession
    id_type = items.schema[item_id].dataType
    out = None
    for block in blocks(items, item_id, item_text, settings):
        matched = cut(matches(docs, block, doc_id, text), "matches")
        n_docs, n_terms = matched.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n_docs:
            break
        ranked = cut(_ranked(matched, block, id_type, n_docs, n_terms, settings), "ranked")
        out = ranked if out is None else out.unionByName(ranked)
    if out is None:
        schema = T.StructType([
            T.StructField("item_id", id_type), T.StructField("rank", T.IntegerType()),
            T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType()),
        ])
        return spark.createDataFrame([], schema)
    return out
