"""Operator 5, benchmark decontamination: spaced-seed hashing.

Words (runs of ASCII letters, digits and characters beyond ASCII but for common punctuation, lower-cased; Thai, Lao, kana
and Han characters each by itself) of a document and of a benchmark item are hashed through fixed masks that skip some positions. Where a document's hash equals an item's, the
two are laid side by side and the overlap around the hit is verified: the longest stretch in which at least
four of five words are equal. It counts from ``MIN_WORDS`` words on, or over the whole of a shorter item.
The masks hit every stretch of ten words with two substitutions, hence every overlap that counts.

Size. The document's side is hashed where it lies and nothing of it is shuffled. The benchmark's side goes to
every task as one sorted table of at most ``BLOCK`` seeds; a larger benchmark is taken in blocks, one after another, each
against all documents. Hits are reduced to different alignments ``HITS_AT_ONCE`` at a time, so a word that fills text and item
costs memory and time in proportion to the text. Copies of an item are one item during the search.

Defined results: null and short texts overlap nothing, items of fewer than five words are too short to tell
from chance, and those of five to seven must be equal throughout. Repeated rows are answered each; null item ids
are reported as null. Empty tables give empty results. Other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefmill.llm import wordbytes as wb
from prefmill.llm.tables import cut, map_batches

#: Positions that count, from each start.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5), (0, 1, 3, 6, 7))
MIN_WORDS = 12
LEAST_ITEM = 5
BLOCK = 3_000_000
HITS_AT_ONCE = 1 << 20
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))

HITS = "doc_id long, item_class long, doc_start long, item_start long, n_words long, n_equal long"


@dataclass(frozen=True)
class Seeds:
    """Seed hashes in order with the item and position of each; the items' word hashes, one after another."""

    hashes: np.ndarray
    item: np.ndarray
    place: np.ndarray
    words: np.ndarray
    begins: np.ndarray
    filter: np.ndarray


def _lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(column, ""))


def _words(part: wb.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and each text's first. Characters of scripts written without spaces are words of their own."""
    data = part.data
    inside = wb.BARE[data]
    if not (data >= 0xE0).any():
        starts, ends, bounds = wb.spans(part, wb.BARE)
        return wb.hashes(data, starts, ends), bounds
    second = np.append(data[1:], 0)
    third = np.append(data[2:], [0, 0])[: len(data)]
    # U+2000-206F, U+3000-303F, U+FF00-FF0F and U+FF1A-FF20 are punctuation.
    mark = (data == 0xE2) & (second >= 0x80) & ((second == 0x80) | (second == 0x81) & (third < 0xB0))
    mark |= (data == 0xE3) & (second == 0x80)
    mark |= (data == 0xEF) & (second == 0xBC) & ((third >= 0x80) & (third < 0x90) | (third >= 0x9A) & (third < 0xA1))
    # Thai and Lao, kana, and Han.
    alone = (data == 0xE0) & (second >= 0xB8) & (second <= 0xBB) | (data == 0xE3) & (second >= 0x81) | (data >= 0xE4) & (data <= 0xE9)
    inside[np.minimum(np.flatnonzero(mark)[:, None] + np.arange(3), len(inside) - 1)] = False
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    first, last = part.offsets[:-1], part.offsets[1:] - 1
    first, last = first[first < len(inside)], last[last >= 0]
    begins[first], stops[last] = inside[first], inside[last]
    at = np.flatnonzero(alone & inside)
    begins[at] = True
    stops[np.minimum(at + 2, len(stops) - 1)] = True
    stops[at[(at > 0)] - 1] |= inside[at[at > 0] - 1]
    after = at[at + 3 < len(begins)] + 3
    begins[after] |= inside[after]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return wb.hashes(data, starts, ends), np.searchsorted(starts, part.offsets)


def _seeds(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of all seeds of mask k."""
    at = wb.whole(bounds, MASKS[k][-1] + 1)
    total = np.full(len(at), k, np.uint64)
    for place, factor in zip(MASKS[k], _MIX, strict=True):
        total += words[at + place] * factor
    return at, wb.mix(total)


def _table(items: list[np.ndarray]) -> Seeds:
    lengths = np.array([len(x) for x in items], np.int64)
    begins = np.concatenate([[0], np.cumsum(lengths)])
    words = np.concatenate([np.zeros(0, np.uint64), *items])
    found = [_seeds(words, begins, k) for k in range(len(MASKS))]
    at, h = np.concatenate([a for a, _ in found]), np.concatenate([h for _, h in found])
    order = np.argsort(h, kind="stable")
    at, h = at[order], h[order]
    item = np.searchsorted(begins, at, "right") - 1
    bits = min(26, 8 + max(1, len(h)).bit_length())
    member = np.zeros(1 << bits, bool)
    member[(h >> np.uint64(64 - bits)).astype(np.int64)] = True
    return Seeds(h, item, at - begins[item], words, begins, member)


def longest_overlap(equal: np.ndarray) -> tuple[int, int, int]:
    """Start, length and equal words of the stretch with most equal words of which four of five are equal."""
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -4))])
    lowest = np.minimum.accumulate(total)
    start = np.searchsorted(-lowest, -total, "left")
    n = np.concatenate([[0], np.cumsum(equal)])
    gain = n - n[start]
    end = int(gain.argmax())
    return int(start[end]), int(end - start[end]), int(gain[end])


def _different(text: np.ndarray, item: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The different alignments, in order, one a row."""
    order = np.lexsort((start, item, text))
    rows = np.column_stack([text[order], item[order], start[order]])
    return rows[np.r_[True, (np.diff(rows, axis=0) != 0).any(axis=1)]] if len(rows) else rows


def overlaps(part: wb.Texts, seeds: Seeds, min_words: int = MIN_WORDS) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (text, item, text's word, item's word, words, equal words): the best overlap of each alignment that counts."""
    words, bounds = _words(part)
    owner = wb.owners(bounds)
    shift = np.uint64(64 - (len(seeds.filter).bit_length() - 1))
    sides = []
    for k in range(len(MASKS)):
        at, h = _seeds(words, bounds, k)
        likely = seeds.filter[(h >> shift).astype(np.int64)]
        at, h = at[likely], h[likely]
        low, high = np.searchsorted(seeds.hashes, h, "left"), np.searchsorted(seeds.hashes, h, "right")
        n = high - low
        # Some hits at a time; a repeated word hits everywhere, but there are only so many alignments.
        for some in np.split(np.arange(len(at)), np.searchsorted(np.cumsum(n), np.arange(HITS_AT_ONCE, n.sum(), HITS_AT_ONCE))):
            where = np.repeat(at[some], n[some])
            which = np.repeat(low[some] - np.concatenate([[0], np.cumsum(n[some])])[:-1], n[some]) + np.arange(n[some].sum())
            sides.append(_different(owner[where], seeds.item[which], where - seeds.place[which]))
    found = []
    for text, item, start in _different(*np.concatenate(sides).T).tolist():
        own = seeds.words[seeds.begins[item] : seeds.begins[item + 1]]
        first, last = max(start, int(bounds[text])), min(start + len(own), int(bounds[text + 1]))
        equal = words[first:last] == own[first - start : last - start]
        at, n, same = longest_overlap(equal)
        if n >= min(min_words, len(own)) and (len(own) >= 8 or same == len(own)):
            found.append((text, item, first + at - int(bounds[text]), first - start + at, n, same))
    return found


def _items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """Rows (item_id, item_class, words): word hashes as bytes; copies share a class."""

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed = []
        for part in wb.slices(_lowered(batch.column(1))):
            words, bounds = _words(part)
            packed += [words[bounds[i] : bounds[i + 1]].tobytes() for i in range(len(part))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["item_id", "words"])

    rows = map_batches(benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")), hashed, "item_id long, words binary")
    return rows.filter(F.length("words") >= 8 * LEAST_ITEM).withColumn("item_class", F.xxhash64("words"))


def _blocks(items: DataFrame, block: int) -> Iterator[tuple[np.ndarray, Seeds, bool]]:
    """The items' classes and seeds, in blocks of about ``block`` seeds, one after another; and whether more follow."""
    classes = items.select("item_class", "words").dropDuplicates(["item_class"])
    total = classes.agg(F.sum(F.length("words") / 8)).first()[0] or 0
    n = int(total * len(MASKS) // block) + 1
    for k in range(n if total else 0):
        rows = classes.filter(F.pmod("item_class", F.lit(n)) == k).orderBy("item_class").collect()
        if rows:
            yield np.array([r["item_class"] for r in rows]), _table([np.frombuffer(r["words"], np.uint64) for r in rows]), k + 1 < n


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    min_words: int = MIN_WORDS,
    block: int = BLOCK,
) -> DataFrame:
    """Rows (doc_id, item_id, doc_start, item_start, n_words, n_equal): for each document and item that overlap,
    the overlap with most equal words; ties go to the first in the document, then in the item."""
    spark = docs.sparkSession
    items = cut(_items(benchmark, item_id, item_text), "items")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = spark.createDataFrame([], HITS)
    for classes, seeds, more in _blocks(items, block):
        shared = spark.sparkContext.broadcast(vars(seeds))  # plain arrays, which need no class on the workers

        def search(batch: pa.RecordBatch, shared=shared, classes=classes) -> pa.RecordBatch:
            ids = batch.column(0).to_numpy(zero_copy_only=False) if not batch.column(0).null_count else np.array(batch.column(0).to_pylist(), object)
            rows, known = [], Seeds(**shared.value)
            for part in wb.slices(_lowered(batch.column(1))):
                rows += [(ids[part.first + t], int(classes[i]), *rest) for t, i, *rest in overlaps(part, known, min_words)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            return pa.RecordBatch.from_arrays(
                [pa.array([None if x is None else int(x) for x in c], pa.int64()) for c in columns],
                names=["doc_id", "item_class", "doc_start", "item_start", "n_words", "n_equal"],
            )

        part = map_batches(texts, search, HITS)
        if more:  # done with, so that no two blocks are held
            part = cut(part, "overlaps")
            shared.unpersist()
        found = found.unionByName(part)
    best = F.max_by(F.struct("doc_start", "item_start", "n_words", "n_equal"), F.struct("n_equal", -F.col("doc_start"), -F.col("item_start")))
    chosen = found.groupBy("doc_id", "item_class").agg(best.alias("b"))
    return chosen.join(items.select("item_class", "item_id").distinct(), "item_class").select("doc_id", "item_id", "b.*")


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", min_words: int = MIN_WORDS, block: int = BLOCK
) -> DataFrame:
    """The documents that overlap no item, with all their columns; decided where they lie, without a shuffle."""
    spark = docs.sparkSession
    at = docs.columns.index(text)
    items = cut(_items(benchmark.select(F.lit(None).cast("long").alias("item_id"), F.col(item_text).alias("text")), "item_id", "text"), "items")
    for _, seeds, more in _blocks(items, block):
        shared = spark.sparkContext.broadcast(vars(seeds))  # plain arrays, which need no class on the workers

        def keep(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            clean, known = np.ones(batch.num_rows, bool), Seeds(**shared.value)
            for part in wb.slices(_lowered(batch.column(at))):
                clean[[part.first + row[0] for row in overlaps(part, known, min_words)]] = False
            return batch.filter(pa.array(clean))

        docs = map_batches(docs, keep, docs.schema)
        if more:
            docs = cut(docs, "clean")
            shared.unpersist()
    return docs
