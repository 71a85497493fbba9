"""Operator 9, LM scoring: stupid backoff, computed relationally.

The model is the corpus itself: counts of the n-grams of up to ``order`` words over all documents. A document is scored
by the counts of all others (its own are taken off), else every n-gram would have been seen. A word after others
scores count(n-gram) / count(n-gram without the word), for the longest n-gram of its document up to ``order``; if it is
unseen, ``alpha`` times what the next shorter one gives, and at last the word's share of all words; an unseen
word counts as half an occurrence. The logarithms are summed per document; ``n_backoff`` counts the steps down.

Tables. Documents lie in blocks of about ``block_words`` words, so that an n-gram is exploded once a block, with its
number there, not once an occurrence: :func:`exploded`. Those rows are partitioned by the n-gram's hash; one exchange
serves both the count table (:func:`totals`, hash and sum over all blocks) and its join back to the exploded rows. What
a block holds alone it knows itself, so only larger totals go back to their block, where they are subtracted, chosen and
summed per document. They go as lists, one for each block that a partition answers: :func:`gathered`.

Disk. Exploded n-grams take several times their text, so they are never there all at once: the hashes fall into ``rounds``
equal ranges, each exploded, counted and joined by itself, and only its answers stay, as a table in the shared folder. The
sums are made for one of ``shares`` equal shares of the blocks after another. The shuffle files of each go when it is done.

Size. A hot n-gram has one row a block, so no hash holds more than its share of one block's different n-grams;
partitions hold about ``part_rows`` rows at most, at any corpus size, few enough to be counted and joined in a hash table
that stays near the core's cache; there are never more lists than answers; a block's words and answers are bounded by
``block_words`` or its longest document. Nothing is broadcast or gathered.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, in lower case. N-grams are told
apart by 64-bit hashes.

Defined results: null, empty and wordless texts have no words, log_prob 0 and a null mean. Repeated rows are documents
of their own. Null ids are kept. Empty tables give an empty result. Other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefmill.llm import wordbytes as wb
from prefmill.llm.tables import bounded_batches, cut_and_clear, narrow_batches

SCHEMA = "doc_id long, n_words long, n_backoff long, log_prob double"
#: Lists of numbers that only tasks open lie as their bytes, so that Spark copies them whole.
BLOCKS = "n_words long, ids array<long>, lengths binary, words binary, vocabulary binary"
ANSWERS = "block_id long, turn int, places binary, totals binary"
#: Rows of one Arrow batch of exploded n-grams.
_BATCH = 200_000
#: Answers gathered at once.
_GATHERED = 2_000_000


@dataclass(frozen=True)
class Settings:
    order: int = 3
    alpha: float = 0.4
    unseen: float = 0.5
    block_words: int = 750_000
    part_rows: int = 600_000
    rounds: int = 5
    shares: int = 4


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.BinaryArray:
    """A row of bytes for the values from each bound to the next."""
    offsets = pa.array(bounds * values.itemsize, pa.int32()).buffers()[1]  # an error beyond 2 GB
    return pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, offsets, pa.py_buffer(values)])


def _numbers(rows: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The values of all the rows, one after another."""
    return np.frombuffer(b"".join(rows.to_pylist()), kind)


def blocks(docs: DataFrame, doc_id: str, text: str, settings: Settings) -> DataFrame:
    """Rows (block_id, n_words, ids, lengths, words, vocabulary): documents as places in the block's vocabulary of hashes."""
    size = settings.block_words

    def pack(batches):
        ids, lengths, hashed, held = [], [], [], 0

        def block() -> pa.RecordBatch:
            every = np.concatenate([np.zeros(0, np.uint64), *hashed])
            vocabulary, words, n = np.unique(every, return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")  # frequent words get small places
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            lists = [_binary(x, np.array([0, len(x)])) for x in (np.concatenate(lengths), place[words], vocabulary[order])]
            names = pa.array([[x for part in ids for x in part]], pa.list_(pa.int64()))
            columns = [pa.array([len(words)], pa.int64()), names, *lists]
            return pa.RecordBatch.from_arrays(columns, names=["n_words", "ids", "lengths", "words", "vocabulary"])

        for batch in batches:
            names = batch.column(0).to_pylist()
            for part in wb.slices(batch.column(1)):
                low = wb.Texts(part.first, wb.lowered(part.data), part.offsets)
                starts, ends, bounds = wb.spans(low, wb.BARE)
                ids.append(names[part.first : part.first + len(part)])
                lengths.append(np.diff(bounds).astype(np.int32))
                hashed.append(wb.hashes(low.data, starts, ends))
                held += len(starts) + len(part)
                if held >= size:
                    yield block()
                    ids, lengths, hashed, held = [], [], [], 0
        if ids:
            yield block()

    bounded_batches(docs.sparkSession)
    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return cut_and_clear(chosen.mapInArrow(pack, BLOCKS).withColumn("block_id", F.monotonically_increasing_id()), "blocks")


def _grams(words: np.ndarray, lengths: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the n-grams within a document, by order, and the places of their last words."""
    place = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    yield words, np.arange(len(words))
    chained = words
    for size in range(2, order + 1):
        # Where a document has too few words before, the chain reaches into the one before and is not taken, now or later.
        chained = np.concatenate([words[:1], wb.mix(chained[:-1] * np.uint64(0x9FB21C651E98DF25) + words[1:])])
        at = np.flatnonzero(place >= size - 1)
        yield chained[at], at


def _opened(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's words as hashes and its documents' lengths."""
    kinds = {"words": np.int32, "lengths": np.int32, "vocabulary": np.uint64}
    words, lengths, vocabulary = (np.frombuffer(batch.column(name)[row].as_buffer(), kind) for name, kind in kinds.items())
    return vocabulary[words], lengths.astype(np.int64)


def _edges(rounds: int) -> np.ndarray:
    """The first hash of each round's range but the first."""
    return np.array([(k << 64) // rounds for k in range(1, rounds)], np.uint64)


def exploded(packed: DataFrame, order: int, turn: int = 0, rounds: int = 1) -> DataFrame:
    """Rows (gram, block_id, place, n): each block's different n-grams of a round, numbered by order and hash, with their number there."""

    ends = [0, *_edges(rounds).tolist(), 1 << 64]
    first_hash, hashes = (np.uint64(x % (1 << 64)) for x in (ends[turn], ends[turn + 1] - ends[turn]))

    def explode(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                block_id, first = batch.column("block_id")[row].as_py(), 0
                for grams, _ in _grams(*_opened(batch, row), order):
                    if rounds > 1:
                        grams = grams[grams - first_hash < hashes]
                    different, n = np.unique(grams, return_counts=True)
                    for low in range(0, len(different), _BATCH):
                        part = different[low : low + _BATCH].view(np.int64)
                        places = np.arange(first + low, first + low + len(part), dtype=np.int32)
                        columns = [pa.array(part), pa.array(np.full(len(part), block_id)), pa.array(places), pa.array(n[low : low + _BATCH].astype(np.int64))]
                        yield pa.RecordBatch.from_arrays(columns, names=["gram", "block_id", "place", "n"])
                    first += len(different)

    return packed.select("block_id", "words", "lengths", "vocabulary").mapInArrow(explode, "gram long, block_id long, place int, n long")


def totals(grams: DataFrame) -> DataFrame:
    """The count table: rows (gram, total, blocks) over all blocks.

    The last column tells a gram's rows; with it the count reads what :func:`asked_for` reads, so that both share an exchange.
    """
    return grams.groupBy("gram").agg(F.sum("n").alias("total"), F.expr("count(block_id, place)").alias("blocks"))


def asked_for(grams: DataFrame) -> DataFrame:
    """Rows (block_id, place, total) for the n-grams that other blocks hold too.

    Only their totals are hashed for the join, at most half a partition's rows, and no row is sorted.
    """
    shared = totals(grams).filter("blocks > 1").select("gram", "total")
    joined = grams.join(shared.hint("shuffle_hash"), "gram")
    return joined.filter("total > coalesce(n, 0)").select("block_id", "place", "total")  # "total > n" would filter this side's exchange by n


def gathered(answers: DataFrame, turn: int) -> DataFrame:
    """Rows (block_id, turn, places, totals): a partition's answers, a row a block, so that no answer is a row on its way there."""

    def gather(batches):
        held, n = [], 0

        def rows() -> Iterator[pa.RecordBatch]:
            block, place, total = (np.concatenate([batch.column(k).to_numpy() for batch in held]) for k in range(3))
            order = np.argsort(block, kind="stable")
            block = block[order]
            bounds = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]])
            columns = [pa.array(block[bounds[:-1]]), pa.array(np.full(len(bounds) - 1, turn, np.int32)), _binary(place[order], bounds), _binary(total[order], bounds)]
            yield pa.RecordBatch.from_arrays(columns, names=["block_id", "turn", "places", "totals"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= _GATHERED:
                yield from rows()
                held, n = [], 0
        if held:
            yield from rows()

    return answers.mapInArrow(gather, ANSWERS)


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Rows (doc_id, n_words, n_backoff, log_prob)."""
    packed = blocks(docs, doc_id, text, settings)
    order, alpha, unseen = settings.order, settings.alpha, settings.unseen
    n_words = packed.agg(F.sum("n_words")).first()[0] or 0
    rounds = min(settings.rounds, n_words * order // settings.part_rows + 1)
    parts = n_words * order // (settings.part_rows * rounds) + 1
    edges, answers = _edges(rounds), []
    for turn in range(rounds):
        grams = exploded(packed, order, turn, rounds).repartition(parts, "gram")
        with narrow_batches(docs.sparkSession):
            answers.append(cut_and_clear(gathered(asked_for(grams), turn), "totals"))
    more = reduce(DataFrame.unionAll, answers)

    def sum_up(key, left: pa.Table, right: pa.Table) -> pa.Table:
        places, found = _numbers(right["places"], np.int32), _numbers(right["totals"], np.int64)
        turns = np.repeat(right["turn"].to_numpy(), pc.binary_length(right["places"]).to_numpy() // 4)
        out = []
        for batch in left.to_batches():
            for row in range(batch.num_rows):
                words, lengths = _opened(batch, row)
                owner = np.repeat(np.arange(len(lengths)), lengths)
                all_others = np.maximum(1, n_words - lengths)[owner].astype(float)
                value, shorter, backoff, first = np.zeros(len(words)), np.zeros(0), np.zeros(len(words), np.int64), np.zeros(rounds, np.int64)
                for size, (ngrams, at) in enumerate(_grams(words, lengths, order), 1):
                    rough = np.argsort(ngrams)
                    lying = ngrams[rough]
                    new = np.concatenate([np.ones(min(1, len(lying)), bool), lying[1:] != lying[:-1]])
                    # By n-gram and, as places ascend, by document: equal ones lie together, those of one document too.
                    order_of = np.sort((np.cumsum(new) << 32) | rough) & 0xFFFFFFFF
                    different, total = lying[new], np.diff(np.append(np.flatnonzero(new), len(lying)))
                    starts = np.concatenate([[0], np.searchsorted(different, edges), [len(different)]])
                    held = np.diff(starts)  # of each round's numbers, this order has those from first to first + held
                    mine = (places >= first[turns]) & (places < (first + held)[turns])
                    totalled = total.copy()
                    totalled[places[mine] + (starts[:-1] - first)[turns[mine]]] = found[mine]
                    holder = owner[at[order_of]]
                    own = np.diff(np.append(np.flatnonzero(new | np.concatenate([new[:1], holder[1:] != holder[:-1]])), len(lying)))
                    others = np.empty(len(lying), np.int64)
                    others[order_of] = np.repeat(totalled, total) - np.repeat(own, own)
                    if size == 1:
                        value = np.maximum(others, unseen) / all_others
                    else:
                        seen = others > 0
                        value[at] = np.where(seen, others / np.maximum(1, shorter[at - 1]), alpha * value[at])
                        backoff[at] = np.where(seen, 0, backoff[at] + 1)
                    shorter = np.zeros(len(words), np.int64)
                    shorter[at] = others
                    first += held
                columns = [
                    batch.column("ids")[row].values,
                    pa.array(lengths, pa.int64()),
                    pa.array(wb.per_text(backoff, np.concatenate([[0], np.cumsum(lengths)])), pa.int64()),
                    pa.array(np.bincount(owner, np.log(value), minlength=len(lengths)), pa.float64()),
                ]
                out.append(pa.table(columns, names=["doc_id", "n_words", "n_backoff", "log_prob"]))
        return pa.concat_tables(out)

    asking, scored = packed.select("block_id", "ids", "words", "lengths", "vocabulary"), []
    shares = min(settings.shares, rounds)
    for share in range(shares):
        chosen = F.pmod(F.xxhash64("block_id"), F.lit(shares)) == share
        both = asking.filter(chosen).groupBy("block_id").cogroup(more.filter(chosen).groupBy("block_id"))
        scored.append(cut_and_clear(both.applyInArrow(sum_up, SCHEMA), "scored"))
    return reduce(DataFrame.unionAll, scored)
