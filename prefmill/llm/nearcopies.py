"""The pipeline's near-duplicates: shingles of five words, Jaccard similarity of at least 0.8, verified exactly.

Candidates come from operator 1 first: SimHash fingerprints, of shingles of five words here, linked within two bits by its cells
and pivot distances; each text of a component of fingerprints is held against the component's first. Texts of a similarity of
0.8 need not lie within two bits: a SimHash bit differs with probability 0.15 there, so distances to any pivot differ by as much
as those of unrelated texts do, and cells of 24 sampled bits would take some 600 tables to miss as few pairs as the
bands below. So those that operator 1 leaves apart meet by MinHash bands:
24 bands of four least hashes miss a pair of similarity 0.8 with probability (1 - 0.8^4)^24, about three in a million,
and more similar ones less. Candidates are then held against each other by all their shingles.

Size. Texts with equal shingles are one node. A cell (band value) of up to ``CELL`` nodes is paired. In a larger one all nodes
are held against its hub, the node that shares most cells with others. Nodes of large cells that this leaves in several
components meet by their rarest shingles: in a common order of shingles, similar sets share one of the first
ninth of the shorter and the first fifth of the longer. What many texts share comes last in that order, so common passages
pair nothing. The order comes from a table of ``COUNTERS`` hashed counts; any order is right, rare first is quick.
Nothing is capped. Texts that share even their rarest shingles without being similar are still paired.

Defined results: words and their lower case are operator 1's; fewer than five words make one shingle, no words one empty
shingle. Rows with a null id are left alone. Equal ids are one document for the component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefmill.llm import wordbytes as wb
from prefmill.llm.components import components
from prefmill.llm.simhash import fingerprint, only
from prefmill.llm.simhash import links as linked_prints
from prefmill.llm.tables import cut, map_batches

SHINGLE = 5
#: Least similarity of a link, as a fraction.
LEAST = (4, 5)
BANDS, ROWS = 24, 4
#: Nodes a cell may hold to be paired.
CELL = 32
COUNTERS = 1 << 20

_random = np.random.default_rng(42)
_XOR = _random.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_TIMES = _random.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)


def _shingles(part: wb.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, and each text's first; every text has one."""
    low = wb.LOWER[part.data]
    starts, ends, bounds = wb.spans(wb.Texts(part.first, low, part.offsets), wb.WORD)
    hashed = wb.hashes(low, starts, ends)
    grams = wb.chain(hashed, wb.whole(bounds, SHINGLE), tuple(range(SHINGLE)))
    n = np.maximum(0, np.diff(bounds) - SHINGLE + 1)
    short = np.flatnonzero(n == 0)
    if len(short):
        alone = [wb.chain(hashed, bounds[i : i + 1], tuple(range(bounds[i + 1] - bounds[i])))[0] for i in short]
        grams = np.insert(grams, np.concatenate([[0], np.cumsum(n)])[short], np.array(alone, np.uint64))
    return grams, np.concatenate([[0], np.cumsum(np.maximum(1, n))])


def _node(grams: np.ndarray) -> int:
    """A 64-bit hash of a set, given in order."""
    return int(wb.hashes(grams.view(np.uint8), np.zeros(1, np.int64), np.array([grams.nbytes]))[0].astype(np.int64))


def _bands(grams: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The band values, one row a text; a value tells its band."""
    out = np.empty((len(firsts), BANDS), np.uint64)
    for band in range(BANDS):
        value = np.full(len(firsts), band, np.uint64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            least = np.minimum.reduceat((grams ^ _XOR[k]) * _TIMES[k], firsts)
            value = wb.mix(value * np.uint64(0x9FB21C651E98DF25) + least)
        out[:, band] = value
    return out.view(np.int64)


def signatures(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows (doc_id, node, n, bands, fp): the hash and size of the set of shingles, its band values, and operator 1's fingerprint."""

    def compute(batch: pa.RecordBatch) -> pa.RecordBatch:
        nodes, sizes, bands, prints = [], [], [], []
        for part in wb.slices(batch.column(1)):
            grams, bounds = _shingles(part)
            bands.append(_bands(grams, bounds[:-1]))
            for i in range(len(part)):
                own = np.unique(grams[bounds[i] : bounds[i + 1]])
                nodes.append(_node(own))
                sizes.append(len(own))
                prints.append(fingerprint(part.text(i), SHINGLE))
        values = pa.array(np.concatenate(bands).reshape(-1))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, BANDS), pa.int32()), values)
        columns = [batch.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), lists, pa.array(prints, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "n", "bands", "fp"])

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id IS NOT NULL")
    return map_batches(chosen, compute, "doc_id long, node long, n long, bands array<long>, fp long")


def _sets(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows (node, grams): the shingles of each set, in order."""

    def compute(batch: pa.RecordBatch) -> pa.RecordBatch:
        nodes, sets = [], []
        for part in wb.slices(batch.column(0)):
            grams, bounds = _shingles(part)
            for i in range(len(part)):
                own = np.unique(grams[bounds[i] : bounds[i + 1]])
                nodes.append(_node(own))
                sets.append(own.tobytes())
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "grams"])

    return map_batches(docs.select(F.col(text).alias("text")), compute, "node long, grams binary")


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sets is at least ``LEAST``."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both * LEAST[1] >= (len(x) + len(y) - both) * LEAST[0]


def _sets_of(ends: DataFrame, docs: DataFrame, nodes: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The sets of the given nodes (one column)."""
    ids = nodes.join(ends, "node", "left_semi").select(F.col("least").alias("_least")).distinct()
    texts = docs.join(ids, F.col(doc_id).cast("long") == F.col("_least"), "left_semi")
    return cut(_sets(texts, doc_id, text).join(ends, "node", "left_semi").dropDuplicates(["node"]), "sets")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that are similar enough."""

    def check(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, y = (batch.column(k).to_pylist() for k in (2, 3))
        fine = [similar(np.frombuffer(i, np.uint64), np.frombuffer(j, np.uint64)) for i, j in zip(x, y, strict=True)]
        return batch.select(["a", "b"]).filter(pa.array(fine, pa.bool_()))

    first = sets.select(F.col("node").alias("a"), F.col("grams").alias("x"))
    second = sets.select(F.col("node").alias("b"), F.col("grams").alias("y"))
    return map_batches(pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y"), check, "a long, b long")


def _of_pairs(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, doc_id: str, text: str) -> DataFrame:
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return verified(pairs, _sets_of(ends, docs, nodes, doc_id, text))


def _sized(x: str, y: str):
    """Whether two sets of these sizes can be similar enough."""
    return F.least(x, y) * LEAST[1] >= F.greatest(x, y) * LEAST[0]


def _counters(sets: DataFrame, counters: int) -> np.ndarray:
    """How many of the sets' shingles fall to each counter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(counters, np.int64)
        for batch in batches:
            for grams in batch.column(0).to_pylist():
                np.add.at(total, (np.frombuffer(grams, np.uint64) % np.uint64(counters)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    found = sets.select("grams").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(counters, np.int64)
    out[found["at"].to_numpy()] = found["n"].to_numpy()
    return out


def rare(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of a set, the first fifth in the common order with their places from 1; and how long the first ninth is."""
    n = len(grams)
    many = counts[(grams % np.uint64(len(counts))).astype(np.int64)]
    order = np.lexsort((grams, many))[: n - -(-LEAST[0] * n // LEAST[1]) + 1]
    alone = many[order] == 1
    return grams[order[~alone]], np.flatnonzero(~alone) + 1, n - -(-2 * LEAST[0] * n // sum(LEAST)) + 1


def _by_rare(sets: DataFrame, named: DataFrame, counters: int) -> DataFrame:
    """Candidate pairs (a, b) of nodes in different components. ``named`` has (node, component)."""
    shared = sets.sparkSession.sparkContext.broadcast(_counters(sets, counters))

    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for node, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            grams = np.frombuffer(packed, np.uint64)
            found, places, short = rare(grams, shared.value)
            out.append((np.full(len(found), node), np.full(len(found), len(grams)), found.view(np.int64), places, places <= short))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["node", "n", "gram", "place", "early"])

    rows = map_batches(sets.select("node", "grams"), spread, "node long, n long, gram long, place long, early boolean")
    rows = cut(rows.join(named, "node"), "rare")
    x, y = rows.filter("early").alias("x"), rows.alias("y")
    left = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")) + 1
    enough = left * (LEAST[0] + LEAST[1]) >= (F.col("x.n") + F.col("y.n")) * LEAST[0]
    ordered = F.struct("x.n", "x.node") < F.struct("y.n", "y.node")
    met = x.join(y, (F.col("x.gram") == F.col("y.gram")) & ordered & (F.col("x.component") != F.col("y.component")) & _sized("x.n", "y.n") & enough)
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _by_prints(nodes: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of operator 1: the nodes of a component of fingerprints with its first node."""
    prints = cut(components(linked_prints(nodes.select("fp").distinct())), "prints").select(F.col("node").alias("fp"), "component")
    grouped = nodes.select("node", "n", "fp").join(prints, "fp", "left").select("node", "n", F.coalesce("component", "fp").alias("component"))
    hubs = grouped.groupBy("component").agg(F.min(F.struct("node", "n")).alias("hub"), F.count(F.lit(1)).alias("held")).filter("held > 1")
    met = grouped.join(hubs, "component").filter((F.col("node") != F.col("hub.node")) & _sized("n", "hub.n"))
    return met.select(F.col("hub.node").alias("a"), F.col("node").alias("b"))


def links(docs: DataFrame, nodes: DataFrame, doc_id: str, text: str, cell: int = CELL, counters: int = COUNTERS) -> DataFrame:
    """Rows (a, b) of similar nodes: every candidate pair of small cells, and enough of large ones to connect them."""
    cells = nodes.select("node", "n", F.explode("bands").alias("key"))
    sizes = cells.groupBy("key").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    full = cut(cells.join(sizes, "key"), "bands")
    small, large = full.filter(F.col("held") <= cell), full.filter(F.col("held") > cell)
    a, b = small.alias("a"), small.alias("b")
    paired = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node")) & _sized("a.n", "b.n"))
    paired = paired.select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))
    known = large.groupBy("node").agg(F.sum("held").alias("known"))
    hubs = large.join(known, "node").groupBy("key").agg(F.max(F.struct("known", "node", "n")).alias("hub"))
    spokes = large.join(hubs, "key").filter((F.col("node") != F.col("hub.node")) & _sized("n", "hub.n"))
    spokes = spokes.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b"))
    found = cut(_of_pairs(cut(_by_prints(nodes).unionByName(paired).unionByName(spokes).distinct(), "pairs"), docs, nodes, doc_id, text), "found")
    if large.isEmpty():
        return found
    # What the hubs did not connect: nodes of large cells that lie in several components.
    named = components(found).select("node", "component")
    members = cut(large.join(named, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component")), "members")
    split = members.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key")
    apart = cut(members.join(split, "key", "left_semi").select("node", "component").distinct(), "apart")
    sets = _sets_of(apart.select("node"), docs, nodes, doc_id, text)
    return found.unionByName(verified(cut(_by_rare(sets, apart, counters), "pairs"), sets))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", cell: int = CELL, counters: int = COUNTERS) -> DataFrame:
    """One document of each component of similar texts, the one with the smallest id, with the input's columns."""
    marked = cut(signatures(docs, doc_id, text), "signatures")
    least = [F.min(c).alias(name) for c, name in (("doc_id", "least"), ("n", "n"), ("bands", "bands"), ("fp", "fp"))]
    nodes = cut(marked.groupBy("node").agg(*least), "nodes")
    found = cut(components(links(docs, nodes, doc_id, text, cell, counters)), "components")
    grouped = nodes.select("node", "least").join(found, "node", "left").select("least", F.coalesce("component", "node").alias("component"))
    kept = grouped.groupBy("component").agg(F.min("least").alias("kept")).select("kept")
    return only(docs, kept.distinct(), doc_id, text)
