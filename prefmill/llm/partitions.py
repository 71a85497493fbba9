"""Operator 13, approximate nearest neighbours by cosine: learned partitions.

A bounded sample of a node's vectors becomes a graph that ties each to its nearest neighbours. The graph is cut into
``parts`` of equal size by halving it again and again: by the median of its second eigenvector, then by exchanging pairs
of nodes while that cuts fewer ties. A small classifier (softmax regression) learns, from each sampled vector, how its
neighbours are spread over the parts. It then places every vector in its most probable part, sampled or not, and routes a
query to its most probable parts, as many as it takes to reach a probability that, on vectors left out of the fit, covers
``recall`` of their neighbours. A part with more than ``leaf`` vectors is a node of its own and cut again. The query's
parts are searched exhaustively and the nearest ranked by exact double-precision cosine.

Size. A node's sample is at most about ``sample`` vectors, chosen by hash; every vector is indexed. Equal vectors are one,
with the ``k + 1`` smallest of their ids, which is all that any query can return of them. Models go round in broadcasts of
at most ``MODELS_AT_ONCE``. Leaves are searched in chunks of at most about ``chunk`` vectors, so that a leaf that cannot
be cut (vectors of one direction) is no large task; each chunk sends on the best ``k`` of a query.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part. Vectors are compared
with those of their own length only. Rows with equal id and vector are one; an id with several vectors asks with each, and
no row with the query's id is its neighbour. Rows with a null id are found, after others among equals, but do not ask.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefmill.llm.tables import cut


@dataclass(frozen=True)
class Settings:
    k: int = 5
    parts: int = 16
    #: Vectors a leaf may hold before it is cut again, and vectors searched in one task's group.
    leaf: int = 32768
    chunk: int = 4096
    #: Queries in one task's group.
    asked: int = 32768
    #: Vectors a node's model is fitted on; a fifth of them sets the probability to reach.
    sample: int = 4096
    neighbours: int = 10
    #: Share of neighbours that the routed parts of one node are to hold.
    recall: float = 0.95


MODELS_AT_ONCE = 2048
_SALTS = 16


def _scaled(rows: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that squares neither overflow nor vanish."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, initial=0))[1][:, None])


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = _scaled(rows)
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def nearest(queries: np.ndarray, vectors: np.ndarray, k: int, own: np.ndarray | None = None) -> np.ndarray:
    """Places of the ``k`` nearest unit vectors; ``own`` are the queries' places, left out."""
    out = []
    for at in range(0, len(queries), 512):
        scores = queries[at : at + 512] @ vectors.T
        if own is not None:
            scores[np.arange(len(scores)), own[at : at + 512]] = -2
        out.append(np.argpartition(-scores, k - 1, axis=1)[:, :k])
    return np.concatenate(out)


def _ties(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both ends of every tie, each tie in both directions."""
    a = np.repeat(np.arange(len(near)), near.shape[1])
    b = near.reshape(-1)
    keys = np.unique(np.concatenate([a * len(near) + b, b * len(near) + a]))
    return keys // len(near), keys % len(near)


def _halve(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which half each of ``n`` nodes is in: halves of equal size (but for an odd node), few ties between them."""
    degree = np.maximum(1.0, np.bincount(a, minlength=n))
    root = np.sqrt(degree)
    first = root / np.sqrt((root * root).sum())
    x = np.random.default_rng(n).standard_normal(n)
    for _ in range(80):
        x -= first * (first @ x)
        x = 0.5 * (x + np.bincount(a, (x / root)[b], n) / root)
        x /= max(1e-300, np.sqrt(x @ x))
    side = np.zeros(n, bool)
    side[np.argsort(x / root, kind="stable")[n // 2 :]] = True
    for _ in range(20):
        across = np.bincount(a, side[a] != side[b], n)
        gain = 2 * across - np.bincount(a, minlength=n)
        left, right = (np.flatnonzero(side == s) for s in (False, True))
        left, right = (h[np.argsort(-gain[h], kind="stable")] for h in (left, right))
        m = min(len(left), len(right))
        many = int((gain[left[:m]] + gain[right[:m]] > 0).sum())
        if not many:
            break
        # Exchange a shrinking number of the best pairs until fewer ties are cut.
        while many:
            trial = side.copy()
            trial[left[:many]], trial[right[:many]] = True, False
            if (trial[a] != trial[b]).sum() < across.sum():
                side = trial
                break
            many //= 2
        if not many:
            break
    return side


def balanced_parts(near: np.ndarray, parts: int) -> np.ndarray:
    """The part of each node of a neighbour graph; sizes differ by one at most for each halving."""
    n = len(near)
    label = np.zeros(n, np.int64)
    a, b = _ties(near)
    width = 1
    while width < parts:
        for part in range(width):
            inside = np.flatnonzero(label == part)
            if len(inside) < 2:
                continue
            place = np.full(n, -1)
            place[inside] = np.arange(len(inside))
            held = (place[a] >= 0) & (place[b] >= 0)
            side = _halve(place[a[held]], place[b[held]], len(inside))
            label[inside] += width * side
        width *= 2
    return label


def _probabilities(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    z = rows @ weights[:-1] + weights[-1]
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _fitted(rows: np.ndarray, spread: np.ndarray, steps: int = 300, decay: float = 1e-4) -> np.ndarray:
    """Softmax regression on soft labels, by Adam over all rows."""
    full = np.hstack([rows, np.ones((len(rows), 1))])
    w, m, v = (np.zeros((full.shape[1], spread.shape[1])) for _ in range(3))
    for t in range(1, steps + 1):
        g = full.T @ (_probabilities(rows, w) - spread) / len(rows) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w


def _routed(probability: np.ndarray, reach: float) -> np.ndarray:
    """Which parts are searched: the most probable ones until their sum is at least ``reach``."""
    order = np.argsort(-probability, axis=1, kind="stable")
    ranked = np.take_along_axis(probability, order, axis=1)
    before = np.cumsum(ranked, axis=1) - ranked
    out = np.zeros(probability.shape, bool)
    np.put_along_axis(out, order, before < reach, axis=1)
    return out


def fit_node(vectors: np.ndarray, settings: Settings) -> tuple[np.ndarray, float]:
    """Weights of a node's classifier, and the probability a query's parts must reach."""
    rows = _unit(vectors)
    if len(rows) < 3:
        return np.zeros((rows.shape[1] + 1, settings.parts)), 1.1
    near = nearest(rows, rows, min(settings.neighbours, len(rows) - 1), np.arange(len(rows)))
    label = balanced_parts(near, settings.parts)
    spread = np.zeros((len(rows), settings.parts))
    np.add.at(spread, (np.arange(len(rows))[:, None], label[near]), 1.0 / near.shape[1])
    held = np.arange(len(rows)) % 5 == 0
    weights = _fitted(rows[~held], spread[~held])
    # Where the classifier places the neighbours of the vectors left out, against the parts it routes them to.
    probability = _probabilities(rows, weights)
    placed = probability.argmax(axis=1)
    found = near[held][:, : settings.k] if near.shape[1] >= settings.k else near[held]
    for reach in np.arange(0.30, 0.9999, 0.02):
        routed = _routed(probability[held], reach)
        if np.take_along_axis(routed, placed[found], axis=1).mean() >= settings.recall:
            return weights, float(reach)
    return weights, 1.1


def clean(df: DataFrame, asks: Column, vec_id: str, vector: str) -> DataFrame:
    """Rows (id, v, asks) of the vectors that can be compared."""
    big = F.array_max(F.transform("v", F.abs))
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (big > 0)
    chosen = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(asks, F.lit(False)).alias("asks"))
    return chosen.filter(F.coalesce(fine, F.lit(False)))


def _draw(v: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(13), v), 11).cast("double") / F.lit(float(1 << 53))


def _fit(members: DataFrame, large: DataFrame, settings: Settings) -> DataFrame:
    """Rows (node, weights, dim, reach) for the nodes in ``large`` (node, n)."""

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        vectors = np.stack(group.sort_values("draw")["v"].to_list()[: 2 * settings.sample])
        weights, reach = fit_node(vectors, settings)
        return pd.DataFrame({"node": [group["node"].iloc[0]], "weights": [weights.astype("<f8").tobytes()], "reach": [reach]})

    drawn = members.join(large, "node").withColumn("draw", _draw(F.col("v"))).filter(F.col("draw") * F.col("n") < settings.sample)
    return drawn.select("node", "v", "draw").groupBy("node").applyInPandas(fit, "node string, weights binary, reach double")


def _applied(rows: DataFrame, models: list, settings: Settings, queries: bool) -> DataFrame:
    """Rows moved from a node to one of its parts, or, if queries, to each they are routed to."""
    shared = rows.sparkSession.sparkContext.broadcast({r["node"]: (bytes(r["weights"]), r["reach"]) for r in models})
    schema = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = np.array(batch.column("node").to_pylist(), object)
            for node in np.unique(nodes) if len(nodes) else ():
                packed, reach = shared.value[node]
                some = batch.filter(pa.array(nodes == node))
                vectors = some.column("v").flatten().to_numpy().reshape(some.num_rows, -1)
                weights = np.frombuffer(packed, "<f8").reshape(-1, settings.parts)
                probability = _probabilities(_unit(vectors), weights)
                routed = _routed(probability, reach) if queries else probability.argmax(axis=1)[:, None] == np.arange(settings.parts)
                at, part = np.nonzero(routed)
                taken = some.take(pa.array(at))
                path = pa.array([f"{node}.{p}" for p in part.tolist()], pa.string())
                yield taken.set_column(taken.schema.get_field_index("node"), "node", path)

    return rows.filter(F.col("node").isin([r["node"] for r in models])).mapInArrow(run, schema)


def index(members: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, list[DataFrame]]:
    """Every vector in its leaf (column ``node``), and the models of each level."""
    levels, leaves = [], []
    nodes = members
    while True:
        sizes = cut(nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n")), "nodes")
        # A node whose vectors did not part is a leaf, however large.
        large = sizes.filter(F.col("n") > settings.leaf)
        if levels:
            parents = previous.withColumnRenamed("n", "whole").withColumnRenamed("node", "parent")
            parent = F.regexp_replace("node", r"\.[0-9]+$", "")
            large = large.withColumn("parent", parent).join(parents, "parent").filter("n < whole").select("node", "n")
        else:
            # The first cut is made at any size, so that small tables are searched by the same method.
            large = sizes.filter(F.col("n") > 1)
        large = cut(large, "large")
        leaves.append(nodes.join(large.select("node"), "node", "left_anti"))
        if large.isEmpty():
            break
        models = cut(_fit(nodes, large, settings), "models")
        levels.append(models)
        nodes, previous = cut(_moved(nodes.join(large.select("node"), "node", "left_semi"), models, settings, False), "members"), sizes
    out = leaves[0]
    for more in leaves[1:]:
        out = out.unionByName(more)
    return out, levels


def _moved(rows: DataFrame, models: DataFrame, settings: Settings, queries: bool) -> DataFrame:
    """``_applied`` with some models at a time."""
    out, held = None, []
    for model in models.toLocalIterator():
        held.append(model)
        if len(held) == MODELS_AT_ONCE:
            part = cut(_applied(rows, held, settings, queries), "moved")
            out, held = part if out is None else out.unionByName(part), []
    if held:
        part = _applied(rows, held, settings, queries)
        out = part if out is None else out.unionByName(part)
    return out


def route(queries: DataFrame, levels: list[DataFrame], settings: Settings = Settings()) -> DataFrame:
    """Every query once for each leaf it is routed to."""
    out, nodes = [], queries
    for models in levels:
        inner = models.select("node")
        out.append(nodes.join(inner, "node", "left_anti"))
        nodes = cut(_moved(nodes.join(inner, "node", "left_semi"), models, settings, True), "routed")
    found = nodes
    for more in out:
        found = found.unionByName(more)
    return found


def _cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, the same for the same two vectors wherever they lie."""
    x, y = _scaled(x), _scaled(y)
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def _search(queries: pa.Table, members: pa.Table, k: int) -> pa.Table:
    """The best ``k`` of one chunk for each query in it."""
    kinds = pa.schema([("query_no", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    if not queries.num_rows or not members.num_rows:
        return kinds.empty_table()
    x, y = (t["v"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1) for t in (queries, members))
    lists = members["ids"].combine_chunks()
    sizes, ids = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten()
    no_id, id_values = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
    first = np.concatenate([[0], np.cumsum(sizes)])
    own = queries["id"].to_numpy()
    numbers = queries["query_no"].to_numpy()
    unit_x, unit_y = _unit(x), _unit(y)
    out = []
    for at in range(0, len(x), 256):
        scores = unit_x[at : at + 256] @ unit_y.T
        most = min(k + 1, scores.shape[1])  # one of them may hold no id but the query's own
        floor = np.partition(scores, -most, axis=1)[:, -most] - 1e-9
        q, m = np.nonzero(scores >= floor[:, None])
        exact = _cosine(x[at + q], y[m])
        spread = np.repeat(np.arange(len(q)), sizes[m])
        inner = np.arange(len(spread)) - np.repeat(np.cumsum(sizes[m]) - sizes[m], sizes[m])
        place = first[m[spread]] + inner
        q, exact = q[spread] + at, exact[spread]
        keep = no_id[place] | (id_values[place] != own[q])
        q, exact, place = q[keep], exact[keep], place[keep]
        order = np.lexsort((id_values[place], no_id[place], -exact, q))
        q, exact, place = q[order], exact[order], place[order]
        best = np.arange(len(q)) - np.searchsorted(q, q) < k
        q, exact, place = q[best], exact[best], place[best]
        out.append(pa.table([pa.array(numbers[q]), pa.array(own[q]), ids.take(pa.array(place)), pa.array(exact)], schema=kinds))
    return pa.concat_tables(out)


def neighbours(
    table: DataFrame, asks: Column, vec_id: str = "vec_id", vector: str = "embedding", settings: Settings = Settings()
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the ``k`` nearest found for each row that ``asks``, a condition on the table."""
    k = settings.k
    rows = cut(clean(table, asks, vec_id, vector), "vectors")
    root = F.concat(F.lit("d"), F.size("v"))
    # The smallest k + 1 ids of each different vector; by salt first, as one vector may be very common.
    order = Window.partitionBy("v", "salt").orderBy(F.col("id").asc_nulls_last())
    ids = rows.select("id", "v").distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(_SALTS)))
    ids = ids.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k + 1)
    grouped = ids.groupBy("v").agg(F.array_sort(F.collect_list(F.struct(F.col("id").isNull().alias("none"), "id"))).alias("ids"))
    members = cut(grouped.select("v", F.slice("ids", 1, k + 1)["id"].alias("ids"), root.alias("node")), "different")
    placed, levels = index(members, settings)
    queries = rows.filter("asks AND id IS NOT NULL").select("id", "v").distinct()
    queries = cut(queries.select(F.xxhash64("id", "v").alias("query_no"), "id", "v", root.alias("node")), "queries")
    routed = route(queries, levels, settings)
    # A leaf's vectors are dealt over chunks and its queries over blocks, both by hash; every block meets every chunk.
    sizes = [
        df.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / at_once).cast("int").alias(name))
        for df, at_once, name in ((placed, settings.chunk, "chunks"), (routed, settings.asked, "blocks"))
    ]
    sizes = cut(sizes[0].join(sizes[1], "node"), "leaves")
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    placed = placed.join(sizes, "node").select("node", "v", "ids", dealt("v", "chunks").alias("chunk"), each("blocks").alias("block"))
    routed = routed.join(sizes, "node").select("node", "v", "id", "query_no", each("chunks").alias("chunk"), dealt("query_no", "blocks").alias("block"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        return _search(left, right, k)

    keys = ["node", "chunk", "block"]
    found = routed.groupBy(*keys).cogroup(placed.groupBy(*keys)).applyInArrow(search, "query_no long, query_id long, vec_id long, score double")
    best = Window.partitionBy("query_no", "query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
