"""Operator 13 against exhaustive search."""

import math

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from prefmill.llm import partitions as pt
from prefmill.llm.queries import op13_neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, node string, ids long"


def exact(rows, k=5, step=50):
    """Rows (query_id, rank, vec_id, score) of all (id, vector), by exhaustive search."""
    fine = lambda v: v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    kept = {(i, tuple(v)) for i, v in rows if fine(v)}
    out = []
    for q, v in kept:
        if q is None or q % step:
            continue
        scored = []
        for i, w in kept:
            if len(w) == len(v) and i != q:
                x, y = np.array(v, np.float64), np.array(w, np.float64)
                scored.append((-(x * y).sum() / (math.sqrt((x * x).sum()) * math.sqrt((y * y).sum())), i is None, i or 0, i))
        scored.sort()
        out += [(q, r + 1, i, -s) for r, (s, _, _, i) in enumerate(scored[:k])]
    return out


def same(found, expected):
    found, expected = sorted(found, key=str), sorted(expected, key=str)
    assert [f[:3] for f in found] == [e[:3] for e in expected]
    assert np.allclose([f[3] for f in found], [e[3] for e in expected], rtol=0, atol=1e-12)


def run(spark, rows, **settings):
    df = spark.createDataFrame([(i, v, 1, "clash", 7) for i, v in rows], SCHEMA)
    return [tuple(r) for r in pt.neighbours(df, F.col("vec_id") % 50 == 0, settings=pt.Settings(**settings)).collect()]


def test_odd_rows_equal_exhaustive_search(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.standard_normal(4).astype(np.float32).tolist()) for i in range(120)]
    same_vector = [1.0, 2.0, 0.5, -1.0]
    rows += [(i, same_vector) for i in (200, 201, 250, 300, 305, 306, 307, 308, 350)] + [(200, same_vector)]
    rows += [(500, [2.0, 4.0, 1.0, -2.0]), (501, [1.0, 0.0]), (550, [0.5, 0.1]), (600, [3.0]), (650, [-1.0]), (50, [9.0, 9.0, 9.0, 9.0])]
    rows += [(700, None), (701, [0.0, 0.0, 0.0, 0.0]), (750, [1.0, None, 0.0, 0.0]), (751, [math.nan, 1.0, 1.0, 1.0]), (800, [math.inf, 1.0, 1.0, 1.0]), (850, [])]
    rows += [(None, same_vector), (None, [1.0, 1.0, 1.0, 1.0]), (0, [3e38, 3e38, 1.0, 0.0]), (900, [1e-40, 1e-40, 0.0, 0.0])]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    # With every part searched, nothing can be missed; chunks and blocks of every size give the same.
    for settings in ({}, {"chunk": 3, "asked": 2}, {"leaf": 10, "parts": 4}):
        same(run(spark, rows, recall=2.0, **settings), exact(rows))


def test_small_and_empty_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0, 2.0])]) == []
    same(run(spark, [(0, [1.0, 2.0]), (1, [1.0, 3.0]), (50, [2.0, 4.0])]), exact([(0, [1.0, 2.0]), (1, [1.0, 3.0]), (50, [2.0, 4.0])]))
    assert run(spark, [(1, None), (0, [0.0])]) == []


def test_vectors_of_one_direction_end_the_cutting(spark):
    rows = [(i, [float(i + 1), float(i + 1)]) for i in range(200)]
    found = run(spark, rows, leaf=20, chunk=16)
    assert sorted({q for q, *_ in found}) == [0, 50, 100, 150] and all(abs(s - 1) < 1e-12 for *_, s in found) and len(found) == 20


def test_parts_are_balanced_and_follow_the_graph():
    r = np.random.default_rng(2)
    centres = r.standard_normal((8, 16)) * 6
    rows = pt._unit(np.concatenate([c + r.standard_normal((100, 16)) for c in centres]))
    near = pt.nearest(rows, rows, 10, np.arange(len(rows)))
    label = pt.balanced_parts(near, 8)
    assert np.bincount(label, minlength=8).tolist() == [100] * 8
    assert (label[near] == label[:, None]).mean() > 0.95
    weights, reach = pt.fit_node(rows, pt.Settings(parts=8))
    routed = pt._routed(pt._probabilities(rows, weights), reach)
    assert routed.sum(axis=1).mean() < 3


def recall(found, expected, k=5):
    by_query = {}
    for q, _, i, _ in expected:
        by_query.setdefault(q, set()).add(i)
    return np.mean([len({i for q2, _, i, _ in found if q2 == q} & ids) / len(ids) for q, ids in by_query.items()])


def exhaustive(sf_dir):
    table = pq.read_table(f"{sf_dir}/embeddings.parquet")
    ids, x = table["vec_id"].to_numpy(), pt._unit(np.stack(table["embedding"].to_pylist()).astype(np.float64))
    out = []
    for q in np.flatnonzero(ids % 50 == 0):
        s = x @ x[q]
        s[q] = -2
        out += [(int(ids[q]), r + 1, int(ids[i]), s[i]) for r, i in enumerate(np.argsort(-s, kind="stable")[:5])]
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_the_query(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    found = [tuple(r) for r in op13_neighbours(spark, sf_dir).collect()]
    expected = exhaustive(sf_dir)
    assert len(found) == len(expected)
    assert recall(found, expected) >= 0.9
    scores = {(q, i): s for q, _, i, s in expected}
    assert all(abs(s - scores[q, i]) < 1e-12 for q, _, i, s in found if (q, i) in scores)


def test_recall_over_two_levels(spark):
    sf_dir = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = pt.neighbours(table, F.col("vec_id") % 50 == 0, settings=pt.Settings(leaf=150, parts=8, recall=0.99))
    assert recall([tuple(r) for r in found.collect()], exhaustive(sf_dir)) >= 0.9
