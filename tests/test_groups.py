"""Components over shared keys: no key crosses a split."""

import random

from pyspark.sql import functions as F

from prefmill.operators.groups import component_sizes, split_by_keys, with_components


def plain(rows):
    """Component of each row by union-find."""
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for _, *keys in rows:
        own = [f"{n}={k}" for n, k in zip("ab", keys) if k is not None]
        for k in own:
            x, y = root(own[0]), root(k)
            parent[max(x, y)] = min(x, y)
    return {i: min(root(f"{n}={k}") for n, k in zip("ab", keys) if k is not None) if any(k is not None for k in keys) else None for i, *keys in rows}


def frame(spark, rows):
    return spark.createDataFrame(rows, "i int, a string, b int").repartition(3)


def made():
    r = random.Random(4)
    rows = [(i, f"p{r.randrange(300)}", r.randrange(400)) for i in range(250)]
    rows += [(1000 + i, f"chain{i}", i + 1000) for i in range(150)] + [(2000 + i, f"chain{i + 1}", i + 1000) for i in range(150)]
    rows += [(3000 + i, "hub", 5000 + i) for i in range(200)]
    return [*rows, (4000, None, None), (4001, None, 1), (4002, "p1", None), (4003, None, None), (4002, "p1", None)]


def test_components_equal_union_find(spark):
    rows = made()
    found = {r["i"]: r["component"] for r in with_components(frame(spark, rows), ["a", "b"]).collect()}
    assert found == plain(rows)
    assert with_components(frame(spark, rows).limit(0), ["a", "b"]).count() == 0


def test_no_key_crosses_and_shares_are_met(spark):
    rows = [(i, f"p{i % 2000}", i // 2) for i in range(0, 4000, 3)] + [(10_000 + i, None, None) for i in range(2000)]
    first, second = split_by_keys(frame(spark, rows), ["a", "b"], "i", 0.8)
    assert first.columns == ["i", "a", "b"]
    for key in ("a", "b"):
        assert first.filter(F.col(key).isNotNull()).join(second, key).count() == 0
    assert first.count() + second.count() == len(rows) and abs(first.count() / len(rows) - 0.8) < 0.05


def test_a_giant_component_is_reported(spark):
    rows = [(i, "same", i) for i in range(90)] + [(100 + i, f"p{i}", 1000 + i) for i in range(10)]
    sizes = component_sizes(with_components(frame(spark, rows), ["a", "b"]), 0.05).collect()
    assert [(r["component"], r["n_rows"], r["share"]) for r in sizes] == [("a=same", 90, 0.9)]
