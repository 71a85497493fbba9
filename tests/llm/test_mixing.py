import hashlib
import re

import pytest
from pyspark.sql import functions as F

from prefmill.llm import mixing
from tests.llm.cases import no_docs, odd_docs, odd_rows


def shared(sizes, weights=(5, 2, 1), most=3.0):
    """Targets by sharing again and again, source by source."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        share = (total - sum(full.values())) / max(1e-300, sum(weight[s] for s in rest)) if rest else 0.0
        over = [s for s in rest if share * weight[s] >= most * sizes[s]]
        if not over:
            return full | {s: share * weight[s] for s in rest}
        full |= {s: most * sizes[s] for s in over}


def drawn(doc_id):
    text = "" if doc_id is None else str(doc_id)
    return int(hashlib.md5(f"{text}:41".encode()).hexdigest()[:13], 16) / 2**52


def sized(rows):
    return [(i, source, len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))) for i, text, source in rows]


@pytest.mark.parametrize("n_sources", [1, 2, 7, 40])
def test_targets_and_copies_equal_plain_ones(spark, n_sources):
    names = [f"s{k}" for k in range(n_sources - 1)] + [None]
    rows = [(i, "w " * ((i * i) % 97 + (500 if i % 11 == 0 else 0)), names[(i * 7 + i // 5) % n_sources]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = {}
    for _, source, n in sized(rows):
        sizes[source] = sizes.get(source, 0) + n
    target = shared(sizes)
    got = {r["doc_id"]: r for r in mixing.copies(docs).collect()}
    for i, source, n in sized(rows):
        rate = target[source] / sizes[source] if sizes[source] else 0.0
        assert got[i]["size"] == n and got[i]["source_size"] == sizes[source]
        assert got[i]["target"] == pytest.approx(target[source])
        assert got[i]["copies"] == int(rate + 1e-9) + (drawn(i) < rate - int(rate + 1e-9) - 1e-12)
        assert got[i]["copies"] <= 3


def test_many_sources_keep_their_order(spark):
    names = [f"{k:03d}" for k in range(500)]
    ranked = mixing.ranked(spark.createDataFrame([(n,) for n in reversed(names)], "source string").repartition(7), "source")
    assert {r["source"]: r["place"] for r in ranked.collect()} == {n: k for k, n in enumerate(names)}


def test_mix_comes_near_its_targets_and_repeats_itself(spark):
    rows = [(i, "w " * (50 + i % 40), f"s{i % 3}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = mixing.mixed(docs)
    assert taken.columns == ["doc_id", "text", "source", "copy"]
    by_source = taken.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()
    target = {r["source"]: r["target"] for r in mixing.copies(docs).collect()}
    assert all(abs(r["n"] / target[r["source"]] - 1) < 0.05 for r in by_source)
    again = mixing.mixed(docs.repartition(5))
    assert taken.exceptAll(again).count() == 0 and again.exceptAll(taken).count() == 0


def test_plan_stays_native(spark):
    plan = mixing.mixed(odd_docs(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_odd_rows_and_empty_tables(spark):
    taken = mixing.mixed(odd_docs(spark))
    assert taken.columns == [*odd_docs(spark).columns, "copy"] and {r["size"] for r in taken.collect()} == {7}
    rows = mixing.copies(odd_docs(spark)).collect()
    assert len(rows) == len(odd_rows())
    assert all(r["size"] == len((r["text"] or "").split()) or r["doc_id"] in (7,) for r in rows)
    assert mixing.copies(no_docs(spark)).count() == 0 and mixing.mixed(no_docs(spark)).count() == 0
    empty = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r["target"], r["copies"]) for r in mixing.copies(empty).collect()] == [(0.0, 0), (0.0, 0)]


def test_rows_without_an_id_are_drawn_one_by_one(spark):
    docs = spark.createDataFrame([(None, f"{'a ' * 10}{k}", "s") for k in range(1000)] + [(k, "b " * 15, "t") for k in range(1000)], "doc_id long, text string, source string")
    by_source = {r["source"]: r for r in mixing.copies(docs).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("target").alias("target")).collect()}
    assert all(abs(r["taken"] / r["target"] - 1) < 0.06 for r in by_source.values())
