import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from prefmill.llm import nearcopies, simhash
from tests.llm.cases import no_docs, odd_docs, words


def shingles(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4)))


def kept(texts, least=0.8):
    """The smallest id of each component of texts whose sets of shingles are alike, by all pairs that share one."""
    sets, parent, places = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}, {}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sorted(sets):
        near = {}
        for s in sets[i]:
            for j in places.setdefault(s, []):
                near[j] = near.get(j, 0) + 1
            places[s].append(i)
        for j, both in near.items():
            if both >= least * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i for i in texts if root(i) == i}


def changed(text, n, seed):
    r, ws = random.Random(seed), text.split()
    for k in r.sample(range(len(ws)), n):
        ws[k] = f"new{r.random()}"
    return " ".join(ws)


def made():
    texts = [words(k, 150 + k) for k in range(40)]
    texts += [changed(t, k % 6, k) for k, t in enumerate(texts)]
    # One large group of near copies, one of texts that share most of a page but not enough of it.
    texts += [changed(words(99, 200), 1, k) for k in range(60)]
    shared = words(98, 120)
    texts += [f"{shared} {words(500 + k // 2, 60)}" for k in range(60)]
    return dict(enumerate(texts + ["", None, " \n", "a b", "A  B", "a b c"]))


@pytest.mark.parametrize("cell, counters", [(1, 1 << 20), (1, 16), (5, 1 << 20), (32, 1)])
def test_near_copies_equal_brute_force(spark, cell, counters):
    texts = made()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = sorted(r["doc_id"] for r in nearcopies.one_of_each(docs.repartition(3), cell=cell, counters=counters).collect())
    assert got == sorted(kept(texts))


def test_operator_one_finds_copies_without_the_bands(spark):
    """Bands that never meet leave what operator 1 links, which is verified like any other pair."""
    t = words(5, 3000)
    docs = [(1, t), (2, changed(t, 1, 1)), (3, words(6, 3000)), (4, "a b c d e f"), (5, "a b c d e f a b c d e f g h i")]
    x, y = (simhash.fingerprint(text.encode(), 5) for _, text in docs[:2])
    assert ((x ^ y) & (1 << 64) - 1).bit_count() <= 2
    df = spark.createDataFrame(docs, "doc_id long, text string")
    marked = nearcopies.signatures(df, "doc_id", "text").withColumn("bands", F.array("doc_id"))
    nodes = nearcopies.cut(marked.withColumnRenamed("doc_id", "least"), "nodes")
    least = {r["node"]: r["least"] for r in nodes.collect()}
    found = nearcopies.links(df, nodes, "doc_id", "text").collect()
    assert {frozenset((least[r["a"]], least[r["b"]])) for r in found} == {frozenset((1, 2))}


def test_the_stage_drops_copies_with_a_changed_word_in_a_hundred(spark):
    docs = spark.createDataFrame([(1, t := words(5, 300)), (2, changed(t, 3, 1)), (3, words(6, 300))], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [1, 3]


def test_a_common_passage_pairs_nothing(spark):
    """10,000 texts that share three fifths of their words fill large cells, but their rarest shingles meet only in copies."""
    shared = words(97, 90)
    texts = {k: f"{shared} {words(10_000 + k // 2 if k < 200 else 20_000 + k, 40, 10**6)}" + (" end" if k % 2 else "") for k in range(10_000)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(8)
    marked = nearcopies.signatures(docs, "doc_id", "text")
    nodes = nearcopies.cut(marked.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("n").alias("n"), F.min("bands").alias("bands")), "nodes")
    sets = nearcopies._sets_of(nodes.select("node"), docs, nodes, "doc_id", "text")
    found = nearcopies._by_rare(sets, nodes.select("node", F.col("node").alias("component")), nearcopies.COUNTERS)
    assert found.count() < 300
    pairs = nearcopies.verified(found, sets)
    least = {r["node"]: r["least"] for r in nodes.collect()}
    assert sorted(tuple(sorted((least[r["a"]], least[r["b"]]))) for r in pairs.collect()) == [(k, k + 1) for k in range(0, 200, 2)]
    assert nearcopies.one_of_each(docs).count() == 9_900


def test_odd_rows_and_empty_tables(spark):
    docs = odd_docs(spark)
    one = nearcopies.one_of_each(docs)
    assert one.columns == docs.columns
    assert sorted(r["doc_id"] for r in one.filter(F.col("doc_id").isNotNull()).collect()) == [1, 2, 6, 7, 8, 9]
    assert one.filter("doc_id IS NULL").count() == 2
    assert nearcopies.one_of_each(no_docs(spark)).count() == 0


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="test tables are not here")
def test_recall_on_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = kept({r["doc_id"]: r["text"] for r in docs.collect()})
    assert {r["doc_id"] for r in nearcopies.one_of_each(docs).collect()} == truth
