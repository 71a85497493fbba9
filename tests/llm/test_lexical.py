"""Operator 11 against plain scores."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefmill.llm import lexical
from prefmill.llm.queries import OP11_SQL, op11_lexical
from tests.llm.cases import no_docs, odd_docs, words
from tests.oracle import compare, connect

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = "item_id long, text string, doc_id string, score double"


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def plain(docs, items, top=20):
    """Rows (item_id, rank, doc_id, score) of documents and items given as (id, text)."""
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for i, c in counted:
            m = 75 + 25 * sum(c.values()) * n_docs // n_terms
            score = 0
            for t in terms(text):
                if t in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (10**9 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def run(docs, wanted, **settings):
    found = lexical.search(docs, wanted, settings=lexical.Settings(**settings))
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_odd_rows_equal_plain_scores(spark):
    items = [(1, words(2, 80)), (2, "ünïcode ÉTÉ жук X"), (3, None), (4, "no.such-term"), (None, words(3, 40)), (1, "x"), (1, "x"), (5, " .. "), (6, "1234 1234 5678")]
    frame = spark.createDataFrame([(i, t, "clash", 0.0) for i, t in items], ITEMS)
    docs = odd_docs(spark)
    expected = plain([(r["doc_id"], r["text"]) for r in docs.collect()], items)
    assert run(docs, frame) == expected
    assert run(docs, frame, items=2, tile_terms=7, tile_docs=3) == expected


def test_ties_and_cuts_do_not_depend_on_tiles(spark):
    r = random.Random(5)
    texts = [" ".join(r.choices("abcdefgh", k=r.randrange(1, 5))) for _ in range(400)]
    docs = [(r.randrange(1000), t) for t in texts]
    items = [(i, " ".join(r.choices("abcdefghz", k=6))) for i in range(12)]
    expected = plain(docs, items, 5)
    frame, wanted = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for parts, settings in ((1, {}), (7, {"tile_docs": 16, "tile_terms": 3}), (4, {"items": 5, "tile_docs": 1})):
        assert run(frame.repartition(parts), wanted, top=5, **settings) == expected


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "x")], "item_id long, text string")
    assert run(no_docs(spark), items) == []
    assert run(odd_docs(spark), items.limit(0)) == []
    assert run(odd_docs(spark).filter("text IS NULL OR trim(text) = ''"), items) == []


def test_other_item_ids(spark):
    items = spark.createDataFrame([("a", "x")], "item_id string, text string")
    assert [r["item_id"] for r in lexical.search(odd_docs(spark), items).collect()] == ["a"]


def test_tiles_stay_exact():
    """Weights beyond what a tile allows are split, and the sum over tiles is exact."""
    import pyarrow as pa

    counts = [{b"a": 5 * lexical.MOST_WEIGHT // 7, b"b": 3, b"c": 10**9}, {b"b": 1}]
    block = lexical._block([1, 2], counts, pa.int64())
    weight = np.array([7 if t != b"b" else 11 for t in block.terms])
    tiles = lexical.tiles(block, weight)
    impact = defaultdict(int, {t: 10**6 - 1 - k for k, t in enumerate(block.terms)})
    total = np.zeros(2, np.int64)
    for tile in tiles:
        dense = tile.dense(2)
        assert (dense.sum(axis=1) * lexical.MOST_IMPACT < 1 << 53).all()
        total += (dense @ np.array([float(impact[block.terms[t]]) for t in tile.terms])).astype(np.int64)
    by_term = dict(zip(block.terms, weight.tolist(), strict=True))
    assert total.tolist() == [sum(n * by_term[t] * impact[t] for t, n in c.items()) for c in counts]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_its_sql(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    assert compare(spark, connect(sf_dir), op11_lexical, OP11_SQL, sf_dir) == ""


def test_long_text(spark):
    long = words(9, 200_000, 3000) + " needle"
    docs = spark.createDataFrame([(1, long), (2, "needle in hay")], "doc_id long, text string").withColumn("rank", F.lit(1))
    items = [(1, "needle hay")]
    assert run(docs, spark.createDataFrame(items, "item_id long, text string")) == plain([(1, long), (2, "needle in hay")], items)
