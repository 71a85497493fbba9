import random
from itertools import product
from math import exp
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from prefmill.llm import toxicity, wordbytes as wb
from prefmill.llm.queries import op8_toxicity
from tests.llm.cases import no_docs, odd_docs, odd_rows, words


def made(spark, n=300):
    r = random.Random(1)
    docs, labels = [], []
    for i in range(n):
        text = words(1000 + i, r.randrange(5, 120)).split()
        bad = i % 4 == 0
        if bad:
            for _ in range(r.randrange(2, 6)):
                text.insert(r.randrange(len(text) + 1), r.choice(["Grumble", "grumblé", "snarlix", "SNARLIX"]) + r.choice(["", "", "ous", "ing"]))
        docs.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_documents_and_offsets(spark):
    docs, labels = made(spark)
    field = toxicity.fit(docs, labels.filter("doc_id % 3 > 0"))
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, field).collect()}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [i for i in truth if i % 3 == 0]
    assert sum(got[i]["predicted"] == truth[i] for i in held) >= 0.95 * len(held)
    for i, r in got.items():
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        for s in r["spans"]:
            assert text[i][s["start"] : s["end"]].lower().startswith(("grumbl", "snarl"))


def brute(n_words, known, field):
    """Marginals of toxic by adding up all label sequences; known: emissions of some words, the others have the bias."""
    emission = [known.get(k, field.bias) for k in range(n_words)]
    total, share = 0.0, np.zeros(n_words)
    for labels in product((0, 1), repeat=n_words):
        weight, before = 0.0, 0
        for k, y in enumerate(labels):
            weight += field.transitions[before, y] + y * emission[k]
            before = y
        total += exp(weight)
        share += exp(weight) * np.array(labels)
    return share / total


@pytest.mark.parametrize("seed", range(6))
def test_marginals_equal_sums_over_all_sequences(seed):
    r = np.random.default_rng(seed)
    vocabulary = [f"word{k}" for k in range(12)]
    part = next(wb.slices(pa.array([" ".join(vocabulary)])))
    found, *_ = toxicity._features(part)
    features = np.sort(found[[1, 4, 5, 10], 0])
    field = toxicity.Field(features, r.normal(size=4) * 2, float(r.normal()), r.normal(size=(2, 2)), (0.0, 1.0, 1.0))
    texts = [" ".join(r.choice(vocabulary, n)) for n in (1, 2, 7, 10)] + ["", "word4", "word2"]
    for part in wb.slices(pa.array(texts)):
        owner, place, _, _, p, n_words = toxicity.marginals(part, field)
        found, _, _, bounds = toxicity._features(part)
        ids = toxicity._known(features, found)
        emission = np.append(0.0, field.weights)[ids].sum(1) + field.bias
        for i in range(len(part)):
            own = emission[bounds[i] : bounds[i + 1]]
            truth = brute(n_words[i], dict(enumerate(own)), field)
            assert np.allclose(p[owner == i], truth[place[owner == i]])


def test_training_gradient_reaches_the_labels():
    ids = np.zeros((2, 3, 1), int)
    ids[0, 1, 0], ids[1, 0, 0] = 1, 2
    valid = np.array([[True, True, True], [True, True, False]])
    toxic = np.array([[0, 1, 0], [0, 0, 0]])
    settings = toxicity.Settings(rounds=300)
    weights, bias, transitions = toxicity._train(ids, valid, toxic, np.array([5.0, 5.0]), 2, settings)
    emission = np.append(0, weights)[ids].sum(2) + bias
    p, _ = toxicity._forward_backward(emission, valid, np.ones(2), transitions)
    assert p[0, 1] > 0.7 and p[0, 0] < 0.3 and p[1, 0] < 0.3


def test_tests_of_features():
    assert toxicity._upper_tail(3, 3, 0.1) == pytest.approx(0.001)
    assert toxicity._upper_tail(300, 1000, 0.1) < 1e-30
    assert toxicity._accepted([(8, 0, 3), (1, 9, 500), (2, 1, 100)], 0.1, 0.05) == [(8, 0)]


def test_odd_rows_and_empty_tables(spark):
    docs, labels = made(spark, 80)
    field = toxicity.fit(docs, labels)
    rows = toxicity.toxicity(odd_docs(spark), field).collect()
    assert len(rows) == len(odd_rows())
    quiet = {r["score"] for r in rows if r["doc_id"] in (2, 3, 4, 9)}
    assert len(quiet) == 1 and quiet.pop() < 0.5
    assert toxicity.toxicity(no_docs(spark), field).count() == 0
    nulls = spark.createDataFrame([(None, 1), (1, None), (2, 1), (2, 0)], "doc_id long, toxic int")
    for known in (labels.limit(0), nulls, labels.filter("toxic = 0")):
        constant = toxicity.fit(docs, known)
        assert len({r["score"] for r in toxicity.toxicity(docs, constant).collect()}) == 1


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="test tables are not here")
def test_held_out_accuracy(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = op8_toxicity(spark, "/root/testdata/sf0.1").filter("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 500 and sum(r["predicted"] == r["toxic"] for r in rows) / len(rows) > 0.97
    assert any(r["toxic"] for r in rows)
