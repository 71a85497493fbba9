import re
from collections import Counter
from math import log

import pytest

from prefmill.llm import ngramlm
from tests.llm.cases import words


def brute(texts, order, alpha=0.4, unseen=0.5):
    listed = [re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower()) for t in texts]
    grams = lambda ws: Counter(tuple(ws[k : k + n]) for n in range(1, order + 1) for k in range(len(ws) - n + 1))
    every = Counter()
    for ws in listed:
        every.update(grams(ws))
    total = sum(map(len, listed))
    out = []
    for ws in listed:
        own, value, steps = grams(ws), 0.0, 0
        for k in range(len(ws)):
            factor = 1.0
            for n in range(min(order, k + 1), 0, -1):
                gram = tuple(ws[k - n + 1 : k + 1])
                seen = every[gram] - own[gram]
                if n == 1:
                    value += log(factor * max(seen, unseen) / max(1, total - len(ws)))
                elif seen:
                    value += log(factor * seen / (every[gram[:-1]] - own[gram[:-1]]))
                    break
                else:
                    factor, steps = factor * alpha, steps + 1
        out.append((len(ws), steps, value))
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_any_order_equals_plain_counts(spark, order):
    texts = [words(k, 5 + 7 * k % 90, 2) for k in range(50)] + ["", None, "a", "The the THE the", words(3, 26, 2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    settings = ngramlm.Settings(order=order, block_words=300, part_rows=400)
    got = {r["doc_id"]: r for r in ngramlm.score(docs.repartition(3), settings=settings).collect()}
    assert len(got) == len(texts)
    for i, (n, steps, value) in enumerate(brute(texts, order)):
        assert (got[i]["n_words"], got[i]["n_backoff"]) == (n, steps)
        assert got[i]["log_prob"] == pytest.approx(value, abs=1e-9)


def test_counts_over_32_bits_are_whole(spark):
    most = (1 << 32) - 1
    rows = spark.createDataFrame([(5, k, 0, most) for k in range(3)], "gram long, block_id long, place int, n long")
    assert [(r["gram"], r["total"]) for r in ngramlm.totals(rows).collect()] == [(5, 3 * most)]
    assert sorted(tuple(r) for r in ngramlm.asked_for(rows).collect()) == [(k, 0, 3 * most) for k in range(3)]
    assert ngramlm.asked_for(rows.limit(1)).count() == 0


def test_one_exchange_serves_the_counts_and_their_join(spark):
    docs = spark.createDataFrame([(k, words(k, 40, 5)) for k in range(30)], "doc_id long, text string")
    grams = ngramlm.exploded(ngramlm.blocks(docs, "doc_id", "text", ngramlm.Settings(block_words=200)), 3).repartition(4, "gram")
    joined = ngramlm.asked_for(grams)
    joined.collect()
    plan = joined._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.split("Initial Plan")[0].splitlines() if "Exchange" in line]
    assert sorted("ReusedExchange" in line for line in exchanges) == [False, True]
