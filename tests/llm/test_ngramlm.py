import re
from collections import Counter
from math import log

import pytest

from prefmill.llm import ngramlm
from tests.llm.cases import no_docs, odd_docs, odd_rows, words


def brute(texts, alpha=0.4, unseen=0.5):
    listed = [re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower()) for t in texts]
    one, two = Counter(), Counter()
    for ws in listed:
        one.update(ws)
        two.update(zip(ws, ws[1:]))
    total = sum(one.values())
    out = []
    for ws in listed:
        own, pairs = Counter(ws), Counter(zip(ws, ws[1:]))
        value, backoff, others = 0.0, 0, max(1, total - len(ws))
        for k, w in enumerate(ws):
            alone = max(one[w] - own[w], unseen) / others
            if k == 0:
                value += log(alone)
                continue
            v = ws[k - 1]
            seen = two[v, w] - pairs[v, w]
            value += log(seen / (one[v] - own[v])) if seen else log(alpha * alone)
            backoff += not seen
        out.append((len(ws), backoff, value))
    return out


@pytest.mark.parametrize("settings", [ngramlm.Settings(order=2), ngramlm.Settings(order=2, block_words=150, part_rows=300), ngramlm.Settings(order=2, block_words=1)])
def test_scores_equal_plain_counts(spark, settings):
    texts = [words(k, 5 + 7 * k % 90, 6) for k in range(60)] + ["", None, "a", "The the THE the", words(3, 26, 6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in ngramlm.score(docs.repartition(3), settings=settings).collect()}
    assert len(got) == len(texts)
    for i, (n, backoff, value) in enumerate(brute(texts)):
        assert (got[i]["n_words"], got[i]["n_backoff"]) == (n, backoff)
        assert got[i]["log_prob"] == pytest.approx(value, abs=1e-9)


def test_odd_rows_and_empty_tables(spark):
    rows = odd_rows()
    truth = sorted((str(r[0]), n, b, round(v, 6)) for r, (n, b, v) in zip(rows, brute([r[1] for r in rows]), strict=True))
    got = ngramlm.score(odd_docs(spark), settings=ngramlm.Settings(order=2, block_words=1000)).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_backoff"], round(r["log_prob"], 6)) for r in got) == truth
    assert ngramlm.score(no_docs(spark)).count() == 0
    assert [tuple(r) for r in ngramlm.score(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [(1, 0, 0, 0.0)]
