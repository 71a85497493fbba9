import time
from pathlib import Path

import numpy as np
import pytest

from prefmill.llm import ngramlm
from prefmill.llm.tables import narrow_batches
from tests.llm.cases import words
from tests.llm.test_ngramlm_order import brute


def shuffled(spark):
    """Bytes of all shuffle files of the session."""
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return sum(f.stat().st_size for d in folders for f in Path(d.getPath()).rglob("shuffle_*") if f.is_file())


def table(spark, n=60):
    texts = [words(k, 20 + 7 * k % 90, 3) for k in range(n)]
    return texts, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_no_shuffle_file_outlives_its_step(spark):
    texts, docs = table(spark)
    before = shuffled(spark)
    scored = ngramlm.score(docs, settings=ngramlm.Settings(block_words=300, part_rows=500))
    assert scored.count() == len(texts)
    for _ in range(100):  # files are removed beside the next step
        if (left := shuffled(spark) - before) < 1000:
            break
        time.sleep(0.1)
    # What is left is the count above; 60 documents exchange some 200 kB of n-grams.
    assert left < 1000


@pytest.mark.parametrize("rounds", [1, 3, 8])
def test_rounds_hold_every_ngram_once_and_an_equal_share(spark, rounds):
    packed = ngramlm.blocks(table(spark)[1].coalesce(2), "doc_id", "text", ngramlm.Settings(block_words=1500)).cache()
    whole = sorted((r["gram"], r["block_id"], r["n"]) for r in ngramlm.exploded(packed, 3).collect())
    parts = [ngramlm.exploded(packed, 3, k, rounds).collect() for k in range(rounds)]
    assert sorted((r["gram"], r["block_id"], r["n"]) for part in parts for r in part) == whole
    for part in parts:
        assert 0.8 * len(whole) < len(part) * rounds < 1.2 * len(whole)
        for block in {r["block_id"] for r in part}:
            assert sorted(r["place"] for r in part if r["block_id"] == block) == list(range(sum(r["block_id"] == block for r in part)))
    assert len({r["gram"] for part in parts for r in part}) == sum(len({r["gram"] for r in part}) for part in parts)


@pytest.mark.parametrize(("rounds", "shares"), [(1, 1), (3, 2), (5, 9)])
def test_scores_do_not_depend_on_rounds_and_shares(spark, rounds, shares):
    texts, docs = table(spark, 40)
    settings = ngramlm.Settings(block_words=200, part_rows=100, rounds=rounds, shares=shares)
    got = {r["doc_id"]: r for r in ngramlm.score(docs.repartition(2), settings=settings).collect()}
    for i, (n, steps, value) in enumerate(brute(texts, 3)):
        assert (got[i]["n_words"], got[i]["n_backoff"]) == (n, steps)
        assert got[i]["log_prob"] == pytest.approx(value, abs=1e-9)


def test_edges_cut_the_hashes_into_equal_ranges():
    assert ngramlm._edges(1).tolist() == []
    assert ngramlm._edges(4).tolist() == [1 << 62, 1 << 63, 3 << 62]
    assert ngramlm._edges(3).dtype == np.uint64


def test_answers_go_to_their_block_as_lists(spark, monkeypatch):
    texts, docs = table(spark)
    write, rows, asked = ngramlm.cut_and_clear, [], []

    def written(df, name):
        out = write(df, name)
        if name == "totals":
            rows.append(out.count())
        return out

    def counted(grams):
        asked.append(plain(grams).count())
        return plain(grams)

    plain = ngramlm.asked_for
    monkeypatch.setattr(ngramlm, "cut_and_clear", written)
    monkeypatch.setattr(ngramlm, "asked_for", counted)
    settings = ngramlm.Settings(part_rows=2000, rounds=2)
    assert ngramlm.score(docs.repartition(4), settings=settings).count() == len(texts)
    # The words lie in four blocks, their n-grams in three partitions a round.
    assert len(rows) == 2 and min(asked) > 500
    assert max(rows) <= 12


def test_lists_hold_every_answer_once(spark, monkeypatch):
    answers = [(k * 7 % 5, k, (1 << 40) + k) for k in range(1000)]
    frame = spark.createDataFrame(answers, "block_id long, place int, total long").repartition(3)
    for most in (100, 2_000_000):
        monkeypatch.setattr(ngramlm, "_GATHERED", most)
        got = ngramlm.gathered(frame, 4).collect()
        opened = [(r["block_id"], *x) for r in got for x in zip(np.frombuffer(r["places"], np.int32).tolist(), np.frombuffer(r["totals"], np.int64).tolist(), strict=True)]
        assert sorted(opened) == sorted(answers)
        assert {r["turn"] for r in got} == {4}
    assert len(got) <= 15
    assert ngramlm.gathered(frame.limit(0), 0).collect() == []


def test_batches_are_bounded_again_after_narrow_rows(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "5m")
    try:
        with pytest.raises(ZeroDivisionError), narrow_batches(spark):
            assert spark.conf.get(key) == str(2**31 - 1)
            raise ZeroDivisionError
        assert spark.conf.get(key) == "5m"
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
