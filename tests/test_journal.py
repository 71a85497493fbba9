"""Requests are asked once, whatever fails in between."""

import json
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from prefmill import schemas
from prefmill.operators import journal
from prefmill.plans import generate
from prefmill.session import scratch_path
from tests.test_jobs import TAXONOMY, model


# The workers cannot import test modules.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def calls_of(folder):
    """How often each prompt was sent, by files that the function leaves."""
    return Counter(t for f in Path(folder).glob("*.json") for t in json.loads(f.read_text()))


def counting(folder, broken=None, answer=str.upper):
    """A function that notes what it has answered, and stops the job at a prompt that ``broken`` names."""

    def load():
        import json
        import uuid
        from pathlib import Path

        def answers(prompts):
            if broken is not None and any(broken(p) for p in prompts):
                raise MemoryError("the machine went away")
            found = [answer(p) for p in prompts]
            (Path(folder) / f"{uuid.uuid4().hex}.json").write_text(json.dumps(prompts))
            return found

        return answers

    return load


def requests(spark, n=40):
    return spark.range(n).selectExpr("id AS k", "'ask ' || id AS p")


def test_a_repeated_run_asks_only_for_what_has_no_answer(spark, tmp_path):
    path, old = scratch_path(spark, "journal"), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        with pytest.raises(Exception, match="went away"):
            journal.ask(requests(spark), "p", counting(tmp_path, lambda p: int(p[4:]) % 10 == 7), path, "k", partitions=4)
        first = calls_of(tmp_path)
        kept = {r["request"] for r in journal.answers(spark, path).collect()}
        assert 0 < len(kept) < 40 and kept == {p[4:] for p in first}
        out = journal.generate_resumable(requests(spark), "p", counting(tmp_path), path, "k", partitions=4)
        assert {(r["k"], r["response"], r["error"]) for r in out.collect()} == {(k, f"ASK {k}", None) for k in range(40)}
        assert calls_of(tmp_path) == Counter({f"ask {k}": 1 for k in range(40)})
        journal.ask(requests(spark), "p", counting(tmp_path), path, "k")
        assert sum(calls_of(tmp_path).values()) == 40
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_changed_prompts_failed_requests_and_repeats(spark, tmp_path):
    path = scratch_path(spark, "journal")

    def refusing(text):
        if "3" in text:
            raise ValueError("refused")
        return text.upper()

    rows = requests(spark, 5).unionByName(requests(spark, 5)).unionByName(spark.sql("SELECT 9L AS k, cast(null AS string) AS p"))
    first = journal.generate_resumable(rows, "p", counting(tmp_path, answer=refusing), path, "k").collect()
    assert sorted(Counter((r["k"], r["response"], r["error"]) for r in first).items(), key=str) == sorted(
        [((k, None if k == 3 else f"ASK {k}", "refused" if k == 3 else None), 2) for k in range(5)] + [((9, None, None), 1)], key=str
    )
    changed = requests(spark, 5).withColumn("p", F.when(F.col("k") == 1, "other").otherwise(F.col("p")))
    again = {r["k"]: r["response"] for r in journal.generate_resumable(changed, "p", counting(tmp_path), path, "k").collect()}
    assert again == {0: "ASK 0", 1: "OTHER", 2: "ASK 2", 3: "ASK 3", 4: "ASK 4"}
    assert {k: n for k, n in calls_of(tmp_path).items() if "3" not in k} == {"ask 0": 1, "ask 1": 1, "ask 2": 1, "ask 4": 1, "other": 1}
    with pytest.raises(Exception, match="no key"):
        journal.ask(spark.sql("SELECT null AS k, 'x' AS p"), "p", counting(tmp_path), path, "k")


def test_a_broken_generation_goes_on(spark):
    taxonomy, out = spark.createDataFrame(TAXONOMY, schemas.TAXONOMY), scratch_path(spark, "generated")
    with pytest.raises(Exception):
        generate.generate(spark, taxonomy, lambda: lambda prompts: (_ for _ in ()).throw(MemoryError("gone")), out, resume=True)
    pairs = generate.generate(spark, taxonomy, lambda: model(), out, resume=True)
    plain = generate.generate(spark, taxonomy, lambda: model(), scratch_path(spark, "generated"))
    assert sorted(map(str, pairs.collect())) == sorted(map(str, plain.collect()))
    again = generate.generate(spark, taxonomy, lambda: lambda prompts: 1 / 0, out, resume=True)
    assert again.count() == plain.count()
