import dataclasses
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from prefmill.llm import langid
from prefmill.llm.queries import op2_language
from tests.llm.cases import no_docs, odd_docs, words

LETTERS = {"aa": "abcdefg hij", "bb": "klmnop qrs", "cc": "жзийклм ноп"}


def sample(spark, n=60):
    r = random.Random(3)
    rows = [(k, "".join(r.choice(LETTERS[lang]) for _ in range(400)), lang) for k, lang in enumerate(list(LETTERS) * n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_languages_are_told_apart_and_strangers_rejected(spark):
    docs = sample(spark)
    model = langid.fit(docs)
    assert set(model.langs) == set(LETTERS) and len(model.langs) > 3
    r = random.Random(9)
    made = lambda letters: "".join(r.choice(letters) for _ in range(400))
    new = spark.createDataFrame(
        [(1, made(LETTERS["bb"])), (2, made(LETTERS["aa"])), (3, made(LETTERS["cc"])), (4, made("ωψχφυτσ ρπο")), (5, "12 !!"), (6, None), (7, ""), (8, "ab")],
        "doc_id long, text string",
    )
    got = {r["doc_id"]: r for r in langid.identify(new, model).collect()}
    assert [got[k]["lang_pred"] for k in (1, 2, 3, 8)] == ["bb", "aa", "cc", "aa"]
    assert [got[k]["rejected"] for k in (1, 2, 3, 4, 8)] == [False, False, False, True, False]
    assert all((got[k]["lang_pred"], got[k]["score"], got[k]["rejected"]) == ("und", 0.0, True) for k in (5, 6, 7))
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_prediction_uses_the_text_alone(spark):
    docs = sample(spark, 30)
    model = langid.fit(docs)
    changed = docs.withColumn("lang", F.lit("zz")).withColumn("doc_id", -F.col("doc_id"))
    first = sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(docs, model).collect())
    second = sorted((-r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(changed, model).collect())
    assert first == second


def test_odd_rows_and_empty_tables(spark):
    docs = odd_docs(spark)
    model = langid.fit(docs)
    assert langid.identify(docs, model).count() == docs.count()
    kept = langid.language_filter(docs, model)
    assert kept.columns == docs.columns
    assert not {2, 3, 4, 9} & {r["doc_id"] for r in kept.collect()}
    nothing = langid.fit(no_docs(spark))
    assert nothing.langs == ()
    assert {r["lang_pred"] for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.identify(no_docs(spark), model).count() == 0


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="test tables are not here")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = op2_language(spark, "/root/testdata/sf0.01").join(docs, "doc_id").filter("held_out").collect()
    assert len(rows) > 250 and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97


def test_more_languages_than_are_learned(spark):
    """The languages with most documents are learned; a column full of odd codes does not empty the model."""
    rows = [(k, words(k % 7, 40), "en") for k in range(60)] + [(100 + k, "слово дело жизнь " * 10, "ru") for k in range(60)]
    rows += [(1000 + k, words(k, 5), f"x{k}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    settings = dataclasses.replace(langid.Settings(), most=80)
    model = langid.fit(docs, settings=settings)
    assert {"en", "ru"} <= set(model.langs) and len(set(model.langs)) <= 10
    found = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs.filter("doc_id >= 100 AND doc_id < 160"), model).collect()}
    assert set(found.values()) == {"ru"}
