import base64
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefmill.llm import langid
from tests.llm.test_langid import LETTERS

SF_DIR = "/root/testdata/sf0.01"


def rejected(spark, texts, model):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return langid.identify(docs, model).filter("rejected").count()


def junk(n=600, most=50):
    r = random.Random(4)
    return {
        "letters": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(n)) for _ in range(most)],
        "base64": [base64.b64encode(r.randbytes(n)).decode() for _ in range(most)],
        "greek": ["".join(r.choice("αβγδεζηθικλμνξοπρστυφχψω    ") for _ in range(n)) for _ in range(most)],
    }


def test_odd_learned_documents_do_not_set_the_floor(spark):
    r = random.Random(3)
    made = lambda letters: "".join(r.choice(letters) for _ in range(400))
    rows = [(k, made(LETTERS[lang]), lang) for k, lang in enumerate(["aa", "bb"] * 300)]
    rows += [(1000, "0 " + "zu" * 300, "aa"), (1001, "yw" * 300, "bb")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert rejected(spark, [made("tuvwxyz nop") for _ in range(50)], model) == 50
    assert rejected(spark, [made(LETTERS["aa"]) for _ in range(50)] + [made(LETTERS["bb"]) for _ in range(50)], model) <= 3


def test_floors_are_quantiles_by_length():
    counted = np.zeros((langid.LENGTHS, langid.STEPS), np.int64)
    counted[20, [10, 100, 200]] = 1, 5, 994
    counted[21, 50] = 3
    settings = langid.Settings(quantile=0.005)
    found = langid.floors(counted, settings)
    assert found[20] == pytest.approx(settings.slack * 100 / langid.STEPS) and found[21] == found[0]
    assert langid.floors(counted * 0, settings).max() == 0
    assert langid.floors(np.eye(langid.LENGTHS, langid.STEPS, 128, dtype=np.int64)[:1], settings)[0] == pytest.approx(settings.slack_few / 2)


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not here")
def test_junk_and_unlearned_languages_are_rejected_and_clean_documents_kept(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    part = F.crc32(F.col("doc_id").cast("string")) % 4
    for left_out in (None, "de"):
        known = docs.filter(F.col("lang") != F.lit(left_out or ""))
        model = langid.fit(known.filter(part != 0))
        for name, texts in junk().items():
            assert rejected(spark, texts, model) >= 0.95 * len(texts), (left_out, name)
        clean = langid.identify(known.filter(part == 0), model)
        assert clean.filter("rejected AND lang_pred <> 'und'").count() <= 0.02 * clean.count(), left_out
        if left_out:
            long = docs.filter((F.col("lang") == left_out) & (F.length("text") > 400))
            assert langid.identify(long, model).filter("rejected").count() >= 0.8 * long.count()
