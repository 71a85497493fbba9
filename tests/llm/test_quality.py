import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from prefmill.llm import quality, wordbytes as wb
from tests.llm.cases import SCHEMA, no_docs, odd_docs, odd_rows, words


def counted(text):
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(found[i : i + 8]) for i in range(len(found) - 7))
    covered = {j for i in range(len(found) - 7) if windows[tuple(found[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_counts_equal_plain_ones(spark):
    repeated = "a b c d e f g h i\n" * 3 + "x\n\n \n x\nx"
    rows = odd_rows() + [(20, repeated, "en", "a", None, 0.0, 0, "", True), (21, "# * a|b <é>\n\n" + repeated, "en", "a", None, 0.0, 0, "", True)]
    docs = spark.createDataFrame(rows, SCHEMA)
    report = quality.quality_report(docs, quality.fit_references(docs)).collect()
    assert len(report) == len(rows)
    got = sorted((str(r["doc_id"]), *(r[c] for c in BASE)) for r in report)
    assert got == sorted((str(r[0]), *counted(r[1])) for r in rows)
    for r in report:
        failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def shares(texts, common_share=0.003):
    """References of one language, counted plainly."""
    classes, found = np.zeros(quality.CLASSES), Counter()
    for text in texts:
        for b in text.encode():
            if quality.CLASS_OF[b] < quality.CLASSES:
                classes[quality.CLASS_OF[b]] += 1
        found.update(re.findall(rb"[a-zA-Z\x80-\xff]+", text.encode().lower()))
    total = sum(found.values())
    return classes / classes.sum(), {w: n / total for w, n in found.items() if n >= common_share * total}


def distance(p, q):
    m = (p + q) / 2
    h = lambda x: -sum(v * np.log2(v) for v in x if v > 0)
    return float(np.sqrt(max(0.0, h(m) - (h(p) + h(q)) / 2)))


def test_distances_equal_plain_ones(spark):
    texts = [words(k, 120, 30) for k in range(30)]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    refs = quality.fit_references(docs)
    classes, common = shares(texts)
    assert np.allclose(refs.classes[0], classes)
    order = sorted(common)
    for r in quality.quality_report(docs, refs).collect()[:5]:
        own_classes, _ = shares([texts[r["doc_id"]]])
        own = Counter(re.findall(rb"[a-zA-Z\x80-\xff]+", texts[r["doc_id"]].encode()))
        total = sum(own.values())
        p = np.array([own[w] / total for w in order] + [sum(n for w, n in own.items() if w not in common) / total])
        q = np.array([common[w] for w in order] + [1 - sum(common.values())])
        assert r["word_distance"] == pytest.approx(distance(p, q), abs=1e-9)
        assert r["class_distance"] == pytest.approx(distance(own_classes, classes), abs=1e-9)


def test_symbol_junk_goes_and_prose_stays(spark):
    prose = [(k, " ".join(["the", "of", *words(k, 100).split(), "and"] * 1), "en") for k in range(40)]
    junk = (99, " ".join(w + "###" for w in words(99, 200).split()), "en")
    docs = spark.createDataFrame([*prose, junk], "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in quality.quality_filter(docs, quality.fit_references(docs)).collect()}
    assert kept == set(range(40))


def test_filter_keeps_columns_and_takes_odd_rows(spark):
    docs = odd_docs(spark)
    kept = quality.quality_filter(docs, quality.fit_references(docs))
    assert kept.columns == docs.columns and kept.count() <= docs.count()


def test_empty(spark):
    docs = no_docs(spark)
    refs = quality.fit_references(docs)
    assert refs.langs == () and quality.quality_report(docs, refs).count() == 0
    only = spark.createDataFrame([(1, words(1, 50), None)], "doc_id long, text string, lang string")
    assert quality.quality_report(only, quality.fit_references(only)).first()["kept"]


def test_slices_cover_the_batch():
    import pyarrow as pa

    column = pa.array(["ab", None, "", "c" * 50, "é d"])
    for limit in (1, 10, 1000):
        parts = list(wb.slices(column, limit))
        assert [p.text(i).decode() for p in parts for i in range(len(p))] == ["ab", "", "", "c" * 50, "é d"]


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="test tables are not here")
def test_short_gibberish_goes_and_good_texts_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    refs = quality.fit_references(docs)
    r = random.Random(1)
    for n in (60, 100, 200):
        texts = [" ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randrange(2, 9))) for _ in range(n)) for _ in range(50)]
        kept = quality.quality_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), refs).filter("kept").count()
        assert kept <= (5 if n == 60 else 1), n
    good = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").filter("quality = 1")
    report = quality.quality_report(docs, refs).join(good, "doc_id")
    assert report.filter("NOT base_failed AND NOT kept").count() <= 0.01 * report.count()
