"""The pipeline against each stage's plain version, and the registered queries against their SQL."""

import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from prefmill.llm import langid, mixing, quality
from prefmill.llm.queries import ORACLES, QUERIES
from tests.llm.cases import SCHEMA, no_docs, odd_docs
from tests.llm.test_decontaminate import brute as overlapping
from tests.llm.test_langid_brute import brute as plain_languages
from tests.llm.test_mixing import drawn, shared
from tests.llm.test_nearcopies import kept
from tests.llm.test_quality import counted, distance, shares
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not here")


#: More words than any item has.
LONGEST = 80


def words_of(text):
    return re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text.lower())


def good_ones(rows):
    """Documents that pass the quality rules, by plain counting."""
    rules, by_lang = quality.Rules(), {}
    for r in rows.values():
        if r["lang"] is not None:
            by_lang.setdefault(r["lang"], []).append(r["text"])
    refs = [shares(texts) for texts in by_lang.values()]
    out = set()
    for i, r in rows.items():
        n_words, _, _, _, repeated = counted(r["text"])
        if n_words < 20 or 100 * repeated > 30 * n_words:
            continue
        own = Counter(re.findall(rb"[a-z\x80-\xff]+", r["text"].encode().lower()))
        n_bare, chars = sum(own.values()), sum(quality.CLASS_OF[b] < quality.CLASSES for b in r["text"].encode())
        classes, _ = shares([r["text"]])
        over = []
        for ref_classes, common in refs:
            order = sorted(common)
            p = np.array([own[w] for w in order] + [sum(n for w, n in own.items() if w not in common)]) / max(1, n_bare)
            q = np.array([common[w] for w in order] + [1 - sum(common.values())])
            chance = [(bins - 1) / (8 * np.log(2) * max(1, n)) for bins, n in ((quality.CLASSES, chars), (len(q), n_bare))]
            far_class = distance(classes, ref_classes) ** 2 / (rules.class_distance**2 + 3 * chance[0]) if chars >= 200 else 0
            allowed = max(rules.word_distance**2, chance[1]) + 3 * chance[1] * np.sqrt(2 / (len(q) - 1))
            over.append(max(far_class, distance(p, q) ** 2 / allowed if n_bare >= 60 else 0))
        if min(over) <= 1:
            out.add(i)
    return out


def test_registration():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 14)] + ["pipeline"]
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "language", "near_duplicates", "decontamination", "mixing"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    assert compare(spark, connect(SF_DIR), QUERIES[name], ORACLES[name], SF_DIR) == ""


def test_stages_equal_plain_versions(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    bench = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        out = corpus_pipeline.cut(stage(spark, docs, SF_DIR), "test")
        rows = out.collect()
        if name == "quality_rules":
            expected = good_ones(before)
        elif name == "language":
            answers = plain_languages([(r["text"], r["lang"]) for r in before.values()], [r["text"] for r in before.values()])
            answers = dict(zip(before, answers, strict=True))
            # Within two steps of the floor either verdict is right: similarities are counted in steps, in single precision.
            close = {i for i, (*_, margin) in answers.items() if margin is not None and abs(margin) <= 2 / langid.STEPS}
            expected = {i for i, (lang, _, margin) in answers.items() if lang != "und" and (margin is None or margin >= 0)}
            expected = (expected - close) | (close & {r["doc_id"] for r in rows})
            assert len(close) < len(before) / 20
        elif name == "near_duplicates":
            expected = kept({i: r["text"] for i, r in before.items()})
        elif name == "decontamination":
            # An overlap of four in five words holds five in a row here; around those places the text is held against every item.
            shingles = {tuple(ws[k : k + 5]) for _, t in bench for ws in [words_of(t)] for k in range(len(ws) - 4)}
            around = []
            for i, r in before.items():
                ws = words_of(r["text"])
                places = [k for k in range(len(ws) - 4) if tuple(ws[k : k + 5]) in shingles]
                around += [(i, " ".join(ws[max(0, k - LONGEST) : k + LONGEST])) for n, k in enumerate(places) if not n or k - places[n - 1] > 1]
            assert max(len(words_of(t)) for _, t in bench) < LONGEST
            expected = set(before) - {around[k][0] for k, _ in overlapping([(k, t) for k, (_, t) in enumerate(around)], bench)}
        else:
            sizes: dict = {}
            count = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for i, r in before.items()}
            for i, r in before.items():
                sizes[r["source"]] = sizes.get(r["source"], 0) + count[i]
            target = shared(sizes)
            expected_copies = {}
            for i, r in before.items():
                rate = target[r["source"]] / sizes[r["source"]]
                expected_copies[i] = int(rate + 1e-9) + (drawn(i) < rate - int(rate + 1e-9) - 1e-12)
            got: dict = {i: 0 for i in before}
            for r in rows:
                got[r["doc_id"]] += 1
            assert got == expected_copies and out.columns == [*columns, "copy"]
            break
        assert out.columns == columns and {r["doc_id"] for r in rows} == expected and len(rows) == len(expected), name
        assert all(tuple(r) == tuple(before[r["doc_id"]]) for r in rows)
        docs = out


def test_odd_rows_and_empty_tables(spark, tmp_path):
    for k, docs in enumerate((odd_docs(spark), no_docs(spark))):
        at = str(tmp_path / str(k))
        docs.write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([(1, "a b c d e f g h i j k l m n")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        assert corpus_pipeline.run(spark, at).count() == 0 or k == 0
    assert SCHEMA and mixing.word_count(F.lit(None)) is not None
