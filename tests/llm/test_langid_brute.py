"""Language identification against plain Python: every n-gram counted one by one, every cosine summed one by one."""

import zlib
from collections import Counter
from math import log, log2, sqrt
from pathlib import Path

import numpy as np
import pytest

from prefmill.llm import langid
from prefmill.llm.queries import op2_language
from tests.llm.cases import no_docs, odd_docs

SF_DIR = "/root/testdata/sf0.001"
S = langid.Settings()


def letter(byte):
    return byte >= 128 or chr(byte).isalpha()


def grams(text):
    """Counts of the hashed n-grams of a text's letters, anything else being a blank."""
    data = bytes(b if letter(b) else 32 for b in (text or "").lower().encode())
    out = Counter()
    for order in S.orders:
        for k in range(len(data) - order + 1):
            gram = data[k : k + order]
            if gram.strip(b" "):
                code = order
                for byte in gram:
                    code = (code * 0x01000193 ^ byte) & 0xFFFFFFFF
                out[(code * 2654435769 & 0xFFFFFFFF) >> 19] += 1
    return out


def unit(weights):
    size = sqrt(sum(w * w for w in weights.values()))
    return {b: w / size for b, w in weights.items()} if size else {}


def cosine(a, b):
    return sum(w * b.get(k, 0.0) for k, w in a.items())


def clusters(points):
    """Up to four centres of the points, from points spread over the order given."""
    count = min(S.centroids, len(points))
    centres = [points[k] for k in sorted({int(k) for k in np.linspace(0, len(points) - 1, count)})]

    def members():
        near = [max(range(len(centres)), key=lambda c, p=p: cosine(p, centres[c])) for p in points]
        return [[p for p, c in zip(points, near, strict=True) if c == at] for at in range(len(centres))]

    for _ in range(S.rounds):
        for at, own in enumerate(members()):
            if own:
                total = Counter()
                for p in own:
                    total.update(p)
                centres[at] = unit(total)
    return [c for c, own in zip(centres, members(), strict=True) if len(own) >= max(1, len(points) // 20)]


def letters(text):
    return sum(letter(c.encode()[0]) for c in (text or "").lower())


def size_class(n):
    return min(langid.LENGTHS - 1, int(2 * log2(max(1, n))))


def low(similar):
    """The quantile of some similarities, with slack; of a few, the least with more slack."""
    if not similar:
        return 0.0
    steps = sorted(min(langid.STEPS - 1, int(max(0.0, s) * langid.STEPS)) for s in similar)
    return steps[int(S.quantile * len(steps))] / langid.STEPS * (S.slack if len(steps) >= 1 / S.quantile else S.slack_few)


def brute(learn, texts):
    """For each text (language, score, margin above the floor; None if the text is too short for one)."""
    learn = [(grams(t), letters(t), lang) for t, lang in learn if t is not None and lang is not None]
    held = Counter(b for g, _, _ in learn for b in g)
    idf = [log((1 + len(learn)) / (1 + held[b])) + 0.1 for b in range(S.dims)]
    weigh = lambda g: unit({b: sqrt(n) * idf[b] for b, n in g.items()})
    # Centres start from texts in the order of their stored vectors, which are half precision.
    stored = lambda g: np.sqrt(np.array([g[b] for b in range(S.dims)], np.float32)).astype(np.float16).tobytes()
    centres = []
    for lang in sorted({lang for *_, lang in learn}):
        own = sorted((g for g, _, code in learn if code == lang), key=stored)
        centres += [(lang, c) for c in clusters([weigh(g) for g in own if g])]
    similar = {}
    for g, n, lang in learn:
        if n >= S.min_letters:
            similar.setdefault(lang, []).append((size_class(n), max(cosine(weigh(g), c) for code, c in centres if code == lang)))
    out = []
    for text in texts:
        if not any(c.isalpha() for c in text or ""):
            out.append(("und", 0.0, None))
            continue
        g, n = weigh(grams(text)), letters(text)
        score, lang = max(((cosine(g, c), code) for code, c in centres), key=lambda x: x[0])
        alike = similar.get(lang, [])
        own = [s for size, s in alike if size == size_class(n)]
        floor = low(own if len(own) >= 1 / S.quantile else [s for _, s in alike])
        out.append((lang, score, score - floor if n >= S.min_letters else None))
    return out


def check(got, expected):
    """Equal languages and scores; equal verdicts but within a step of similarity of the floor."""
    for (lang, score, rejected), (own, near, margin) in zip(got, expected, strict=True):
        assert lang == own and score == pytest.approx(min(1.0, max(0.0, near)), abs=2e-3)
        if own == "und":
            assert rejected
        elif margin is None or abs(margin) > 2 / langid.STEPS:
            assert rejected == (margin is not None and margin < 0)


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not here")
def test_the_query_equals_plain_counting(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text", "lang").collect()
    folds = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 3 for r in rows}
    got = {r["doc_id"]: r for r in op2_language(spark, SF_DIR).collect()}
    assert {i: r["held_out"] for i, r in got.items()} == {i: fold == 1 for i, fold in folds.items()}
    expected = brute([(r["text"], r["lang"]) for r in rows if folds[r["doc_id"]] != 1], [r["text"] for r in rows])
    check([(got[r["doc_id"]]["lang_pred"], got[r["doc_id"]]["score"], got[r["doc_id"]]["rejected"]) for r in rows], expected)


def test_odd_rows_equal_plain_counting(spark):
    docs = odd_docs(spark).filter("length(text) < 5000 OR text IS NULL")
    strangers = spark.createDataFrame([("ωψχφυτσρπο " * 40,), ("zq" * 300,), (None,), ("",), ("12 !!",), ("ab",)], "text string")
    rows = docs.select("doc_id", "text", "lang").collect()
    texts = [r["text"] for r in strangers.collect()]
    model = langid.fit(docs)
    answer = langid.identify(strangers.selectExpr("monotonically_increasing_id() AS doc_id", "text").coalesce(1), model).orderBy("doc_id").collect()
    check([(r["lang_pred"], r["score"], r["rejected"]) for r in answer], brute([(r["text"], r["lang"]) for r in rows], texts))
    assert langid.identify(no_docs(spark), model).count() == 0
