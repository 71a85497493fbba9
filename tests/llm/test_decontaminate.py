import random
import re
from itertools import combinations

import numpy as np
import pytest

from prefmill.llm import decontaminate
from tests.llm.cases import no_docs, odd_docs, odd_rows, words


def tokens(text):
    """Thai, Lao, kana and Han characters are words of their own; common punctuation beyond ASCII is none."""
    alone, mark = "\u0e00-\u0eff\u3040-\u9fff", "\u2000-\u206f\u3000-\u303f\uff00-\uff0f\uff1a-\uff20"
    return re.findall(f"[{alone}]|(?:(?![{alone}{mark}])[0-9a-z\x80-\U0010ffff])+", (text or "").lower())


def best(equal):
    """Start, length and equal places of the stretch with most equal ones of which four of five are equal; the longest search."""
    found = (0, 0, 0)
    for end in range(len(equal), 0, -1):
        for start in range(end):
            same = sum(equal[start:end])
            if 5 * same >= 4 * (end - start) and same > found[2]:
                found = (start, end - start, same)
    return found


def brute(docs, items, least=decontaminate.MIN_WORDS):
    """Every alignment of every document and item that holds an overlap that counts."""
    out = {}
    for i, text in docs:
        doc = tokens(text)
        for k, item_text in items:
            item = tokens(item_text)
            if len(item) < decontaminate.LEAST_ITEM:
                continue
            top = 0
            for start in range(-len(item) + 1, len(doc)):
                low, high = max(start, 0), min(start + len(item), len(doc))
                _, n, same = best([doc[j] == item[j - start] for j in range(low, high)])
                if n >= min(least, len(item)) and (len(item) >= 8 or same == len(item)):
                    top = max(top, same)
            if top:
                out[i, k] = top
    return out


def cases():
    r = random.Random(5)
    items = [(k, words(100 + k, r.choice((14, 20, 30)))) for k in range(6)] + [(6, words(106, 6)), (7, words(107, 3)), (8, None), (9, ""), (10, words(100, 14))]
    docs = []
    for i in range(40):
        own = words(i, 30).split()
        k = r.randrange(7)
        passage = (items[k][1] or "").split()
        if i % 2:
            for at in r.sample(range(len(passage)), len(passage) // 5 if i % 4 == 1 else len(passage) // 3):
                passage[at] = f"other{at}"
        if i % 5 == 0:
            passage = passage[: len(passage) // 2]
        at = r.choice((0, 10, 30))
        text = " ".join(own[:at] + passage + own[at:])
        docs.append((i, text.upper().replace(" ", ", ", 5) if i % 3 == 0 else text))
    return docs, items


def test_overlaps_equal_brute_force(spark):
    docs, items = cases()
    truth = brute(docs, items)
    assert 10 < len(truth) < 60
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (decontaminate.BLOCK, 60):
        got = {(r["doc_id"], r["item_id"]): r["n_equal"] for r in decontaminate.contaminated(rows, bench, block=block).collect()}
        assert got == truth
        clean = {r["doc_id"] for r in decontaminate.decontaminated(rows, bench, block=block).collect()}
        assert clean == {i for i, _ in docs} - {i for i, _ in truth}


def test_masks_hit_every_ten_words_with_two_substitutions():
    for wrong in combinations(range(10), 2):
        assert any(all(at + p not in wrong for p in mask) for mask in decontaminate.MASKS for at in range(10 - mask[-1]))


@pytest.mark.parametrize("seed", range(20))
def test_longest_overlap(seed):
    equal = np.random.default_rng(seed).random(40) < 0.75
    start, n, same = decontaminate.longest_overlap(equal)
    assert same == best(equal.tolist())[2] == equal[start : start + n].sum() and 5 * same >= 4 * n


def test_odd_rows_and_empty_tables(spark):
    docs = odd_docs(spark)
    bench = spark.createDataFrame([(1, words(2, 20), "x"), (None, words(3, 20), "y")], "item_id long, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(1, 1), (5, 1), (None, 1), (7, None)}
    clean = decontaminate.decontaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == len(odd_rows()) - 5
    assert decontaminate.contaminated(no_docs(spark), bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.decontaminated(docs, bench.limit(0)).count() == len(odd_rows())


@pytest.mark.parametrize("text", ["中文字a b文。末 x", "ไทย ภาษา", "“quoted” words—dash", "a　b，c１２", "жук müß", "中", "", "…", "a中", "中a", "あいう カナ、한국어", "ﬁ⁰ ʰ"])
def test_words_of_scripts_without_spaces(text):
    parts = list(decontaminate.wb.slices(decontaminate._lowered(decontaminate.pa.array([text, "x", text]))))
    counts = [np.diff(decontaminate._words(p)[1]).tolist() for p in parts]
    assert sum(counts, []) == [len(tokens(text)), 1, len(tokens(text))]


def test_items_without_spaces_are_found(spark):
    item = "敏捷的棕色狐狸跳过了懒惰的狗然后回家"
    docs = spark.createDataFrame([(1, f"前言。{item}，后记"), (2, "敏捷的狗"), (3, f"x {item[:14]} y")], "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    found = {(r["doc_id"], r["n_equal"]) for r in decontaminate.contaminated(docs, items).collect()}
    assert found == {(1, len(item)), (3, 14)}


def test_a_repeated_word_costs_no_more_than_the_text(spark):
    items = spark.createDataFrame([(1, "x " * 200)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " * 20_000), (2, "y " * 20_000)], "doc_id long, text string")
    assert [(r["doc_id"], r["n_equal"]) for r in decontaminate.contaminated(docs, items).collect()] == [(1, 200)]
    seeds = decontaminate._table([np.zeros(200, np.uint64)])
    part = decontaminate.wb.Texts(0, np.frombuffer(b"x " * 3000, np.uint8), np.array([0, 6000]))
    assert len(decontaminate._different(*np.zeros((3, 10**6), np.int64))) == 1 and decontaminate.overlaps(part, seeds) == []


def test_the_filter_follows_the_seeds():
    """Every task holds a copy: 64 MB for any benchmark of some items took most of a worker's memory."""
    r = np.random.default_rng(1)
    items = [r.integers(0, 1 << 63, 40).astype(np.uint64) for _ in range(200)]
    seeds = decontaminate._table(items)
    assert len(seeds.hashes) < len(seeds.filter) <= 1 << 24
    shift = np.uint64(64 - (len(seeds.filter).bit_length() - 1))
    assert seeds.filter[(seeds.hashes >> shift).astype(np.int64)].all()
