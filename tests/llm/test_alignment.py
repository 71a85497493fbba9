"""Operator 12 against alignments of whole texts by the tokenizers themselves."""

import hashlib
import random
from collections import Counter, defaultdict
from functools import lru_cache
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from prefmill.llm import alignment as al
from prefmill.llm.queries import op12_alignment
from tests.llm.cases import no_docs, odd_docs, words

pytestmark = pytest.mark.skipif(not Path(al.FOLDER).exists(), reason="tokenizers are not here")

COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


@lru_cache
def plain_tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{al.FOLDER}/{al.A_FILE}")
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=f"{al.FOLDER}/{al.B_FILE}")


def tokens(text):
    """(id, start, end) of both, by the libraries alone; none if the bytes differ."""
    a, b = plain_tokenizers()
    if not text:
        return [], []
    data, out = (" " + text).encode(), []
    letters = al._byte_letters()
    e = a.encode(" " + text, add_special_tokens=False)
    spelled = [bytes(letters[c] for c in t) for t in e.tokens]
    ids = b.encode(text)
    pieces = [b.id_to_piece(i) for i in ids]
    other = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, pieces, strict=True)]
    for known, strings in ((e.ids, spelled), (ids, other)):
        if b"".join(strings) != data:
            return [], []
        ends = np.cumsum([len(s) for s in strings]).tolist()
        out.append(list(zip(known, [0, *ends[:-1]], ends, strict=True)))
    return out


def plain(texts):
    """For each text: groups, links, and the columns that counts give."""
    each = []
    for text in texts:
        a, b = tokens(text)
        common = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, rest = [], [list(reversed(side)) for side in (a, b)]
        for high in common:
            taken = []
            for side in rest:
                own = []
                while side and side[-1][2] <= high:
                    own.append(str(side.pop()[0]))
                taken.append(",".join(own))
            groups.append("|".join(taken))
        links, j = [], 0
        for i, s, e in a:
            while j and b[j - 1][2] > s:
                j -= 1
            while j < len(b) and b[j][1] < e:
                if b[j][2] > s:
                    links.append((i, b[j][0]))
                j += 1
        each.append((len(a), len(b), groups, links))
    held = Counter(p for *_, links in each for p in set(links))
    most = defaultdict(int)
    for (i, _), n in held.items():
        most[i] = max(most[i], n)
    out = []
    for n_a, n_b, groups, links in each:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((n_a, n_b, len(groups), len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), digest))
    return out


def run(docs, at_once=al.PAIRS_AT_ONCE, **options):
    return al.with_counts(al.align(docs, **options), at_once)


def digests(df):
    rows = df.collect()
    return sorted(((r["doc_id"], *(r[c] for c in COLUMNS), hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "") for r in rows), key=str)


ODD = [
    "<|endoftext|> and <s> </s> are text", "a  b", "   ", "\n\n a\t b  \r\n", "▁ under", "жук 中文字符 no space。完", "it's he'll 'S", "x" * 3000, "ab1,c.d" * 300,
    "é   nbsp　wide", "😀👍🏽 emoji", "\x00\x01 control \x7f", "I", "'", " lead", "trail ", "a" + " " * 1500 + "b", " line", "ﬁ ligature ½",
]


@pytest.mark.parametrize("options", [{}, {"chunk": 40, "fan": 2}, {"chunk": 7, "fan": 3}, {"at_once": 0}, {"chunk": 64, "at_once": 0}])
def test_odd_rows_equal_plain_alignment(spark, options):
    docs = odd_docs(spark).unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"), allowMissingColumns=True)
    if options.get("chunk"):
        docs = docs.filter("doc_id IS NULL OR doc_id <> 6")
    rows = docs.collect()
    expected = sorted(((r["doc_id"], *x) for r, x in zip(rows, plain([r["text"] for r in rows]), strict=True)), key=str)
    assert digests(run(docs, **options)) == expected


def test_invalid_bytes_have_no_tokens(spark):
    docs = spark.sql("SELECT 1L AS doc_id, CAST(X'61ff62' AS STRING) AS text UNION ALL SELECT 2L, 'fine'")
    for options in ({}, {"chunk": 2}):
        found = {r["doc_id"]: (r["n_a"], r["groups"]) for r in run(docs, **options).collect()}
        assert found[1] == (0, "") and found[2][0] == 1


def test_empty_table(spark):
    assert run(no_docs(spark)).collect() == []


def test_long_text_by_ranges(spark):
    r = random.Random(3)
    text = " ".join(r.choice(["Word, ", "x.y", "ça", "12,5", "жук"]) + words(r.randrange(99), 9) for _ in range(9000))
    assert len(text) > 4 * al.CHUNK
    docs = spark.createDataFrame([(1, text), (2, text[:500])], "doc_id long, text string")
    assert digests(run(docs)) == sorted(((i + 1, *x) for i, x in enumerate(plain([text, text[:500]]))), key=str)


def whole(text):
    known = al.loaded(al.FOLDER)
    a, b = (np.array(x, np.int64) for x in (known.a(" " + text), known.b([text])[0]))
    return al.Tokens(a, np.cumsum(known.a_sizes[a]), b, np.cumsum(known.b_sizes[b]))


TEXT = st.text(st.sampled_from("ab cdé,.'1\n中ж") | st.characters(codec="utf-8"), min_size=1, max_size=60)


@settings(max_examples=150, deadline=None)
@given(TEXT, st.integers(1, 9))
def test_ranges_give_the_tokens_of_the_whole(text, chunk):
    known, full = al.loaded(al.FOLDER), " " + text
    cuts = al.ranges(text, chunk)
    a = [i for (x, _), (y, _) in zip(cuts, cuts[1:]) for i in known.a(full[x:y])]
    b = [i for (_, x), (_, y) in zip(cuts, cuts[1:]) if x < y for i in known.b([full[x + 1 : y]])[0]]
    assert a == plain_tokenizers()[0].encode(full, add_special_tokens=False).ids
    assert b == plain_tokenizers()[1].encode(text)


def parts(tokens, ends):
    """Fragments of stretches, A cut at each end and B at or after it."""
    out, a, b = [], 0, 0
    for low, high in ends:
        i, j = np.searchsorted(tokens.a_ends, low, "right"), np.searchsorted(tokens.b_ends, high, "right")
        out.append(al.fragment(al.Tokens(tokens.a[a:i], tokens.a_ends[a:i], tokens.b[b:j], tokens.b_ends[b:j])))
        a, b = i, j
    return out


@settings(max_examples=200, deadline=None)
@given(TEXT, st.lists(st.tuples(st.integers(0, 80), st.integers(0, 30)), max_size=6), st.randoms())
def test_fragments_compose_in_any_order(text, marks, chance):
    tokens = whole(text)
    ends, low = [], 0
    for x, y in sorted(marks):
        low = max(low, x + y)
        ends.append((x, low))
    found = parts(tokens, [*ends, (10**9, 10**9)])
    nodes, closed = [f for f, _ in found], [c for _, c in found]
    while len(nodes) > 1:
        k = chance.randrange(len(nodes) - 1)
        joined, more = al.compose(nodes[k], nodes[k + 1])
        nodes[k : k + 2] = [joined]
        closed.append(more)
    expected, middle = al.fragment(tokens)
    assert [x.tolist() for x in nodes[0].prefix.parts()] == [x.tolist() for x in expected.prefix.parts()]
    assert len(nodes[0].suffix.a) == len(nodes[0].suffix.b) == 0
    for k in range(4):
        assert np.sort(np.concatenate([c.parts()[k] for c in closed])).tolist() == np.sort(middle.parts()[k]).tolist()


def test_query_on_given_tables(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    expected = sorted((d["doc_id"], *x) for d, x in zip(docs, plain([d["text"] for d in docs]), strict=True))
    found = op12_alignment(spark, sf_dir)
    assert sorted(tuple(r) for r in found.select("doc_id", *COLUMNS, "groups_sha256").collect()) == expected
