import random
import re

import xxhash
from pyspark.sql import functions as F

from prefmill.llm import simhash
from prefmill.llm.components import components
from tests.llm.cases import no_docs, odd_docs, odd_rows, words


def plain(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not found:
        return 0
    shingles = [" ".join(found[i : i + 3]) for i in range(len(found) - 2)] or [" ".join(found)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reached(prints):
    """Smallest id reachable from each id over fingerprints at most two bits apart."""
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if b < a and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_fingerprints_and_components_equal_brute_force(spark):
    base = [words(k, 120) for k in range(25)]
    texts = base + [t.replace(" ", "\n", 3).upper() for t in base[:8]] + [t + " extra" for t in base[5:20]] + ["", "  ", "one", "one two", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    prints = {i: plain(t) for i, t in enumerate(texts)}
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == prints
    assert all(re.fullmatch("[0-9a-f]{16}", r["fingerprint"]) for r in got.values())
    assert {i: r["component_id"] for i, r in got.items()} == reached(prints)


def near(seed, n):
    """Fingerprints in clusters and chains, so that cells of every size arise."""
    r = random.Random(seed)
    out = set()
    while len(out) < n:
        x = r.getrandbits(64)
        for _ in range(r.choice((1, 2, 30))):
            out.add(x)
            x ^= (1 << r.randrange(64)) | (1 << r.randrange(64)) if r.random() < 0.7 else 1 << r.randrange(64)
    centre = r.getrandbits(64)
    out |= {centre ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(0, 64, 9)}
    return sorted(out)


def test_links_lose_no_connection_at_any_cell_size(spark):
    prints = near(7, 300)
    truth = reached(dict(zip(prints, prints, strict=True)))
    rows = spark.createDataFrame([(simhash._signed(x),) for x in prints], "fp long")
    for cell in (1, 3, 32, 10_000):
        found = simhash.links(rows, cell=cell).distinct().collect()
        assert all(0 < ((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= 2 for r in found)
        parent = {simhash._signed(x): simhash._signed(x) for x in prints}

        def root(i, parent=parent):
            while parent[i] != i:
                i = parent[i]
            return i

        for r in found:
            parent[root(r["a"])] = root(r["b"])
        groups = {}
        for x in prints:
            groups.setdefault(root(simhash._signed(x)), set()).add(truth[x])
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(truth.values()))
    pairs = {frozenset((r["a"], r["b"])) for r in simhash.links(rows, cell=10_000).collect()}
    brute = {frozenset((simhash._signed(a), simhash._signed(b))) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 2}
    assert pairs == brute


def test_components_of_chains_stars_and_rings(spark):
    chain = [(k, k + 1) for k in range(100, 160)]
    star = [(7, k) for k in range(200, 260)]
    ring = [(300, 301), (301, 302), (302, 300), (302, 302)]
    edges = spark.createDataFrame([*chain, *star, *ring], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {**{k: 100 for k in range(100, 161)}, **{k: 7 for k in (7, *range(200, 260))}, **{k: 300 for k in (300, 301, 302)}}
    assert components(edges.limit(0)).count() == 0


def test_odd_rows_and_empty_tables(spark):
    docs = odd_docs(spark)
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(odd_rows())
    found = {r["doc_id"]: r["component_id"] for r in rows}
    assert found[5] == 1 and found[2] == found[3] == found[4] == 2 and found[6] == 6
    one = simhash.one_of_each(docs)
    assert one.columns == docs.columns
    assert sorted(r["doc_id"] for r in one.filter(F.col("doc_id").isNotNull()).collect()) == [1, 2, 6, 7, 8, 9]
    assert simhash.near_duplicates(no_docs(spark)).count() == 0 and simhash.one_of_each(no_docs(spark)).count() == 0
