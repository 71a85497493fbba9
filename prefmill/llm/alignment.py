"""Operator 12, cross-tokenizer alignment: an associative fragment monoid.

A text is cut into tokens twice, by a byte-level BPE (A) and by a piece BPE (B). Byte offsets where tokens of both end
cut it into groups; A and B tokens whose byte ranges overlap are linked. Each link's id pair is then looked up in how many
documents of the corpus hold it.

Long texts. A text of more than ``CHUNK`` bytes is cut into byte ranges that are tokenised in tasks of their own. A range
begins, for each tokenizer, at the next place that none of its tokens can cross; these places differ, so a range's A and
B tokens need not begin and end together. A range becomes a fragment: an open prefix (tokens up to the first offset where
both end), closed groups, and an open suffix (tokens after the last such offset). Two neighbours compose: the left one's
suffix and the right one's prefix are joined, and what closes between them leaves as closed groups. Composition is
associative, so a text's fragments are reduced as a tree, sixteen to one a round; only open ends travel, and every round
is written. Other texts are one range, aligned where they lie.

Size. Nothing is broadcast but the table of id pairs, and that only up to ``PAIRS_AT_ONCE`` rows (about 34 MB); beyond it
the pairs are joined, salted. A text without a place to cut is one range, as the tokenizers need it whole.

Defined results: null and empty texts, texts that are not valid UTF-8, and those whose joined token bytes differ from space +
text have no tokens: zeros and an empty ``groups``. Special tokens' strings are plain text. Every row is a document of
its own, null and repeated ids included. The tokenizers' files are read by the workers from ``folder``.
"""

from __future__ import annotations

import json
import re
import sys
import types
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefmill.llm import wordbytes as wb
from prefmill.llm.tables import bounded_batches, cut, map_batches

FOLDER = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
CHUNK = 1 << 16
FAN = 16
PAIRS_AT_ONCE = 2_000_000
_SALTS = 8
#: The fast encoder's pattern engine fails on much longer runs of white space; such texts go to the plain one.
_LONG_RUN = re.compile(r"\s{1000}")
#: Fixed value: how tokenizer A cuts a text before merging.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Places no token crosses: a lone space between visible characters; for A also from a letter or digit to punctuation.
_SAFE_B = re.compile(r"(?<=\S) (?=\S)")
_SAFE_A = re.compile(r"(?<=\S) (?=\S)|(?<=[A-Za-z0-9])(?=[!-&(-/:-@\[-`{-~])")

ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>"
_EMPTY = np.zeros(0, np.int64)


def _byte_letters() -> dict[str, int]:
    """How a byte-level vocabulary spells bytes: visible Latin-1 characters as they are, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers, the bytes of their tokens, and the decimal spelling of ids with what follows them."""

    def __init__(self, folder: str = FOLDER):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        path = f"{folder}/{A_FILE}"
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = _byte_letters()
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self._plain = Tokenizer.from_file(path)
        self._plain.encode_special_tokens = True
        self._a = tiktoken.Encoding("a", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{B_FILE}")
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        n = self._b.get_piece_size()
        pieces = [self._b.id_to_piece(i) for i in range(n)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self._b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        self.n_a, self.n_b = len(self.a_bytes), len(self.b_bytes)
        ends = ((self.n_a, (",", "|")), (self.n_b, (",", ";")))
        self.spelled = [f"{i}{mark}".encode() for size, marks in ends for i in range(size) for mark in marks]

    def a(self, text: str) -> list[int]:
        if _LONG_RUN.search(text):
            return self._plain.encode(text, add_special_tokens=False).ids
        return self._a.encode_ordinary(text)

    def b(self, texts: list[str]) -> list[list[int]]:
        """Ids of space + text, for each."""
        return self._b.encode(texts, num_threads=1) if texts else []

    def spells(self, ids: list[int], table: list[bytes], data: bytes) -> bool:
        return b"".join(map(table.__getitem__, ids)) == data


def loaded(folder: str) -> Tokenizers:
    """Loaded once in a worker process, whatever number of tasks it runs."""
    kept = sys.modules.setdefault("_prefmill_tokenizers", types.ModuleType("_prefmill_tokenizers"))
    if not hasattr(kept, "by_folder"):
        kept.by_folder = {}
    if folder not in kept.by_folder:
        kept.by_folder[folder] = Tokenizers(folder)
    return kept.by_folder[folder]


@dataclass
class Tokens:
    """A and B tokens of one stretch, with the byte offsets at which they end."""

    a: np.ndarray
    a_ends: np.ndarray
    b: np.ndarray
    b_ends: np.ndarray

    def common(self) -> np.ndarray:
        return np.intersect1d(self.a_ends, self.b_ends, assume_unique=True)

    def until(self, low: int, high: int) -> Tokens:
        """The tokens that end after ``low`` and not after ``high``."""
        i, j = np.searchsorted(self.a_ends, (low, high), "right")
        k, m = np.searchsorted(self.b_ends, (low, high), "right")
        return Tokens(self.a[i:j], self.a_ends[i:j], self.b[k:m], self.b_ends[k:m])

    def __add__(self, other: Tokens) -> Tokens:
        return Tokens(*(np.concatenate([x, y]) for x, y in zip(self.parts(), other.parts(), strict=True)))

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.a, self.a_ends, self.b, self.b_ends


NOTHING = Tokens(_EMPTY, _EMPTY, _EMPTY, _EMPTY)


@dataclass
class Fragment:
    """Open ends of a stretch of tokens. Without a cut the prefix holds all of it."""

    prefix: Tokens
    cut: bool = False
    suffix: Tokens = None

    def __post_init__(self):
        self.suffix = self.suffix or NOTHING


def fragment(tokens: Tokens) -> tuple[Fragment, Tokens]:
    """Open ends, and the tokens of the closed groups between them."""
    ends = tokens.common()
    if not len(ends):
        return Fragment(tokens), NOTHING
    top = np.iinfo(np.int64).max
    return Fragment(tokens.until(-1, ends[0]), True, tokens.until(ends[-1], top)), tokens.until(ends[0], ends[-1])


def compose(left: Fragment, right: Fragment) -> tuple[Fragment, Tokens]:
    """The fragment of both stretches, and the tokens of the groups that close between them."""
    middle, closed = fragment((left.suffix if left.cut else left.prefix) + right.prefix)
    tail = right.suffix if right.cut else middle.suffix
    if not left.cut:
        return (Fragment(middle.prefix, True, tail) if middle.cut else middle), closed
    if not middle.cut:
        return Fragment(left.prefix, True, middle.prefix), NOTHING
    return Fragment(left.prefix, True, tail), middle.prefix + closed


def _aligned(known: Tokenizers, tokens: Tokens, texts: np.ndarray) -> tuple[list, ...]:
    """For closed stretches laid one after another, ending at ``texts``: groups, links, spelled groups, id pairs and their times."""
    ends = tokens.common()
    a_group, b_group = np.searchsorted(ends, tokens.a_ends), np.searchsorted(ends, tokens.b_ends)
    spelled = np.empty(len(tokens.a) + len(tokens.b), np.int64)
    last = np.append(ends, -1)
    spelled[np.arange(len(tokens.a)) + np.searchsorted(b_group, a_group)] = 2 * tokens.a + (last[a_group] == tokens.a_ends)
    spelled[np.arange(len(tokens.b)) + np.searchsorted(a_group, b_group, "right")] = 2 * (known.n_a + tokens.b) + (last[b_group] == tokens.b_ends)
    bounds = np.searchsorted(tokens.a_ends, texts, "right") + np.searchsorted(tokens.b_ends, texts, "right")
    codes, strings, at = spelled.tolist(), [], 0
    for to in bounds.tolist():
        strings.append(b"".join(map(known.spelled.__getitem__, codes[at:to]))[:-1].decode())
        at = to
    links = np.union1d(tokens.a_ends, tokens.b_ends)
    owner = np.searchsorted(texts, links)
    pair = (owner * known.n_a + tokens.a[np.searchsorted(tokens.a_ends, links)]) * known.n_b + tokens.b[np.searchsorted(tokens.b_ends, links)]
    pair, times = np.unique(pair, return_counts=True)
    offsets = np.searchsorted(pair // (known.n_a * known.n_b), np.arange(len(texts) + 1))
    pair %= known.n_a * known.n_b
    pair = pair // known.n_b << 32 | pair % known.n_b
    lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), v) for v in (pa.array(pair), pa.array(times, pa.int32()))]
    n_groups, n_links = (np.diff(np.searchsorted(x, texts, "right"), prepend=0) for x in (ends, links))
    return n_groups, n_links, pa.array(strings, pa.string()), *lists


def _whole(known: Tokenizers, part: wb.Texts) -> list[pa.Array]:
    """Columns of ``ALIGNED`` but the id, for whole texts."""
    data = [part.text(i) for i in range(len(part))]
    texts = [x.decode("utf-8", "replace") for x in data]
    b_ids = known.b(texts)
    a_lists, b_lists, sizes = [], [], []
    for raw, text, b in zip(data, texts, b_ids, strict=True):
        a = known.a(" " + text) if raw else []
        fine = raw and known.spells(a, known.a_bytes, b" " + raw) and known.spells(b, known.b_bytes, b" " + raw)
        a_lists.append(a if fine else [])
        b_lists.append(b if fine else [])
        sizes.append(len(raw) + 1 if fine else 0)
    a, b = (np.array([i for x in lists for i in x], np.int64) for lists in (a_lists, b_lists))
    tokens = Tokens(a, np.cumsum(known.a_sizes[a]), b, np.cumsum(known.b_sizes[b]))
    counts = [pa.array([len(x) for x in lists], pa.int64()) for lists in (a_lists, b_lists)]
    # Texts without tokens end where the one before does, and own nothing.
    ends = np.cumsum(sizes)
    real = np.flatnonzero(np.array(sizes) > 0)
    found = _aligned(known, tokens, ends[real])
    place = np.full(len(data), len(real), np.int64)
    place[real] = np.arange(len(real))
    none = (np.zeros(1, np.int64), np.zeros(1, np.int64), pa.array([""]), pa.array([[]], pa.list_(pa.int64())), pa.array([[]], pa.list_(pa.int32())))
    columns = [pa.concat_arrays([pa.array(x), pa.array(y)]) for x, y in zip(found, none, strict=True)]
    return counts + [x.take(pa.array(place)) for x in columns]


def _short(docs: DataFrame, folder: str) -> DataFrame:
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wb.slices(batch.column(1)):
                ids = batch.column(0).slice(part.first, len(part))
                yield pa.RecordBatch.from_arrays([ids, *_whole(loaded(folder), part)], names=[f.split()[0] for f in ALIGNED.split(", ")])

    return docs.mapInArrow(run, ALIGNED)


def ranges(text: str, chunk: int = CHUNK) -> list[tuple[int, int]]:
    """Where each range begins in space + text, for A and for B; and the end, for both."""
    full = " " + text
    cuts = [(0, 0)]
    while True:
        found = _SAFE_A.search(full, cuts[-1][1] + chunk)
        if not found:
            break
        a = found.start()
        found = _SAFE_B.search(full, a)
        cuts.append((a, found.start() if found else len(full)))
    if len(full) > cuts[-1][0]:
        cuts.append((len(full), len(full)))
    return cuts


_RANGE = "row long, node long, fine boolean, text string, a_chars long, b_from long, at long"
_TOKENS = ", ".join(f"{side}_{kind} array<{size}>" for side in ("p", "s") for kind, size in (("a", "int"), ("ae", "long"), ("b", "int"), ("be", "long")))
_NODE = f"row long, node long, cut boolean, {_TOKENS}"
_PIECE = "start long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>"
_STEP = f"{_NODE}, {_PIECE}, fine boolean, n_a long, n_b long"


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _split(docs: DataFrame, chunk: int) -> DataFrame:
    """Rows of byte ranges. ``docs`` has (row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wb.slices(batch.column(1)):
                for i in range(len(part)):
                    raw = part.text(i)
                    text = raw.decode("utf-8", "replace")
                    full, cuts, at = " " + text, ranges(text, chunk), 0
                    fine = text.encode() == raw
                    for node, ((a, b), (a_next, b_next)) in enumerate(zip(cuts, cuts[1:])):
                        row = [batch.column(0)[part.first + i].as_py(), node, fine, full[a:b_next], a_next - a, b - a, at]
                        yield pa.RecordBatch.from_pylist([dict(zip(_names(_RANGE), row, strict=True))])
                        at += len(full[a:a_next].encode())

    return docs.mapInArrow(run, _RANGE)


def _node_row(row: int, node: int, part: Fragment) -> dict:
    lists = [x.tolist() for x in (*part.prefix.parts(), *part.suffix.parts())]
    return dict(zip(_names(_NODE), (row, node, part.cut, *lists), strict=True))


def _node_of(row: dict) -> Fragment:
    lists = [np.array(row[n], np.int64) for n in _names(_TOKENS)]
    return Fragment(Tokens(*lists[:4]), row["cut"], Tokens(*lists[4:]))


def _piece_row(known: Tokenizers, row: int, tokens: Tokens) -> Iterator[dict]:
    if len(tokens.a):
        n_groups, n_links, strings, pairs, times = _aligned(known, tokens, tokens.a_ends[-1:])
        values = (int(tokens.a_ends[0]), int(n_groups[0]), int(n_links[0]), strings[0].as_py(), pairs[0].as_py(), times[0].as_py())
        yield {"row": row} | dict(zip(_names(_PIECE), values, strict=True))


def _fragments(known: Tokenizers, r: dict) -> Iterator[dict]:
    """A range's fragment, with its closed groups as a piece."""
    a_text, b_text = r["text"][: r["a_chars"]], r["text"][r["b_from"] :]
    b_at = r["at"] + len(r["text"][: r["b_from"]].encode())
    a, b = known.a(a_text), known.b([b_text[1:]])[0] if b_text else []
    fine = r["fine"] and known.spells(a, known.a_bytes, a_text.encode()) and known.spells(b, known.b_bytes, b_text.encode())
    totals = {"fine": fine, "n_a": len(a), "n_b": len(b)}
    if not fine:
        yield _node_row(r["row"], r["node"], Fragment(NOTHING)) | totals
        return
    x, y = np.array(a, np.int64), np.array(b, np.int64)
    part, closed = fragment(Tokens(x, r["at"] + np.cumsum(known.a_sizes[x]), y, b_at + np.cumsum(known.b_sizes[y])))
    yield _node_row(r["row"], r["node"], part) | totals
    yield from _piece_row(known, r["row"], closed)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
    kinds |= {"array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in ddl.split(", "))])


def _reduced(nodes: DataFrame, folder: str, fan: int) -> DataFrame:
    """One round: up to ``fan`` neighbours become one node, and what closes between them pieces."""

    def run(group: pa.Table) -> pa.Table:
        known, out, total = loaded(folder), [], None
        rows = sorted(group.to_pylist(), key=lambda r: r["node"])
        for r in rows:
            part = _node_of(r)
            if total is None:
                total = part
            else:
                total, closed = compose(total, part)
                out += _piece_row(known, r["row"], closed)
        out.append(_node_row(rows[0]["row"], rows[0]["node"] // fan, total))
        return pa.Table.from_pylist(out, _schema(f"{_NODE}, {_PIECE}"))

    return nodes.groupBy("row", F.expr(f"node div {fan}").alias("_parent")).applyInArrow(run, f"{_NODE}, {_PIECE}")


def _long(docs: DataFrame, folder: str, chunk: int, fan: int) -> DataFrame:
    """``ALIGNED`` and ``pieces``, for texts of several ranges."""
    numbered = cut(docs.withColumn("row", F.monotonically_increasing_id()), "long_texts")
    split = _split(numbered.select("row", "text"), chunk).repartition("row", "node")

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                rows = list(_fragments(loaded(folder), batch.slice(r, 1).to_pylist()[0]))
                yield pa.RecordBatch.from_pylist(rows, _schema(_STEP))

    first = cut(split.mapInArrow(tokenise, _STEP), "fragments")
    nodes = first.filter("node IS NOT NULL")
    totals = nodes.groupBy("row").agg(F.min("fine").alias("fine"), F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"), F.max("node").alias("top"))
    totals = cut(numbered.select("row", "doc_id").join(totals, "row"), "totals")
    fine = totals.filter("fine").select("row")
    step, top = first, totals.agg(F.max("top")).first()[0]
    pieces = [first.filter("start IS NOT NULL").select("row", *_names(_PIECE))]
    nodes = nodes.join(fine, "row", "left_semi")
    while top:
        step, top = cut(_reduced(nodes.select(*_names(_NODE)), folder, fan), "fragments"), top // fan
        nodes = step.filter("node IS NOT NULL")
        pieces.append(step.filter("start IS NOT NULL").select("row", *_names(_PIECE)))

    def close(batch: pa.RecordBatch) -> pa.RecordBatch:
        # A text begins and ends with a cut: its first open prefix is a group, and no suffix is left.
        rows = [p for r in batch.to_pylist() for p in _piece_row(loaded(folder), r["row"], _node_of(r).prefix)]
        return pa.RecordBatch.from_pylist(rows, _schema(f"row long, {_PIECE}"))

    pieces.append(map_batches(nodes.select(*_names(_NODE)), close, f"row long, {_PIECE}"))
    found = pieces[0]
    for more in pieces[1:]:
        found = found.unionByName(more)
    found = found.join(fine, "row", "left_semi").groupBy("row").agg(
        F.sum("n_groups").alias("n_groups"), F.sum("n_links").alias("n_links"),
        F.array_sort(F.collect_list(F.struct("start", "groups"))).alias("strings"),
        F.flatten(F.collect_list("pairs")).alias("pairs"), F.flatten(F.collect_list("times")).alias("times"),
    )
    out = totals.join(found, "row", "left")
    zero = lambda name: F.when(F.col("fine"), F.col(name)).otherwise(0).cast("long").alias(name)
    return out.select(
        "doc_id", *[zero(n) for n in ("n_a", "n_b", "n_groups", "n_links")],
        F.coalesce(F.concat_ws(";", F.col("strings.groups")), F.lit("")).alias("groups"),
        F.coalesce("pairs", F.array().cast("array<long>")).alias("pairs"), F.coalesce("times", F.array().cast("array<int>")).alias("times"),
    )


def align(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str = FOLDER, chunk: int = CHUNK, fan: int = FAN
) -> DataFrame:
    """A row a document: counts, ``groups`` (``a1,a2|b1;a3|b2,b3``), and its linked id pairs (A id * 2^32 + B id) with how often.

    ``repeats`` says whether a pair may be listed more than once.
    """
    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    long = F.coalesce(F.octet_length("text") > chunk, F.lit(False))
    short = _short(chosen.filter(~long), folder).withColumn("repeats", F.lit(False))
    return short.unionByName(_long(chosen.filter(long), folder, chunk, fan).withColumn("repeats", F.lit(True)))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Rows (pair, n_docs, best): documents that hold the pair, and whether none of its A id's pairs is in more."""
    held = F.when(F.col("repeats"), F.array_distinct("pairs")).otherwise(F.col("pairs"))
    counts = aligned.select(F.explode(held).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n_docs"))
    counts = cut(counts.withColumn("a", F.shiftright("pair", 32)), "pair_counts")
    most = counts.groupBy("a").agg(F.max("n_docs").alias("most"))
    return counts.join(most, "a").select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def with_counts(aligned: DataFrame, at_once: int = PAIRS_AT_ONCE) -> DataFrame:
    """The rows of ``align`` with ``n_best`` and ``count_sum`` in place of the pairs; other columns stay."""
    kept = cut(aligned.withColumn("_at", F.monotonically_increasing_id()), "aligned")
    table = cut(pair_counts(kept), "pairs")
    others = [c for c in kept.columns if c not in ("pairs", "times", "repeats", "_at")]
    if table.count() <= at_once:
        return _looked_up(kept, table, others)
    links = kept.select("_at", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select(
        "_at", F.col("link.pairs").alias("pair"), F.col("link.times").cast("long").alias("times"), F.pmod("_at", F.lit(_SALTS)).alias("salt")
    )
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))))
    sums = links.join(salted, ["pair", "salt"]).groupBy("_at").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n_docs")).alias("count_sum")
    )
    zero = [F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("n_best", "count_sum")]
    return kept.join(sums, "_at", "left").select(*others, *zero)


def _looked_up(kept: DataFrame, table: DataFrame, others: list[str]) -> DataFrame:
    packed = table.toArrow()
    order = np.argsort(packed["pair"].to_numpy())
    values = [packed[n].to_numpy(zero_copy_only=False)[order] for n in ("pair", "n_docs", "best")]
    shared = kept.sparkSession.sparkContext.broadcast(values)

    def compute(batch: pa.RecordBatch) -> pa.RecordBatch:
        pair, n_docs, best = shared.value
        lists = batch.column(len(others))
        times = batch.column(len(others) + 1).flatten().to_numpy().astype(np.int64)
        at = np.searchsorted(pair, lists.flatten().to_numpy())
        bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
        sums = [pa.array(wb.per_text(x, bounds)) for x in (times * best[at], times * n_docs[at])]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(others)], *sums], names=[*others, "n_best", "count_sum"])

    fields = ", ".join(f"`{n}` {t}" for n, t in kept.select(*others).dtypes)
    return map_batches(kept.select(*others, "pairs", "times"), compute, f"{fields}, n_best long, count_sum long")
