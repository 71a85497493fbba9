"""Operator 10, quality rules: distribution divergence.

A document's character-class and common-word histograms are held against references of each language
by Jensen-Shannon distance. The references are counts over all labelled documents. A document fails
when it is far from every language; histograms of short texts are noisy, so distances count only from
a minimum length and are allowed the divergence that chance alone gives at that length. Before that,
plain count rules apply.

Defined results: a null text counts as empty (no words, fails the base rules). Documents without a
language help no reference. Without any reference the divergence rule passes all. Ties between
languages go to the first by name. Repeated rows are judged each. Other columns are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefmill.llm import wordbytes as wb
from prefmill.llm.tables import bounded_batches, cut, map_batches

#: Character classes: lower-case, upper-case, digit, blank, line end, punctuation of prose, other ASCII, beyond ASCII.
CLASSES = 8
_SKIP = CLASSES


def _class_table() -> np.ndarray:
    table = np.full(256, 6, np.uint8)
    table[97:123], table[65:91], table[48:58] = 0, 1, 2
    table[[32, 9]], table[[10, 11, 12, 13]] = 3, 4
    table[list(b".,;:!?'\"()-")] = 5
    table[128:192], table[192:] = _SKIP, 7
    return table


CLASS_OF = _class_table()
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Rules:
    """Limits of the rules; distances are square roots of divergences in bits, 0 to 1."""

    min_words: int = 20
    repeat_percent: int = 30
    repeat_width: int = 8
    #: A word is common when it makes up this share of its language's words.
    common_share: float = 0.003
    min_class_chars: int = 200
    min_common_words: int = 60
    class_distance: float = 0.30
    word_distance: float = 0.30
    #: How many times the divergence of classes expected by chance is forgiven.
    chance: float = 3.0
    #: How many standard deviations of the words' divergence by chance are forgiven.
    spread: float = 3.0


@dataclass(frozen=True)
class References:
    """Per language: shares of the character classes and of the common words (hash order, all others last)."""

    langs: tuple[str, ...]
    classes: np.ndarray
    words: tuple[np.ndarray, ...]
    shares: tuple[np.ndarray, ...]


SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("word_chars", T.LongType()),
        T.StructField("n_symbols", T.LongType()),
        T.StructField("n_dup_lines", T.LongType()),
        T.StructField("n_repeat_words", T.LongType()),
        T.StructField("class_distance", T.DoubleType()),
        T.StructField("word_distance", T.DoubleType()),
        T.StructField("nearest_lang", T.StringType()),
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("kept", T.BooleanType()),
    ]
)


def _bare_words(part: wb.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    low = wb.Texts(part.first, wb.LOWER[part.data], part.offsets)
    starts, ends, bounds = wb.spans(low, wb.LETTER)
    return wb.hashes(low.data, starts, ends), bounds, starts, ends


def _class_counts(part: wb.Texts) -> np.ndarray:
    owner = np.repeat(np.arange(len(part)), np.diff(part.offsets))
    flat = np.bincount(owner * (CLASSES + 1) + CLASS_OF[part.data], minlength=len(part) * (CLASSES + 1))
    return flat.reshape(len(part), CLASSES + 1)[:, :CLASSES]


def fit_references(docs: DataFrame, text: str = "text", lang: str = "lang", rules: Rules = Rules()) -> References:
    """Class and common-word shares of each language over all documents that name one.

    Counts are added up per task and language first, so what is shuffled is one row for each word of a
    task. What reaches the driver is bounded: at most 1 / ``common_share`` words and eight classes a language.
    """
    labelled = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang IS NOT NULL")
    bounded_batches(docs.sparkSession)

    def count(batches):
        words: dict[str, list[np.ndarray]] = {}
        classes: dict[str, np.ndarray] = {}

        def packed(code: str) -> tuple[np.ndarray, np.ndarray]:
            parts = words[code]
            all_h, inverse = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
            return all_h, np.bincount(inverse, np.concatenate([n for _, n in parts])).astype(np.int64)

        def rows(code: str):
            h, n = packed(code)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([code] * (len(h) + CLASSES + 1), pa.string()),
                    pa.array([0] * len(h) + [1] * CLASSES + [2], pa.int32()),
                    pa.array(np.concatenate([h.view(np.int64), np.arange(CLASSES), [0]])),
                    pa.array(np.concatenate([n, classes[code], [n.sum()]])),
                ],
                names=["lang", "kind", "h", "n"],
            )

        held = 0
        for batch in batches:
            codes = batch.column(0).to_pylist()
            for part in wb.slices(batch.column(1)):
                word, bounds, _, _ = _bare_words(part)
                by_class = _class_counts(part)
                mine = np.array(codes[part.first : part.first + len(part)], object)
                for code in set(mine.tolist()):
                    own = mine == code
                    classes[code] = classes.get(code, np.zeros(CLASSES, np.int64)) + by_class[own].sum(0)
                    h, n = np.unique(word[np.repeat(own, np.diff(bounds))], return_counts=True)
                    words.setdefault(code, []).append((h, n))
                    held += len(h)
            if held > 1_000_000:  # what a task keeps is bounded; the sums below take several rows of a word
                yield from (rows(code) for code in words)
                words, classes, held = {}, {}, 0
        yield from (rows(code) for code in words)

    counts = labelled.mapInArrow(count, "lang string, kind int, h long, n long").groupBy("lang", "kind", "h").agg(F.sum("n").alias("n"))
    counts = cut(counts, "word-counts")
    total = F.broadcast(counts.filter("kind = 2").select("lang", F.col("n").alias("total")))  # a row a language
    found = counts.join(total, "lang").filter(F.expr(f"kind = 1 OR (kind = 0 AND n >= {rules.common_share!r} * total)")).collect()
    langs = tuple(sorted({r["lang"] for r in found}))
    classes, words, shares = [], [], []
    for code in langs:
        own = [r for r in found if r["lang"] == code]
        by_class = np.zeros(CLASSES)
        for r in own:
            if r["kind"] == 1:
                by_class[r["h"]] = r["n"]
        classes.append(by_class / max(1.0, by_class.sum()))
        common = sorted((np.uint64(r["h"] % (1 << 64)), r["n"]) for r in own if r["kind"] == 0)
        total = max([1, *(r["total"] for r in own if r["total"])])
        part = np.array([n for _, n in common], float) / total
        words.append(np.array([h for h, _ in common], np.uint64))
        shares.append(np.append(part, max(0.0, 1.0 - part.sum())))
    return References(langs, np.array(classes).reshape(len(langs), CLASSES), tuple(words), tuple(shares))


def _entropy(p: np.ndarray) -> np.ndarray:
    return -(p * np.log2(p, out=np.zeros_like(p), where=p > 0)).sum(-1)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits of the rows of p and the distribution q."""
    return np.maximum(0.0, _entropy((p + q) / 2) - (_entropy(p) + _entropy(q)) / 2)


def _chance(bins: int, n: np.ndarray) -> np.ndarray:
    """The divergence expected between a distribution and n draws from it."""
    return (bins - 1) / (8 * np.log(2) * np.maximum(1, n))


def _duplicate_lines(part: wb.Texts, word_starts: np.ndarray) -> np.ndarray:
    starts, ends, bounds = wb.lines(part)
    h = wb.hashes(part.data, starts, ends)
    owner = wb.owners(bounds)
    full = np.searchsorted(word_starts, starts) < np.searchsorted(word_starts, ends)
    owner, h = owner[full], h[full]
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    again = (owner[1:] == owner[:-1]) & (h[1:] == h[:-1])
    return np.bincount(owner[1:][again], minlength=len(part))


def _repeated_words(part: wb.Texts, word: np.ndarray, bounds: np.ndarray, width: int) -> np.ndarray:
    at = wb.whole(bounds, width)
    if not len(at):
        return np.zeros(len(part), np.int64)
    owner = wb.owners(bounds)
    window = wb.chain(word, at, tuple(range(width))) ^ wb.mix(owner[at].astype(np.uint64) + np.uint64(1))
    _, inverse, n = np.unique(window, return_inverse=True, return_counts=True)
    twice = at[n[inverse] > 1]
    edge = np.zeros(bounds[-1] + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + width, -1)
    return wb.per_text(np.cumsum(edge)[:-1] > 0, bounds)


def measure(part: wb.Texts, refs: References, rules: Rules) -> dict[str, np.ndarray]:
    """All columns of the verdict for a slice of texts."""
    starts, ends, bounds = wb.spans(part, wb.WORD)
    lead = np.concatenate([[0], np.cumsum(wb.LEAD[part.data])])
    symbols = np.concatenate([[0], np.cumsum(SYMBOL[part.data])])
    n_words = np.diff(bounds)
    out = {
        "n_words": n_words,
        "word_chars": wb.per_text(lead[ends] - lead[starts], bounds),
        "n_symbols": symbols[part.offsets[1:]] - symbols[part.offsets[:-1]],
        "n_dup_lines": _duplicate_lines(part, starts),
        "n_repeat_words": _repeated_words(part, wb.hashes(part.data, starts, ends), bounds, rules.repeat_width),
    }
    n, langs = len(part), len(refs.langs)
    by_class = _class_counts(part).astype(float)
    n_class = by_class.sum(1)
    by_class /= np.maximum(1, n_class)[:, None]
    bare, bare_bounds, _, _ = _bare_words(part)
    n_bare = np.diff(bare_bounds)
    owner = wb.owners(bare_bounds)
    far_class, far_word = np.zeros((n, langs)), np.zeros((n, langs))
    over = np.zeros((n, langs))
    for k in range(langs):
        common, share = refs.words[k], refs.shares[k]
        place = np.searchsorted(common, bare)
        place[place == len(common)] = max(0, len(common) - 1)
        known = common[place] == bare if len(common) else np.zeros(len(bare), bool)
        place = np.where(known, place, len(common))
        by_word = np.bincount(owner * len(share) + place, minlength=n * len(share)).reshape(n, len(share))
        d_class = divergence(by_class, refs.classes[k])
        d_word = divergence(by_word / np.maximum(1, n_bare)[:, None], share)
        far_class[:, k], far_word[:, k] = np.sqrt(d_class), np.sqrt(d_word)
        limit_class = rules.class_distance**2 + rules.chance * _chance(CLASSES, n_class)
        # Twice a divergence by chance, times the words, is spread like chi-square: its deviation is its mean times the root of 2 / (bins - 1).
        by_chance = _chance(len(share), n_bare)
        limit_word = np.maximum(rules.word_distance**2, by_chance) + rules.spread * by_chance * np.sqrt(2 / max(1, len(share) - 1))
        over[:, k] = np.maximum(
            np.where(n_class >= rules.min_class_chars, d_class / limit_class, 0),
            np.where(n_bare >= rules.min_common_words, d_word / limit_word, 0),
        )
    if langs:
        best = np.lexsort((np.arange(langs) * np.ones((n, 1)), far_word + far_class, over), axis=1)[:, 0]
        rows = np.arange(n)
        out |= {"class_distance": far_class[rows, best], "word_distance": far_word[rows, best]}
        out["nearest_lang"] = np.array(refs.langs, object)[best]
        fine = over[rows, best] <= 1
    else:
        out |= {"class_distance": np.zeros(n), "word_distance": np.zeros(n), "nearest_lang": np.array([None] * n, object)}
        fine = np.ones(n, bool)
    failed = (n_words < rules.min_words) | (100 * out["n_repeat_words"] > rules.repeat_percent * n_words)
    return out | {"base_failed": failed, "kept": ~failed & fine}


def _verdicts(column: pa.Array, refs: References, rules: Rules) -> list[dict[str, np.ndarray]]:
    return [measure(part, refs, rules) for part in wb.slices(column)]


def quality_report(
    docs: DataFrame, refs: References, doc_id: str = "doc_id", text: str = "text", rules: Rules = Rules()
) -> DataFrame:
    """Counts, distances and verdict of each document."""

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = _verdicts(batch.column(1), refs, rules)
        columns = [batch.column(0)]
        for field in SCHEMA.fields[1:]:
            kind = {"string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}.get(field.dataType.simpleString(), pa.int64())
            columns.append(pa.array(np.concatenate([p[field.name] for p in parts]), kind))
        return pa.RecordBatch.from_arrays(columns, names=SCHEMA.fieldNames())

    return map_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), judge, SCHEMA)


def quality_filter(docs: DataFrame, refs: References, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The documents kept, with all their columns."""
    at = docs.columns.index(text)

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = _verdicts(batch.column(at), refs, rules)
        return batch.filter(pa.array(np.concatenate([p["kept"] for p in parts])))

    return map_batches(docs, keep, docs.schema)
