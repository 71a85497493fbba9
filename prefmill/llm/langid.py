"""Operator 2, language identification: nearest of several centroids per language.

Texts become TF-IDF vectors over hashed byte n-grams of their letters (square root of the count times
idf, length 1). Document frequencies count all documents to learn from; each language's vectors, of a
bounded sample, are clustered into a few centroids by spherical k-means. A text gets the language of
the centroid with the largest cosine. One less similar than a low quantile of the language's learned documents
of its length, all of them counted, is rejected, if it has enough letters to tell.

Defined results: null, empty and letterless texts are ``und`` with score 0 and rejected. Documents
without a language teach nothing; with nothing learned every text is ``und``. Equal cosines go to the
first language by name. Repeated rows get equal answers. The whole text counts, however long.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefmill.llm import wordbytes as wb
from prefmill.llm.tables import bounded_batches, map_batches, unit

UND = "und"
#: Classes of length, two for each doubling of the letters; steps of similarity that are counted.
LENGTHS, STEPS = 64, 256
#: Texts whose counts are held at once, a row of ``dims`` numbers each.
ROWS = 200
_LETTERS_ONLY = np.where(wb.LETTER, np.arange(256), 32).astype(np.uint8)

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("rejected", T.BooleanType()),
    ]
)


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the documents per language that are clustered, ``most`` those of all (on average; hash-chosen)."""

    dims: int = 8192
    orders: tuple[int, ...] = (2, 3, 4)
    centroids: int = 4
    sample: int = 400
    most: int = 8000
    rounds: int = 8
    #: A text with fewer letters is never rejected for its distance.
    min_letters: int = 200
    #: Rejected below ``slack`` times this quantile of the similarities of the language's learned documents of about that length.
    quantile: float = 0.005
    slack: float = 0.95
    #: With too few documents for the quantile: below this part of their least similarity.
    slack_few: float = 0.6
    seed: int = 17


@dataclass(frozen=True)
class Model:
    """``floor`` has a row for each centroid and a column for each class of length."""

    settings: Settings
    idf: np.ndarray
    langs: tuple[str, ...]
    centroids: np.ndarray
    floor: np.ndarray


def _has_letter(part: wb.Texts) -> np.ndarray:
    """Whether a text has a letter of any script."""
    ascii_letter = np.zeros(256, bool)
    ascii_letter[65:91] = ascii_letter[97:123] = True
    found = np.concatenate([[0], np.cumsum(ascii_letter[part.data])])
    out = found[part.offsets[1:]] > found[part.offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(part.offsets) > 0)):
        out[i] = any(c.isalpha() for c in part.text(i).decode("utf-8", "ignore"))
    return out


def _lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(column, ""))


def counts(part: wb.Texts, settings: Settings) -> np.ndarray:
    """N-gram counts by bucket, one row a text."""
    data = _LETTERS_ONLY[part.data]
    n, dims = len(part), settings.dims
    owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(part.offsets))
    shift = np.uint32(32 - (dims - 1).bit_length())
    out = np.zeros(n * dims, np.int32)
    if len(data) == 0:
        return out.reshape(n, dims)
    blank = data == 32
    for order in settings.orders:
        m = len(data) - order + 1
        if m <= 0:
            continue
        code = np.full(m, order, np.uint32)
        empty = blank[:m].copy()
        for k in range(order):
            code = code * np.uint32(0x01000193) ^ data[k : k + m]
            if k:
                empty &= blank[k : k + m]
        bucket = ((code * np.uint32(2654435769)) >> shift).astype(np.int64)
        bucket += owner[:m] * dims
        out += np.bincount(bucket[(owner[:m] == owner[order - 1 :]) & ~empty], minlength=n * dims).astype(np.int32)
    return out.reshape(n, dims)


def vectors(by_bucket: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = np.sqrt(by_bucket.astype(np.float32)) * idf
    return out / np.maximum(1e-9, np.sqrt((out * out).sum(1)))[:, None]


def _letters(part: wb.Texts) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(wb.LETTER[part.data] & wb.LEAD[part.data])])
    return total[part.offsets[1:]] - total[part.offsets[:-1]]


def _length(letters: np.ndarray) -> np.ndarray:
    return np.minimum(LENGTHS - 1, 2 * np.log2(np.maximum(1, letters))).astype(int)


def floors(counted: np.ndarray, settings: Settings) -> np.ndarray:
    """Least similarity by class of length, from counts of documents by class and step of similarity."""
    least = 1 / settings.quantile

    def low(by_step: np.ndarray) -> float:
        n = by_step.sum()
        if n == 0:
            return 0.0
        place = np.searchsorted(np.cumsum(by_step), settings.quantile * n, "right") / STEPS
        return place * (settings.slack if n >= least else settings.slack_few)

    whole = low(counted.sum(0))
    return np.array([low(row) if row.sum() >= least else whole for row in counted])


def _cluster(points: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means from points spread evenly over the given order; clusters of a few odd points are dropped."""
    chosen = points[np.unique(np.linspace(0, len(points) - 1, min(k, len(points))).astype(int))]
    centres = chosen.copy()
    for _ in range(rounds):
        mine = (points @ centres.T).argmax(1)
        for c in range(len(centres)):
            if (mine == c).any():
                total = points[mine == c].sum(0)
                centres[c] = total / max(1e-9, np.linalg.norm(total))
    size = np.bincount((points @ centres.T).argmax(1), minlength=len(centres))
    return centres[size >= max(1, len(points) // 20)]


#: Documents of a language that clustering sees at least, on average; with more than ``most`` / ``LEAST_EACH`` languages,
#: those with most documents are learned.
LEAST_EACH = 8


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", settings: Settings = Settings()) -> Model:
    """Learn from all given documents that name a language.

    Document frequencies and similarities are counted over all of them; clustering sees about ``sample`` documents
    of each language, ``most`` in all, whose vectors (dims x 2 bytes each) are gathered.
    """
    bounded_batches(docs.sparkSession)
    known = docs.select(F.col(key).cast("string").alias("k"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter(
        "lang IS NOT NULL AND text IS NOT NULL"
    )
    dims = settings.dims

    def frequencies(batches):
        held, n = np.zeros(dims, np.int64), 0
        for batch in batches:
            for part in wb.slices(_lowered(batch.column(0)), most=ROWS):
                held += (counts(part, settings) > 0).sum(0)
                n += len(part)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(-1, dims)), pa.array(np.concatenate([[n], held]))], names=["bucket", "n"]
            )

    def sampled(batches):
        for batch in batches:
            codes = batch.column(1).to_pylist()
            for part in wb.slices(_lowered(batch.column(0)), most=ROWS):
                rows = counts(part, settings).astype(np.float32)
                packed = [np.sqrt(r).astype(np.float16).tobytes() for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(codes[part.first : part.first + len(part)], pa.string()),
                        pa.array(packed, pa.binary()),
                    ],
                    names=["lang", "v"],
                )

    seen = known.select("text").mapInArrow(frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    by_bucket = {r["bucket"]: r["n"] for r in seen}
    total = by_bucket.get(-1, 0)
    idf = np.array([np.log((1 + total) / (1 + by_bucket.get(b, 0))) + 0.1 for b in range(dims)], np.float32)
    counted = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang")
    sizes = counted.limit(max(1, settings.most // LEAST_EACH)).collect()
    each = min(settings.sample, settings.most // max(1, len(sizes)))
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, each / r["n"])) for r in sizes], "lang string, share double")
    picked = known.join(F.broadcast(shares), "lang").filter(unit(F.col("k"), seed=settings.seed) < F.col("share"))
    rows = picked.select("text", "lang", "k").repartition(F.col("k")).select("text", "lang").mapInArrow(sampled, "lang string, v binary").collect()
    langs, centres = [], []
    for code in sorted({r["lang"] for r in rows}):
        own = sorted(r["v"] for r in rows if r["lang"] == code)
        points = np.array([np.frombuffer(v, np.float16) for v in own], np.float32) * idf
        size = np.sqrt((points * points).sum(1))
        points = points[size > 0] / size[size > 0][:, None]
        if not len(points):
            continue
        found = _cluster(points, settings.centroids, settings.rounds)
        langs += [code] * len(found)
        centres += list(found)
    if not langs:
        return Model(settings, idf, (), np.zeros((0, dims), np.float32), np.zeros((0, LENGTHS)))
    centroids, names = np.array(centres, np.float32), np.array(langs, object)

    def similarities(batches):
        held: dict[tuple[str, int, int], int] = {}
        for batch in batches:
            codes = np.array(batch.column(1).to_pylist(), object)
            for part in wb.slices(_lowered(batch.column(0)), most=ROWS):
                own, letters = codes[part.first : part.first + len(part)], _letters(part)
                near = vectors(counts(part, settings), idf) @ centroids.T
                near = np.where(names[None, :] == own[:, None], near, -1).max(1)
                step = np.clip(near * STEPS, 0, STEPS - 1).astype(int)
                for i in np.flatnonzero((letters >= settings.min_letters) & (near >= 0)):
                    place = own[i], int(_length(letters[i])), int(step[i])
                    held[place] = held.get(place, 0) + 1
        if held:
            columns = [pa.array(x, t) for x, t in zip(zip(*held, strict=True), (pa.string(), pa.int32(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(held.values()), pa.int64())], names=["lang", "length", "step", "n"])

    near = known.select("text", "lang").mapInArrow(similarities, "lang string, length int, step int, n long")
    counted = {code: np.zeros((LENGTHS, STEPS), np.int64) for code in langs}
    for r in near.groupBy("lang", "length", "step").agg(F.sum("n").alias("n")).collect():
        counted[r["lang"]][r["length"], r["step"]] = r["n"]
    by_code = {code: floors(c, settings) for code, c in counted.items()}
    return Model(settings, idf, tuple(langs), centroids, np.array([by_code[code] for code in langs]))


def _predict(column: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, score and rejection of each text."""
    langs, scores, rejected = [], [], []
    names = np.array([*model.langs, UND], object)
    original = wb.slices(column, most=ROWS)
    lowered = pc.fill_null(column, "")
    for part in original:
        some = _has_letter(part)
        low = _lowered(lowered.slice(part.first, len(part)))
        best, cosine = np.full(len(part), len(model.langs)), np.zeros(len(part))
        far = np.ones(len(part), bool)
        for piece in wb.slices(low, limit=2 * wb.SLICE_BYTES + 2 * int(part.offsets[-1])):
            at = slice(piece.first, piece.first + len(piece))
            if model.langs:
                near = vectors(counts(piece, model.settings), model.idf) @ model.centroids.T
                letters = _letters(piece)
                best[at] = near.argmax(1)
                cosine[at] = near.max(1)
                far[at] = (near.max(1) < model.floor[near.argmax(1), _length(letters)]) & (letters >= model.settings.min_letters)
        best = np.where(some, best, len(model.langs))
        langs.append(names[best])
        scores.append(np.where(some, np.clip(cosine, 0, 1), 0.0))
        rejected.append(far | ~some)
    return np.concatenate(langs), np.concatenate(scores), np.concatenate(rejected)


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Language, score and rejection of each document."""

    def answer(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, scores, rejected = _predict(batch.column(1), model)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
            names=SCHEMA.fieldNames(),
        )

    return map_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), answer, SCHEMA)


def language_filter(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    at = docs.columns.index(text)

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(~_predict(batch.column(at), model)[2]))

    return map_batches(docs, keep, docs.schema)


def learned(docs: DataFrame, held_out: Column) -> DataFrame:
    """The documents that are not held out; those without an id teach nothing."""
    return docs.filter(~F.coalesce(held_out, F.lit(True)))
