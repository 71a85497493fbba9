"""Operator 8, toxicity: a linear-chain conditional random field over words.

Each word is toxic or not. Potentials: a bias, weights of the word and of its prefixes, and transitions
between neighbours. Labels come for documents, so words are labelled first: a feature that toxic documents
hold far more often than chance (binomial test, Benjamini-Hochberg) and others hardly hold marks the words of toxic documents that
have it. The field is fitted to windows of
labelled words by gradient ascent; forward-backward gives each word's
marginal; the marginals of a whole text give its score (a logistic curve of the largest and of their sum) and
the character offsets of its toxic words.

Fitting sees a bounded sample of labelled documents and of windows (``fit_docs``, ``fit_windows``, chosen by hash; a text
without a known feature teaches the 16 words in its middle); equal windows are counted in Spark. Scoring runs over whole
texts where they lie: words without a known feature all have the same potentials, so a run of them is one power
of a two-by-two matrix, and only the other words take a step.

Defined results: null, empty and wordless texts score as a text without any known feature. Without labels of both
kinds the model is a constant. Labels that name a document twice count as toxic if either does. Null ids and null
labels teach nothing. Repeated rows score alike. Other columns are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import comb, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefmill.llm import wordbytes as wb
from prefmill.llm.tables import bounded_batches, cut, map_batches

#: Bytes of the prefixes that are features beside the word itself.
PREFIXES = (4, 5, 6, 7, 8)
SCHEMA = "doc_id long, score double, predicted int, spans array<struct<start:long,end:long,p:double>>"


@dataclass(frozen=True)
class Settings:
    fit_docs: int = 8_000
    #: Different word windows the field is fitted to, chosen by hash.
    fit_windows: int = 6_000
    false_share: float = 0.05
    least_docs: int = 3
    #: Least share of toxic documents among those that hold a marking feature.
    purity: float = 0.6
    window: int = 4
    rounds: int = 120
    rate: float = 0.15
    ridge: float = 1e-3
    span_limit: float = 0.5


@dataclass(frozen=True)
class Field:
    """Known feature hashes in order and their weights; bias; transitions from and to (clean, toxic); curve of the score."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    transitions: np.ndarray
    curve: tuple[float, float, float]


def _features(part: wb.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature hashes of each word, one row a word (0: none), and the words' starts, ends and bounds."""
    data = wb.lowered(part.data)
    starts, ends, bounds = wb.spans(wb.Texts(part.first, data, part.offsets), wb.BARE)
    rolling = wb.Rolling(data)
    out = np.zeros((len(starts), 1 + len(PREFIXES)), np.uint64)
    out[:, 0] = rolling(starts, ends)
    for k, size in enumerate(PREFIXES, 1):
        long = ends - starts > size
        out[long, k] = rolling(starts[long], starts[long] + size) ^ np.uint64(k)
    return out, starts, ends, bounds


def _upper_tail(k: int, n: int, p: float) -> float:
    """The chance of k or more of n, each with chance p."""
    if n <= 200:
        return sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))
    share = k / n
    if share <= p:
        return 1.0
    bound = share * log(share / p) + ((1 - share) * log((1 - share) / (1 - p)) if share < 1 else 0.0)
    return float(np.exp(-n * bound))


def _accepted(table: list[tuple[int, int, int]], rate: float, false_share: float) -> list[tuple[int, int]]:
    """Of (toxic, clean, features with these counts), the counts that stand out."""
    tested = sorted((_upper_tail(n1, n1 + n0, rate), n1, n0, m) for n1, n0, m in table)
    total, rank, best = sum(m for *_, m in tested), 0, -1.0
    for p, _, _, m in tested:
        rank += m
        if p <= false_share * rank / total:
            best = p
    return [(n1, n0) for p, n1, n0, _ in tested if p <= best]


def _known(features: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Places (from 1) of the words' features among the known ones; 0 for others."""
    out = np.zeros(found.shape, np.int64)
    if not len(features):
        return out
    bits = min(24, 8 + len(features).bit_length())
    member = np.zeros(1 << bits, bool)
    member[(features >> np.uint64(64 - bits)).astype(np.int64)] = True
    rows, columns = np.nonzero(member[(found >> np.uint64(64 - bits)).astype(np.int64)] & (found != 0))
    values = found[rows, columns]
    place = np.minimum(np.searchsorted(features, values), len(features) - 1)
    same = features[place] == values
    out[rows[same], columns[same]] = place[same] + 1
    return out


def _forward_backward(emission: np.ndarray, valid: np.ndarray, times: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of toxic and expected transitions of padded sequences.

    emission: sequences x places, the toxic state's potential (the other's is 0); step: transitions.
    """
    n, length = emission.shape
    move = np.exp(step)
    push = np.stack([np.ones_like(emission), np.exp(np.clip(emission, -30, 30))], axis=2)
    alpha, scale = np.zeros((n, length, 2)), np.ones((n, length))
    before = np.tile([1.0, 0.0], (n, 1))
    for t in range(length):
        now = (before @ move) * push[:, t]
        now = np.where(valid[:, t, None], now, before)
        scale[:, t] = now.sum(1)
        before = alpha[:, t] = now / scale[:, t, None]
    beta = np.ones((n, length, 2))
    pairs = np.zeros((2, 2))
    after = np.ones((n, 2))
    for t in range(length - 1, -1, -1):
        beta[:, t] = after
        came = alpha[:, t - 1] if t else np.tile([1.0, 0.0], (n, 1))
        joint = came[:, :, None] * move[None] * (push[:, t] * after / scale[:, t, None])[:, None, :]
        pairs += np.tensordot(times * valid[:, t], joint, 1)
        after = np.where(valid[:, t, None], (push[:, t] * after / scale[:, t, None]) @ move.T, after)
    both = alpha * beta
    return both[:, :, 1] / both.sum(2), pairs


def _train(
    ids: np.ndarray, valid: np.ndarray, toxic: np.ndarray, times: np.ndarray, n_features: int, settings: Settings
) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, bias and transitions by gradient ascent (Adam) on the labelled sequences, each counted ``times``."""
    parameters = np.concatenate([np.zeros(n_features + 1), [-2.0], np.zeros(4)])
    first, second = np.zeros_like(parameters), np.zeros_like(parameters)
    came = np.concatenate([np.zeros((len(toxic), 1), int), toxic[:, :-1]], axis=1)
    seen = np.zeros((2, 2))
    each = np.where(valid, times[:, None], 0)
    np.add.at(seen, (came, toxic), each)
    size = max(1, each.sum())
    for round_ in range(1, settings.rounds + 1):
        weights = parameters[: n_features + 1].copy()
        weights[0] = 0.0
        emission = weights[ids].sum(2) + parameters[n_features + 1]
        p, pairs = _forward_backward(emission, valid, times, parameters[-4:].reshape(2, 2))
        error = each * (toxic - p)
        slope = np.bincount(ids.reshape(-1), np.repeat(error.reshape(-1), ids.shape[2]), minlength=len(parameters))
        slope[0] = 0.0
        slope[n_features + 1] = error.sum()
        slope[-4:] = (seen - pairs).reshape(-1)
        slope = slope / size - settings.ridge * parameters / max(1, n_features) ** 0.5
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        parameters = parameters + settings.rate * (first / (1 - 0.9**round_)) / (np.sqrt(second / (1 - 0.99**round_)) + 1e-8)
    return parameters[1 : n_features + 1], float(parameters[n_features + 1]), parameters[-4:].reshape(2, 2)


def _powers(field: Field) -> tuple[np.ndarray, np.ndarray, float]:
    """Parts of the plain step's matrix: power k is, but for scale, the first plus ratio ** k times the second."""
    plain = np.exp(field.transitions) * np.exp([0.0, field.bias])
    trace, det = np.trace(plain), np.linalg.det(plain)
    root = np.sqrt(max(0.0, trace * trace / 4 - det))
    large, small = trace / 2 + root, trace / 2 - root
    if large - small < 1e-12 * large:
        return np.eye(2), np.zeros((2, 2)), 1.0
    one = (plain - small * np.eye(2)) / (large - small)
    return one, np.eye(2) - one, small / large


def marginals(part: wb.Texts, field: Field) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice's words with a known feature: text, word's place, start, end, marginal; and the words of each text."""
    found, starts, ends, bounds = _features(part)
    ids = _known(field.features, found)
    at = np.flatnonzero(ids.any(1))
    owner = wb.owners(bounds)[at] if len(at) else np.zeros(0, np.int64)
    place = at - bounds[owner]
    emission = np.append(0.0, field.weights)[ids[at]].sum(1) + field.bias
    n = np.bincount(owner, minlength=len(part))
    begin = np.concatenate([[0], np.cumsum(n)])
    fresh = np.append(True, owner[1:] != owner[:-1]) if len(at) else np.zeros(0, bool)
    gap = np.where(fresh, place, place - np.append(0, place[:-1]) - 1) if len(at) else place
    n_words = np.diff(bounds)
    one, two, ratio = _powers(field)
    move = np.exp(field.transitions)
    push = np.column_stack([np.ones(len(at)), np.exp(np.clip(emission, -30, 30))])
    alpha, beta = np.zeros((len(at), 2)), np.zeros((len(at), 2))

    def run(length: np.ndarray) -> np.ndarray:
        return one + (ratio ** length.astype(float))[:, None, None] * two

    order = np.argsort(-n, kind="stable")
    for t in range(int(n.max(initial=0))):
        texts = order[: int((n > t).sum())]
        here = begin[texts] + t
        before = alpha[here - 1] if t else np.tile([1.0, 0.0], (len(texts), 1))
        now = (np.einsum("ni,nij->nj", before, run(gap[here])) @ move) * push[here]
        alpha[here] = now / now.sum(1, keepdims=True)
    for t in range(int(n.max(initial=0))):
        texts = order[: int((n > t).sum())]
        here = begin[texts + 1] - 1 - t
        if t:
            after = (push[here + 1] * beta[here + 1]) @ move.T
            after = np.einsum("nij,nj->ni", run(gap[here + 1]), after)
        else:
            after = run(n_words[texts] - place[here] - 1) @ np.ones(2)
        beta[here] = after / after.sum(1, keepdims=True)
    both = alpha * beta
    p = both[:, 1] / np.maximum(1e-300, both.sum(1))
    return owner, place, starts[at], ends[at], p, n_words


def _signals(owner: np.ndarray, p: np.ndarray, n: int) -> np.ndarray:
    """The log-odds of a text's largest marginal and the logarithm of their sum."""
    largest = np.zeros(n)
    np.maximum.at(largest, owner, p)
    largest = np.clip(largest, 1e-4, 1 - 1e-4)
    return np.column_stack([np.log(largest / (1 - largest)), np.log1p(np.bincount(owner, p, minlength=n))])


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression with a ridge, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    ridge = np.diag([1e-3, 1e-1, 1e-1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge
        w = w + np.linalg.solve(hessian, x.T @ (y - p) - ridge @ w)
    return float(w[0]), float(max(0.0, w[1])), float(max(0.0, w[2]))


def scores(signals: np.ndarray, field: Field) -> np.ndarray:
    a, b, c = field.curve
    return 1 / (1 + np.exp(-np.clip(a + b * signals[:, 0] + c * signals[:, 1], -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", settings: Settings = Settings()) -> Field:
    """Learn from the labelled documents, at most ``fit_docs`` of them; labels are looked up by ``doc_id``."""
    bounded_batches(docs.sparkSession)
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("toxic")).filter("id IS NOT NULL AND toxic IS NOT NULL")
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(settings.fit_docs)
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    # The sample's ids are at most fit_docs numbers, so every task can look them up.
    sample = cut(texts.join(F.broadcast(known), "id").select("text", "toxic"), "labelled")
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic_docs, all_docs = totals.get(1, 0), sum(totals.values())
    constant = Field(np.zeros(0, np.uint64), np.zeros(0), -5.0, np.zeros((2, 2)), (log((toxic_docs + 0.5) / (all_docs - toxic_docs + 0.5)), 0.0, 0.0))
    if toxic_docs in (0, all_docs):
        return constant

    def count(batches):
        for batch in batches:
            marks = np.array(batch.column(1).to_pylist(), np.int64) == 1
            for part in wb.slices(batch.column(0)):
                found, _, _, bounds = _features(part)
                owner = wb.owners(bounds)
                word = np.concatenate([[np.uint64(0)], found[:, 0], [np.uint64(0)]])
                near = wb.mix(word[:-2] + np.uint64(3) * word[2:]) >> np.uint64(33)
                for k in range(found.shape[1]):
                    own = found[:, k] != 0
                    h, text, beside = found[own, k], owner[own], near[own]
                    order = np.lexsort((text, h))
                    h, text, beside = h[order], text[order], beside[order]
                    fresh = np.append(True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])) if len(h) else np.zeros(0, bool)
                    toxic = marks[part.first + text[fresh]].astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h[fresh].view(np.int64)), pa.array(beside[fresh].astype(np.int32)), pa.array(toxic), pa.array(1 - toxic)],
                        names=["h", "beside", "toxic", "clean"],
                    )

    # Copies of a document say what it says: a document counts for a feature by the words beside its first
    # occurrence, and the same words beside it count once.
    places = sample.mapInArrow(count, "h long, beside int, toxic int, clean int").groupBy("h", "beside").agg(F.max("toxic").alias("toxic"), F.max("clean").alias("clean"))
    counts = places.groupBy("h").agg(F.sum("toxic").alias("n1"), F.sum("clean").alias("n0"))
    counts = cut(counts.filter(F.col("n1") + F.col("n0") >= settings.least_docs), "features")
    table = [(r["n1"], r["n0"], r["m"]) for r in counts.groupBy("n1", "n0").agg(F.count(F.lit(1)).alias("m")).collect()]
    chosen = {x for x in _accepted(table, toxic_docs / all_docs, settings.false_share) if x[0] >= max(settings.least_docs, settings.purity * sum(x))}
    if not chosen:
        return constant
    pairs = docs.sparkSession.createDataFrame(sorted(chosen), "n1 long, n0 long")
    features = np.sort(np.array([r["h"] for r in counts.join(F.broadcast(pairs), ["n1", "n0"]).select("h").collect()], np.int64).view(np.uint64))

    def sequences(batches):
        for batch in batches:
            marks = batch.column(1).to_pylist()
            rows = []
            for part in wb.slices(batch.column(0)):
                found, _, _, bounds = _features(part)
                ids = _known(features, found)
                for i in range(len(part)):
                    own = ids[bounds[i] : bounds[i + 1]]
                    for low, high in _windows(own.any(1), settings.window):
                        rows.append((marks[part.first + i], own[low:high].astype(np.int32).tobytes()))
            rows = [(m, b, xxhash.xxh64_intdigest(b) - (1 << 63)) for m, b in rows if b]
            columns = zip(*rows, strict=True) if rows else ([], [], [])
            kinds = (pa.int32(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["toxic", "ids", "place"])

    width = 1 + len(PREFIXES)
    alike = sample.mapInArrow(sequences, "toxic int, ids binary, place long").groupBy("place", "toxic", "ids").agg(F.count(F.lit(1)).alias("n"))
    first = alike.orderBy("place", "toxic", "ids").limit(settings.fit_windows).collect()
    cutout = [(r["toxic"], bytes(r["ids"])) for r in first]
    times = np.array([r["n"] for r in first], float)
    lengths = [len(b) // (4 * width) for _, b in cutout]
    ids = np.zeros((len(cutout), max(lengths), width), np.int64)
    valid = np.zeros(ids.shape[:2], bool)
    for k, (_, packed) in enumerate(cutout):
        ids[k, : lengths[k]] = np.frombuffer(packed, np.int32).reshape(-1, width)
        valid[k, : lengths[k]] = True
    toxic = (ids.any(2) & (np.array([t for t, _ in cutout]) == 1)[:, None]).astype(np.int64)
    weights, bias, transitions = _train(ids, valid, toxic, times, len(features), settings)
    field = Field(features, weights, bias, transitions, (0.0, 0.0, 0.0))

    def signalled(batches):
        for batch in batches:
            marks = batch.column(1).to_pylist()
            for part in wb.slices(batch.column(0)):
                owner, _, _, _, p, _ = marginals(part, field)
                x = _signals(owner, p, len(part))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(marks[part.first : part.first + len(part)], pa.int32()), pa.array(x[:, 0]), pa.array(x[:, 1])], names=["toxic", "a", "b"]
                )

    seen = sorted((r["toxic"], r["a"], r["b"]) for r in sample.mapInArrow(signalled, "toxic int, a double, b double").collect())
    curve = _curve(np.array([[a, b] for _, a, b in seen]), np.array([float(t == 1) for t, _, _ in seen]))
    return Field(features, weights, bias, transitions, curve)


def _windows(known: np.ndarray, reach: int, longest: int = 32) -> list[tuple[int, int]]:
    """Stretches around the words with known features, at most ``longest`` words each; one from the middle of a text without any."""
    if not len(known):
        return []
    at = np.flatnonzero(known)
    if not len(at):
        middle = len(known) // 2
        return [(max(0, middle - 2 * reach), min(len(known), middle + 2 * reach))]
    out: list[tuple[int, int]] = []
    for i in at.tolist():
        low, high = max(0, i - reach), min(len(known), i + reach + 1)
        if out and low <= out[-1][1] and high - out[-1][0] <= longest:
            out[-1] = (out[-1][0], high)
        elif out and low < out[-1][1]:
            out.append((out[-1][1], max(high, out[-1][1] + 1)))
        else:
            out.append((low, high))
    return out


def toxicity(docs: DataFrame, field: Field, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Score, verdict and toxic words (character offsets, end exclusive, and marginal) of each whole text."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, spans = [], []
        for part in wb.slices(batch.column(1)):
            owner, _, starts, ends, p, _ = marginals(part, field)
            found.append(scores(_signals(owner, p, len(part)), field))
            lead = np.concatenate([[0], np.cumsum(wb.LEAD[part.data])])
            mine: list[list[dict]] = [[] for _ in range(len(part))]
            for k in np.flatnonzero(p >= settings.span_limit).tolist():
                base = lead[part.offsets[owner[k]]]
                mine[owner[k]].append({"start": int(lead[starts[k]] - base), "end": int(lead[ends[k]] - base), "p": float(p[k])})
            spans += mine
        score = np.concatenate(found)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(spans, span)],
            names=["doc_id", "score", "predicted", "spans"],
        )

    return map_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), judge, SCHEMA)
