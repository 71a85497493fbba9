"""Words, lines and n-grams of an Arrow text column, found on the UTF-8 bytes with numpy.

Used inside ``mapInArrow`` functions. A batch is worked on in slices of a few MB (a longer text is a
slice of its own), so that the memory of a task follows the slice or the longest text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once.
SLICE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _table(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


#: Bytes of words: anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = ~_table(b" \t\n\x0b\x0c\r")
#: Bytes of bare words: ASCII letters and digits, and all bytes of other characters.
BARE = _table(bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]))
#: Bytes of letters, as far as bytes tell.
LETTER = _table(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
#: All but the line feed.
LINE = ~_table(b"\n")
#: First bytes of characters.
LEAD = ~_table(bytes(range(128, 192)))
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Texts:
    """Texts ``first`` to ``first + len`` of a batch: their bytes, one after another, and where each begins."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def slices(column: pa.Array, limit: int = SLICE_BYTES, most: int = 4096) -> Iterator[Texts]:
    """The column's texts in slices of about ``limit`` bytes and at most ``most`` texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if n == 0:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = min(at + most, max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1))
        yield Texts(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def spans(texts: Texts, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of ``inside`` bytes within a text; and each text's first run."""
    mask = inside[texts.data]
    begins, stops = mask.copy(), mask.copy()
    begins[1:] &= ~mask[:-1]
    stops[:-1] &= ~mask[1:]
    first = texts.offsets[:-1]
    first = first[first < len(mask)]
    begins[first] = mask[first]
    last = texts.offsets[1:] - 1
    last = last[last >= 0]
    stops[last] = mask[last]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, texts.offsets)


def lines(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the parts between line feeds, empty ones included; and each text's first part."""
    cuts = np.flatnonzero(texts.data == 10)
    starts = np.concatenate([texts.offsets[:-1], cuts + 1])
    owner = np.concatenate([np.arange(len(texts)), np.searchsorted(texts.offsets, cuts, "right") - 1])
    ends = np.concatenate([cuts, texts.offsets[1:]])
    ends_owner = np.concatenate([owner[len(texts) :], np.arange(len(texts))])
    starts = starts[np.lexsort((starts, owner))]
    ends = ends[np.lexsort((ends, ends_owner))]
    return starts, ends, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))])


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit values."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Rolling:
    """Hashes of any spans of some bytes: 64 bits, the same wherever the span lies."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = _grow(len(data) + 1)
        self.totals = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=self.totals[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.totals[ends] - self.totals[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span."""
    return Rolling(data)(starts, ends)


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes of the text in lower case, ASCII and Latin-1 letters only, so that every byte keeps its place."""
    out = LOWER[data]
    if len(data) > 1:
        upper = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][upper] += 32
    return out


def owners(bounds: np.ndarray) -> np.ndarray:
    """For each run, the text it lies in."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def whole(bounds: np.ndarray, width: int) -> np.ndarray:
    """Positions of runs from which ``width`` runs of one text follow, itself included."""
    n = bounds[-1]
    if n == 0:
        return np.zeros(0, np.int64)
    at = np.arange(n)
    return at[at + width <= np.repeat(bounds[1:], np.diff(bounds))]


def chain(word_hashes: np.ndarray, at: np.ndarray, places: tuple[int, ...]) -> np.ndarray:
    """A hash of the words at ``at + place`` for each place, in order."""
    out = np.zeros(len(at), np.uint64)
    for place in places:
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + word_hashes[at + place])
    return out


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the values of each text's runs."""
    totals = np.concatenate([[0], np.cumsum(values)])
    return totals[bounds[1:]] - totals[bounds[:-1]]
