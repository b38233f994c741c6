"""Vectorised words, hashes and shingles over the UTF-8 bytes of whole Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one vectorised step holds; a longer text makes a step of its own.
STEP_BYTES = 1 << 18

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.Generator(np.random.PCG64(20240601)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PARTS = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9FB21C651E98DF25)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit numbers."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def steps(batch: pa.RecordBatch, text: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of text each."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
    group = np.cumsum(sizes) // most if len(sizes) else sizes
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row begins and the last one ends; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def spans(buf: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and row of each maximal run of bytes that `inside` marks; runs end where rows end."""
    if not len(buf):
        return (np.zeros(0, np.int64),) * 3
    before, after = np.zeros(len(buf), bool), np.zeros(len(buf), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[off[:-1][off[:-1] < len(buf)]] = False
    after[off[1:][off[1:] > 0] - 1] = False
    begin, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return begin, end, np.searchsorted(off, begin, "right") - 1


class Hasher:
    """64-bit hashes of any byte ranges of one buffer, in constant time each."""

    def __init__(self, buf: np.ndarray) -> None:
        up, self._down = _powers(1 << max(18, int(len(buf)).bit_length()))
        self._sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_TABLE[buf] * up[: len(buf)], out=self._sums[1:])

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[begin]) * self._down[begin] + (end - begin).astype(np.uint64))


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its `words`-word shingles.

    Words are runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased. A row with fewer
    words has its whole sequence as its single shingle; one without words has none.
    """
    buf, off = flat(column)
    buf = LOWER[buf]
    begin, end, row = spans(buf, off, ~SPACE[buf])
    word = Hasher(buf)(begin, end)
    counts = np.bincount(row, minlength=len(column))
    first = np.concatenate([[0], np.cumsum(counts)])
    n = max(0, len(word) - words + 1)
    whole = np.zeros(n, np.uint64)
    for k in range(words):
        whole += word[k : k + n] * np.uint64(_PARTS[k % len(_PARTS)] + 2 * k)
    whole = mix(whole)
    for i, c in enumerate(counts):
        a = first[i]
        if c >= words:
            yield np.unique(whole[a : a + c - words + 1])
        elif c:
            few = np.array([c], np.uint64)
            for k in range(c):
                few = mix(few + word[a + k])
            yield few
        else:
            yield np.zeros(0, np.uint64)


def word_counts(column: pa.Array) -> np.ndarray:
    """How many runs of bytes other than white space (space, 0x09-0x0D) each row has."""
    buf, off = flat(column)
    return np.bincount(spans(buf, off, ~SPACE[buf])[2], minlength=len(column)).astype(np.int64)
