"""Words of UTF-8 text and their 64-bit hashes, whole columns at a time."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SECTION = 1 << 17

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_CODES = np.arange(256)
#: Bytes of [^\x20\x09-\x0D]
NOT_SPACE = ~((_CODES == 32) | ((_CODES >= 9) & (_CODES <= 13)))
#: Bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F] once A-Z are in lower case
ALPHANUMERIC = ((_CODES >= 48) & (_CODES < 58)) | ((_CODES >= 97) & (_CODES < 123)) | (_CODES >= 128)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base: int) -> np.ndarray:
        out = np.full(n + 1, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return run(_BASE), run(_INVERSE)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; all other bytes as they are."""
    return _LOWER[data]


def spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes of a kind; a run ends with its row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = kind[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span. Spans are sorted and do not overlap, but may share starts.

    A span's polynomial is a difference of running sums, brought to position 0 by the
    inverse of the base, so equal spans agree wherever they stand.
    """
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, low + _SECTION, side="right")))
        high = int(ends[at:to].max())
        size = high - low
        power, inverse = _powers(max(_SECTION, 1 << (size - 1).bit_length()))
        sums = np.empty(size + 1, np.uint64)
        sums[0] = 0
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * power[:size], out=sums[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        at = to
    return mixed(out)


def rows_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First span of each row, n + 1 numbers."""
    return np.searchsorted(starts, offsets, side="left")


def shingles(words: np.ndarray, first: int, after: int, n: int) -> np.ndarray:
    """Hashes of the n-word sequences of words[first:after]; fewer words make one sequence."""
    count = int(after - first)
    if count == 0:
        return np.zeros(0, np.uint64)
    size = min(n, count)
    total = np.full(count - size + 1, size, np.uint64)
    for k in range(size):
        total = mixed(total + words[first + k : after - size + 1 + k]) * np.uint64(_BASE)
    return mixed(total)
