"""Hashed n-grams of whole columns of text."""

from __future__ import annotations

import numpy as np

from perfattr.llm import words

_CODES = np.arange(256)
#: 0 blank, 1 letter, digit or beyond ASCII, 2 any other sign
_KIND = np.where(words.NOT_SPACE, 2, 0).astype(np.int8)
_KIND[words.ALPHANUMERIC | ((_CODES >= 65) & (_CODES < 91))] = 1

_AGAIN = np.uint64(0x5851F42D4C957F2D)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes (A-Z lower-cased) of the runs of letters or of signs."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    kind = _KIND[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    inside = kind[cuts[:-1]] > 0
    starts, ends = cuts[:-1][inside], cuts[1:][inside]
    return starts, ends, words.hashes(words.lower(data), starts, ends)


def grams(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all tokens and pairs of tokens, and the row of each.

    A token equal to the one before it is counted as one common sign of repetition.
    """
    starts, _, found = tokens(data, offsets)
    row = np.searchsorted(offsets, starts, side="right") - 1
    same = np.zeros(len(found), bool)
    if len(found):
        same[1:] = (found[1:] == found[:-1]) & (row[1:] == row[:-1])
    found = np.where(same, _AGAIN, found)
    joined = row[1:] == row[:-1]
    pairs = words.mixed(found[:-1] * np.uint64(3) + found[1:])[joined]
    every = np.concatenate([words.mixed(found), pairs]) % np.uint64(buckets)
    return every.astype(np.int64), np.concatenate([row, row[1:][joined]])


def terms(data: np.ndarray, offsets: np.ndarray, buckets: int, prefixes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words and of their first bytes in several lengths, and the row of each."""
    data = words.lower(data)
    starts, ends = words.spans(data, offsets, words.ALPHANUMERIC)
    row = np.searchsorted(offsets, starts, side="right") - 1
    found, rows = [words.hashes(data, starts, ends)], [row]
    for size in prefixes:
        longer = ends - starts > size
        front = words.hashes(data, starts[longer], starts[longer] + size)
        found.append(words.mixed(front + np.uint64(size)))
        rows.append(row[longer])
    return (np.concatenate(found) % np.uint64(buckets)).astype(np.int64), np.concatenate(rows)
