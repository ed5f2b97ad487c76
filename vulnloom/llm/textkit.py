"""Whole-batch text work for Arrow operators: words and hashes of many texts at once, as numpy arrays.

Nothing here loops over characters or words in Python.  All hashes are 64 bits and depend on the bytes alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Text bytes that are worked on at a time (a longer text is a block of its own).
BLOCK = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser: every input bit changes about half of the output bits."""
    h = h.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    return h ^ (h >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_POWERS = np.cumprod(np.full(64, _STEP, np.uint64))


def powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = np.cumprod(np.full(2 * n, _STEP, np.uint64))
    return _POWERS[:n]


@dataclass
class Block:
    """Some rows of a string column: ``data`` has their bytes, row i has data[offsets[i]:offsets[i + 1]]."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> str:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes().decode("utf-8", "replace")


def blocks(column: pa.Array, size: int = BLOCK, rows: int = 1 << 30) -> Iterator[Block]:
    """The column (nulls as empty texts) in runs of at most ``rows`` rows of about ``size`` bytes."""
    column = column.cast(pa.large_string()).fill_null("") if not pa.types.is_large_string(column.type) or column.null_count else column
    if not len(column):
        return
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(at, at[row] + size, "right")) - 1)
        stop = min(stop, row + rows, len(column))
        yield Block(row, data[at[row] : at[stop]], at[row : stop + 1] - at[row])
        row = stop


@dataclass
class Words:
    """Words of a block: byte ``starts`` and ``ends``; row i has words ``bounds[i]`` to ``bounds[i + 1]``."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def words_of(block: Block, space: np.ndarray = _SPACE) -> Words:
    """Runs of bytes that ``space`` does not mark, never across rows."""
    solid = ~space[block.data]
    n = len(solid)
    edge = np.zeros(n + 1, bool)
    edge[block.offsets] = True
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:], after[:-1] = ~solid[:-1], ~solid[1:]
    starts = np.flatnonzero(solid & (before | edge[:-1]))
    ends = np.flatnonzero(solid & (after | edge[1:])) + 1
    return Words(starts, ends, np.searchsorted(starts, block.offsets))


def word_hashes(block: Block, words: Words, fold: np.ndarray = _LOWER) -> np.ndarray:
    """One hash per word, of its bytes after ``fold`` (by default A-Z in lower case)."""
    sizes = words.ends - words.starts
    if not len(sizes):
        return np.zeros(0, np.uint64)
    firsts = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(firsts, sizes)
    data = fold[block.data[place + np.repeat(words.starts, sizes)]]
    values = _BYTE[data] * powers(int(sizes.max()))[place]
    return mix(np.add.reduceat(values, firsts) + sizes.astype(np.uint64))


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of items i to i + n - 1 for each i at which that many remain."""
    count = max(0, len(hashes) - n + 1)
    out = np.zeros(count, np.uint64)
    for k, factor in enumerate(powers(n)):
        out += hashes[k : k + count] * factor
    return mix(out)


def shingle_sets(block: Block, n: int = 5) -> Iterator[np.ndarray]:
    """Per row the sorted distinct hashes of its n-word shingles; with fewer words, that of the whole sequence."""
    words = words_of(block)
    hashes = word_hashes(block, words)
    shingles = window_hashes(hashes, n)
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(shingles[a : b - n + 1])
        elif b > a:
            yield window_hashes(hashes[a:b], b - a) ^ np.uint64(b - a)
        else:
            yield np.zeros(0, np.uint64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x
