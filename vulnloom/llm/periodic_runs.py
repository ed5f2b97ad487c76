"""Periodic runs of words, by Lyndon arrays over an ordered alphabet.

Words become letters by sorting alone (equal words, equal letters; no hash of a word decides anything).  One pass from left
to right keeps the stack of previous smaller suffixes; each pair of suffixes that it compares is an edge of the Lyndon
array, and the length matched by an edge is kept with it.  A later edge inside a stretch that was matched before takes its
length from the edge it repeats, an edge whose neighbours differ in length takes the shorter, and only what lies beyond is
read word by word.  Every run has a root that is the longest Lyndon word at its place in one of two orders, the alphabet's
and the reverse, so a pass in each finds all runs; a root that repeats the one before it is passed over at once, and the
first of a run is extended to the left by less than its period.  No suffix array, suffix tree or fingerprint is built.

The reverse order also takes a text's end as its least letter; a run that reaches the end is then seen in both and taken
from the first.

A word that occurs fewer times than a run must repeat lies in no run, and no run is extended by it: with ``cut`` (default)
texts are cut there first, which changes no run.  Occurrences are counted by sorting.

Plan: one Arrow pass, no shuffle; a task holds one batch and works on blocks of half a megabyte (a longer text is a block
of its own, at about 60 bytes a word).

Defined cases: a null, empty or blank text has no words and no runs, and collapses to the empty text; repeated rows are
worked on each by itself; other columns pass through, but columns called ``runs`` or ``collapsed`` are replaced; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vulnloom.llm import textkit

Run = tuple[int, int, int]

#: A run has at least so many periods, and so many words.
LEAST_EXPONENT = 4
LEAST_LENGTH = 6

RUNS = T.ArrayType(T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")]))
_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


# --- letters ------------------------------------------------------------------------------------------------------


def _ranks(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks of rows of keys, by sorting."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    out = np.empty(len(order), np.uint64)
    out[order] = np.cumsum(new)
    return out


def _packed(block: textkit.Block, starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """The first n bytes from each start, most significant first; nothing past the end."""
    out = np.zeros(len(starts), np.uint64)
    for k in range(n):
        has = np.flatnonzero(starts + k < ends)
        out[has] |= block.data[starts[has] + k].astype(np.uint64) << np.uint64(8 * (7 - k))
    return out


def letters(block: textkit.Block, words: textkit.Words) -> np.ndarray:
    """A letter per word: of one block, equal words have equal letters and different words different ones."""
    sizes = words.ends - words.starts
    out = _packed(block, words.starts, words.ends, 7) | np.minimum(sizes, 255).astype(np.uint64)
    mid = np.flatnonzero((sizes > 7) & (sizes < 16))
    if len(mid):
        a, e = words.starts[mid], words.ends[mid]
        out[mid] = (np.uint64(0xFE) << np.uint64(56)) + _ranks(sizes[mid], _packed(block, a, e, 8), _packed(block, a + 8, e, 8))
    long = np.flatnonzero(sizes >= 16)
    if len(long):
        spelled = [block.data[s:e].tobytes() for s, e in zip(words.starts[long].tolist(), words.ends[long].tolist(), strict=True)]
        rank, before = 0, None
        for i in sorted(range(len(spelled)), key=spelled.__getitem__):
            rank += spelled[i] != before
            before = spelled[i]
            out[long[i]] = np.uint64((0xFF << 56) + rank)
    return out


def stretches(letter: np.ndarray, rows: np.ndarray, times: int) -> list[tuple[int, int]]:
    """Longest stretches (from, to) of words that occur at least ``times`` times in their row."""
    order = np.lexsort((letter, rows))
    edge = np.flatnonzero(np.concatenate([[True], (letter[order][1:] != letter[order][:-1]) | (rows[order][1:] != rows[order][:-1]), [True]]))
    count = np.empty(len(letter), np.int64)
    count[order] = np.repeat(np.diff(edge), np.diff(edge))
    often = np.flatnonzero(count >= times)
    if not len(often):
        return []
    new = np.flatnonzero((np.diff(often) > 1) | (np.diff(rows[often]) > 0))
    begins, ends = often[np.concatenate([[0], new + 1])], often[np.concatenate([new, [-1]])] + 1
    return list(zip(begins.tolist(), ends.tolist(), strict=True))


# --- Lyndon array -------------------------------------------------------------------------------------------------


def lyndon_edges(w: list, tally: list | None = None) -> tuple[list[int], list[int]]:
    """Next smaller suffix of each position (len(w): none) and the length it shares with that suffix.

    ``tally[0]``, if given, grows by the number of letters read beyond known lengths.
    """
    n = len(w)
    following, shared = [n] * n, [0] * n
    before, shared_before = [-1] * n, [0] * n
    reach, base, shift = 0, 0, 0  # the stretch base to reach is known to repeat what is shift before it
    read = 0

    def known(j: int, i: int) -> int:
        """What suffixes j and i share at least, told by the edge that they repeat."""
        if j < base:
            return 0
        if following[j - shift] == i - shift:
            told = shared[j - shift]
        elif before[i - shift] == j - shift:
            told = shared_before[i - shift]
        else:
            return 0
        return told if told < reach - i else reach - i

    for i in range(1, n):
        j = i - 1
        size = known(j, i) if i < reach else 0
        x = w[i]
        while True:
            at = i + size
            while at < n and w[j + size] == w[at]:
                size += 1
                at += 1
                read += 1
            if at > reach:
                reach, base, shift = at, i, i - j
            if at < n and w[j + size] < w[at]:
                before[i], shared_before[i] = j, size
                break
            following[j], shared[j] = i, size
            previous, least = before[j], shared_before[j]
            while previous >= 0 and size < least:  # it starts like j for longer than j was like i: it is larger, too
                j = previous
                following[j], shared[j] = i, size
                previous, least = before[j], shared_before[j]
            if previous < 0:
                break
            if size > least:
                before[i], shared_before[i] = previous, least
                break
            j = previous
            if i < reach:
                told = known(j, i)
                size = told if told > size else size
            elif not size and w[j] != x:
                if w[j] < x:
                    before[i] = j
                    break
    if tally is not None:
        tally[0] += read
    return following, shared


def runs_of(letter: np.ndarray, exponent: int = LEAST_EXPONENT, least: int = LEAST_LENGTH) -> list[Run]:
    """All (start, length, period) with length >= max(least, exponent * period), by start, then period; exponent >= 3."""
    n, found = len(letter), []
    if n < max(least, exponent):
        return found
    for backwards in (False, True):
        w = (~letter if backwards else letter).tolist()
        following, shared = lyndon_edges(w)
        ends, sizes = np.array(following), np.array(shared)
        period = ends - np.arange(n)
        # A run's first root begins less than a period after the run.
        for i in np.flatnonzero((ends < n) & (sizes > np.maximum(least, exponent * period) - 2 * period)).tolist():
            end = following[i]
            q = end - i
            if i >= q and following[i - q] == i and shared[i - q] >= q:
                continue
            stop = end + shared[i]
            if backwards and stop == n:
                continue
            start = i
            while start and w[start - 1] == w[start + q - 1]:
                start -= 1
            if stop - start >= max(least, exponent * q):
                found.append((start, stop - start, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def block_runs(block: textkit.Block, words: textkit.Words, exponent: int = LEAST_EXPONENT, least: int = LEAST_LENGTH, cut: bool = True) -> dict[int, list[Run]]:
    """Runs of each row that has any, in words of the row."""
    found: dict[int, list[Run]] = {}
    if not len(words.starts):
        return found
    letter, rows = letters(block, words), words.rows()
    parts = stretches(letter, rows, exponent) if cut else list(zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True))
    for a, b in parts:
        if b - a >= max(least, exponent):
            row = int(rows[a])
            shift = a - int(words.bounds[row])
            if own := runs_of(letter[a:b], exponent, least):
                found.setdefault(row, []).extend((s + shift, length, q) for s, length, q in own)
    return found


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Which of n words stay if each run keeps its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def scan(docs: DataFrame, exponent: int = LEAST_EXPONENT, least: int = LEAST_LENGTH, cut: bool = True) -> DataFrame:
    """``docs`` with ``runs`` of ``text`` (start, length, period; by start, then period) and ``collapsed``: the words of the
    text, one space between them, without those that a run repeats after its first period."""
    docs = docs.drop("runs", "collapsed")
    spot = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in textkit.blocks(batch.column(spot)):
                words = textkit.words_of(block)
                found = block_runs(block, words, exponent, least, cut)
                collapsed = []
                for i in range(len(block)):
                    spelled = block.data[block.offsets[i] : block.offsets[i + 1]].tobytes().split()
                    if i in found:
                        spelled = [spelled[k] for k in np.flatnonzero(kept_words(len(spelled), found[i])).tolist()]
                    collapsed.append(b" ".join(spelled))
                shown = [[{"start": s, "length": m, "period": q} for s, m, q in found.get(i, ())] for i in range(len(block))]
                own = batch.slice(block.first, len(block))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(shown, _ARROW), pa.array(collapsed, pa.binary()).cast(pa.string())], names=[*own.schema.names, "runs", "collapsed"])

    return docs.mapInArrow(work, T.StructType([*docs.schema.fields, T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())]))
