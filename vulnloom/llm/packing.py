"""Packing documents into sequences of a fixed width, by best-fit decreasing.

A document's tokens end in a separator.  Documents longer than a window are first cut into full windows, which are
sequences of their own; what is left of each is packed: longest first, each into the open window whose remaining capacity is
the tightest that holds it.  A segment tree indexed by remaining capacity (0 to the width) finds that window in as many
steps as the tree is deep, whatever the number of open windows.

Tokens are those of the whole text.  A byte-level tokenizer of this kind begins a token wherever the kind of character
changes (letters, digits, other signs, white space; a space belongs to what follows it), so a text is taken apart at such
places, between ASCII characters only, and equal parts are encoded once and looked up afterwards (the table of parts is
emptied when it is full: it bounds memory, not what is encoded).

Plan: one Arrow pass over the table's own partitions, no shuffle and no gathering, so no key can be hot.  A task holds the
rests of at most ``hold`` tokens, packs them and goes on; it leaves a few windows partly filled each time.  A window's
number is the partition's number and a counter: a task that runs again on another executor numbers the same.

Defined cases: a null or empty text is its separator alone; a null or repeated id is packed like any other, row by row; a
text is encoded whole, however long; columns beside doc_id and text do not pass; an empty table gives no sequence.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vulnloom.llm import textkit

#: Bytes of texts that are worked on at a time (a longer text is one block), and parts that are looked up at a time.
SEGMENT = 1 << 23
PARTS = 1 << 20

#: Kinds of bytes: ASCII letters, digits, other visible characters but the apostrophe (which may open a token of letters),
#: the apostrophe, the space, other white space, the rest.
LETTER, DIGIT, OTHER, QUOTE, SPACE, WHITE, REST = range(7)
_KIND = np.full(256, REST, np.int8)
_KIND[0x21:0x7F] = OTHER
_KIND[0x30:0x3A] = DIGIT
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
#: Bytes of letters: ASCII, and the two-byte letters from U+00C0 to U+00FF (all but the signs U+00D7 and U+00F7).
_LETTERS = bytes([*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3, *range(0x80, 0xC0)])
_ACCENT = np.zeros(256, bool)
_ACCENT[0x80:0xC0] = True
_ACCENT[[0x97, 0xB7]] = False
_KIND[0x27], _KIND[0x20], _KIND[9:14] = QUOTE, SPACE, WHITE


@dataclass(frozen=True)
class PackOptions:
    width: int = 1024
    #: The id that ends each document.
    separator: int = 0
    #: Tokens of rests that a task holds until it packs them.
    hold: int = 1 << 23
    #: Distinct parts, and their tokens, that a worker remembers.
    parts: int = 1 << 20
    part_tokens: int = 1 << 23


class Windows:
    """Open windows, found by the capacity that remains in them."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.leaves = 1 << width.bit_length()
        self.some = [0] * (2 * self.leaves)  # open windows below each node
        self.open: list[list[int]] = [[] for _ in range(width + 1)]
        self.count = 0

    def tightest(self, size: int) -> int:
        """The least remaining capacity of at least ``size`` that an open window has, or -1."""
        some, node = self.some, size + self.leaves
        if some[node]:
            return size
        while node > 1:
            if not node & 1 and some[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node + (not some[2 * node])
                return node - self.leaves
            node >>= 1
        return -1

    def _change(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.some[node] += by
            node >>= 1

    def put(self, size: int) -> tuple[int, int]:
        """(window, offset in it) for a piece of 1 to ``width`` tokens."""
        capacity = self.tightest(size)
        if capacity < 0:
            capacity, window = self.width, self.count
            self.count += 1
        else:
            window = self.open[capacity].pop()
            self._change(capacity, -1)
        if capacity > size:
            self.open[capacity - size].append(window)
            self._change(capacity - size, 1)
        return window, self.width - capacity


def best_fit_decreasing(sizes: list[int], width: int) -> tuple[list[tuple[int, int]], int]:
    """(window, offset) for each size, and how many windows there are.  Equal sizes go in the order given."""
    windows, out = Windows(width), [(0, 0)] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        out[k] = windows.put(sizes[k])
    return out, windows.count


class Encoder:
    """Token ids of texts by a tokenizer file of the ``tokenizers`` library, each distinct part encoded once."""

    def __init__(self, path: str, options: PackOptions = PackOptions()) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.options = Tokenizer.from_file(path), options
        before = json.loads(self.tokenizer.to_str())["pre_tokenizer"] or {}
        if before.get("type") != "ByteLevel" or not before.get("use_regex") or before.get("add_prefix_space"):
            raise ValueError(f"{path}: parts are told for byte-level tokenizers without a prefix space only")
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.line_end = self.spaced.copy()
        self.spaced[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True  # how such a vocabulary writes a space
        self.line_end[vocabulary["\u010a"]] = True  # and a line end
        self._empty()

    def _empty(self) -> None:
        self.codes: dict[bytes, int] = {}
        self.starts, self.sizes, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self, new: list[bytes]) -> None:
        """Encodes new parts.  Those with a space at their front only are one text, told apart by the tokens that begin with
        it; those of letters alone another, told apart by line ends between them."""
        spaced = [k for k, x in enumerate(new) if x[:1] == b" " and x.count(b" ") == 1 and not any(t in x for t in self.special)]
        letters = [k for k, x in enumerate(new) if not x.translate(None, _LETTERS)]
        encode = lambda texts: [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        text = lambda x: x.decode("utf-8", "replace")
        pool, at, starts, sizes = [], 0, np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        for which, between, marks in ((spaced, b"", self.spaced), (letters, b"\n", self.line_end)):
            ids = encode([text(between.join([b"", *(new[k] for k in which)]))])[0]
            first = np.flatnonzero(marks[ids])
            begins = first + len(between)
            starts[which], sizes[which] = at + begins, np.append(first, len(ids))[1:] - begins
            pool.append(ids)
            at += len(ids)
        others = sorted(set(range(len(new))).difference(spaced, letters))
        for k, own in zip(others, encode([text(new[k]) for k in others]), strict=True):
            starts[k], sizes[k] = at, len(own)
            pool.append(own)
            at += len(own)
        self.starts, self.sizes = np.concatenate([self.starts, len(self.pool) + starts]), np.concatenate([self.sizes, sizes])
        self.pool = np.concatenate([self.pool, *pool])

    def _ids(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each part)."""
        coded = parts.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = [x for x in distinct if x not in self.codes]
        if new:
            self.codes.update(zip(new, range(len(self.codes), len(self.codes) + len(new)), strict=True))
            self._learn(new)
        code = np.fromiter(map(self.codes.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        size = self.sizes[code]
        ends = np.cumsum(size)
        ids = self.pool[np.arange(int(ends[-1])) + np.repeat(self.starts[code] - (ends - size), size)]
        if len(self.codes) > self.options.parts or len(self.pool) > self.options.part_tokens:
            self._empty()
        return ids, size

    def _block(self, block: textkit.Block) -> Iterator[np.ndarray]:
        data, n = block.data, len(block.data)
        edge = np.zeros(n + 1, bool)
        edge[block.offsets] = True
        if n > 1:
            kind = _KIND[data]
            accented = np.flatnonzero((data[:-1] == 0xC3) & _ACCENT[data[1:]])
            kind[accented] = kind[accented + 1] = LETTER
            a, b = kind[:-1], kind[1:]
            solid = (a != b) & (a <= OTHER) & (b <= OTHER) | (a <= QUOTE) & (b >= SPACE) | (a == WHITE) & (b <= QUOTE)
            # Of white space before a visible character, the last is apart: a space belongs to that character.
            solid[:-1] |= (a[:-1] >= SPACE) & (b[:-1] >= SPACE) & (b[1:] <= QUOTE) & ~edge[2:n]
            edge[1:n] = solid & (b < REST) & (a < REST)
        raw = data.tobytes()
        for token in self.special:  # these are taken out first, with nothing of what stands before them
            at = raw.find(token)
            while at >= 0:
                edge[at + 1 : at + len(token)] = False
                if raw[max(at - 1, 0) : at].isspace():
                    edge[at - 1] = False
                at = raw.find(token, at + 1)
        edge[block.offsets] = True
        starts = np.flatnonzero(edge[:n])
        bounds = np.append(starts, n)
        whole = pa.py_buffer(raw)
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for k in range(0, len(starts), PARTS):
            count = min(PARTS, len(starts) - k)
            got = self._ids(pa.LargeBinaryArray.from_buffers(pa.large_binary(), count, [None, pa.py_buffer(bounds[k : k + count + 1]), whole]))
            ids.append(got[0])
            sizes.append(got[1])
        every, upto = np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        at = upto[np.searchsorted(starts, block.offsets)]
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield every[a:b]

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text of a string column, in order (null: none), without separators."""
        for block in textkit.blocks(column, SEGMENT):
            yield from self._block(block)


_ENCODERS: dict[tuple[str, PackOptions], Encoder] = {}


def encoder_of(path: str, options: PackOptions) -> Encoder:
    """One encoder a worker: what a task learned serves the next."""
    if (path, options) not in _ENCODERS:
        _ENCODERS[path, options] = Encoder(path, options)
    return _ENCODERS[path, options]


def pack(docs: DataFrame, tokenizer: str, options: PackOptions = PackOptions()) -> DataFrame:
    """A row per piece: doc_id, ``start`` (the document's ids before it), ``length``, ``ids`` (little-endian unsigned
    32-bit), ``doc_tokens`` (with the separator), ``sequence_id`` and ``offset`` in it.  A sequence's pieces leave no gap."""
    docs = docs.select("doc_id", "text")
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, width = encoder_of(tokenizer, options), options.width
        number = TaskContext.get().partitionId() << 40
        rests, held = [], 0
        kind = None

        def rows(pieces: list[tuple]) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(pieces), 4096):
                ids, *others = zip(*pieces[k : k + 4096], strict=True)
                columns = dict(zip(["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset"], others, strict=True)) | {"ids": ids}
                types = {"doc_id": kind, "ids": pa.binary()}
                yield pa.RecordBatch.from_arrays([pa.array(columns[n], types.get(n, pa.int64())) for n in names], names=names)

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal rests, held, number
            places, count = best_fit_decreasing([len(r[0]) // 4 for r in rests], width)
            yield from rows([(ids, i, start, len(ids) // 4, total, number + w, at) for (ids, i, start, total), (w, at) in zip(rests, places, strict=True)])
            number += count
            rests, held = [], 0

        for batch in batches:
            kind = batch.column(0).type
            full, waiting = [], 0
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1)), strict=True):
                data = np.append(ids, np.uint32(options.separator)).astype("<u4").tobytes()
                total = len(data) // 4
                for start in range(0, total - total % width, width):
                    full.append((data[4 * start : 4 * (start + width)], doc_id, start, width, total, number, 0))
                    number += 1
                if total % width:
                    rests.append((data[4 * (total - total % width) :], doc_id, total - total % width, total))
                    held += total % width
                waiting += total
                if waiting >= options.hold:
                    yield from rows(full)
                    full, waiting = [], 0
                if held >= options.hold:
                    yield from packed()
            yield from rows(full)
        if rests:
            yield from packed()

    return docs.mapInArrow(work, T.StructType([docs.schema["doc_id"], *[T.StructField(n, T.BinaryType() if n == "ids" else T.LongType()) for n in names[1:]]]))


def padding(pieces: DataFrame, options: PackOptions = PackOptions()) -> DataFrame:
    """(sequences, tokens, padded): padding fills sequences to the width, but for those whose length is a power of two."""
    filled = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    whole = F.col("n").bitwiseAND(F.col("n") - 1) == 0
    return filled.agg(F.count("*").alias("sequences"), F.sum("n").alias("tokens"), F.sum(F.when(whole, 0).otherwise(options.width - F.col("n"))).alias("padded"))
