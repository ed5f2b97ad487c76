"""Personal data: fixed patterns, and a skip-chain conditional random field over a document's telling tokens.

Nodes are the tokens of a document that hold a digit or an @; labels are none, email, ip, card and phone.  Neighbouring
tokens share a transition potential; equal tokens anywhere in the document (by their digits, or their letters) share a
skip potential: each occurrence is linked to the one before and to the first, so any two are two links apart and links grow
with the tokens.  Loopy sum-product message passing, run until messages no longer change, spreads labels over both; tokens that the fixed patterns label are observed.  Tokens, links and messages are
held as plain numbers: a text of nothing but numbers takes some 120 bytes for each of its own at the peak.  A document's graph is part of one union
graph per block of texts, so the passing is a few array operations whatever the number and size of the documents.

Training is piecewise and covers all documents: tasks count features, transitions and agreements of skip links under
the labels that the fixed patterns give, and a group-by adds at most a few thousand numbers up.  Applying is one narrow pass.

The fixed patterns are matched in time linear in the text: an address grows from its @, an ip from the start of its digits.

Defined cases: a null or empty text has no spans; rows that repeat an id are scanned each; a null id is kept; if nothing is
labelled in training nothing is added to the patterns' spans; an empty table gives an empty result; other columns pass
through, but ``scan`` replaces those named base or spans.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vulnloom.llm import textkit

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1

#: The base patterns.  Each is equal to its plain form, but does not begin inside a run it cannot match.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

WORD = re.compile(r"[^ \t\n\x0b\x0c\r]+")
TELLING = re.compile(r"[0-9@]")
BUCKETS = 2048
#: Links whose messages are worked on at a time.
CHUNK = 1 << 16
Span = tuple[int, int, int]


@dataclass(frozen=True)
class Model:
    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    trained: bool


@dataclass(frozen=True)
class PiiOptions:
    """``rounds``: a stop for graphs whose messages keep turning; ``still``: the change below which they have settled."""

    rounds: int = 100
    still: float = 1e-3
    damping: float = 0.3
    belief: float = 0.9


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the fixed patterns, by kind, then start."""
    spans: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            done = domain.end()
            spans.append((0, start, done))
        at = text.find("@", at + 1)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            spans.append((1, *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                spans.append((2, *m.span()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
            spans.append((3, *m.span()))
    return spans


class Rows:
    """Rows of ``width`` small integers, appended one by one and held as plain numbers."""

    def __init__(self, width: int, code: str) -> None:
        self.width, self.flat = width, array(code)

    def append(self, row: Sequence[int]) -> None:
        self.flat.extend(row)

    def __len__(self) -> int:
        return len(self.flat) // self.width

    def __array__(self, dtype: object = None, copy: bool | None = None) -> np.ndarray:
        return np.array(self.flat, dtype or self.flat.typecode).reshape(-1, self.width)


@dataclass
class Graph:
    """Tokens of several documents: document, start, end, label (0 none, -1 unknown), feature buckets; links."""

    doc: list[int]
    start: Sequence[int]
    end: Sequence[int]
    label: list[int]
    features: list[list[int]] | Rows
    chain: list[tuple[int, int]] | Rows
    skip: list[tuple[int, int]] | Rows

    @classmethod
    def empty(cls) -> Graph:
        return cls([], array("q"), array("q"), [], Rows(3, "h"), Rows(2, "i"), Rows(2, "i"))


def _pairs(links: list[tuple[int, int]] | Rows) -> np.ndarray:
    return np.array(links, np.int32).reshape(-1, 2)


def _shape(token: str) -> str:
    """Runs of digits by their length to 20, runs of letters as one letter, the rest as it is."""
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", lambda m: f"<{min(len(m.group()), 20)}>", token))


def _bucket(name: str, value: str) -> int:
    data = np.frombuffer(f"{name}={value}".encode("utf-8", "replace"), np.uint8)
    return int(textkit.mix(np.array([int.from_bytes(data[-8:].tobytes(), "little") + 1000003 * sum((k + 1) * int(b) for k, b in enumerate(data))], np.uint64))[0] % BUCKETS)


_SEEN: dict[tuple[str, str], int] = {}


def bucket(name: str, value: str) -> int:
    if len(value) > 100:
        return _bucket(name, value)
    if (found := _SEEN.get((name, value))) is None:
        if len(_SEEN) > 50_000:
            _SEEN.clear()
        found = _SEEN[name, value] = _bucket(name, value)
    return found


def add_document(graph: Graph, row: int, text: str, spans: list[Span]) -> None:
    """The document's tokens and links; ``spans`` label the tokens they touch."""
    ordered = sorted((s, e, k) for k, s, e in spans)
    covered, at, reach = [], 0, 0
    met: dict[str, int] = {}  # the last token of each key so far, of this document's tokens
    firsts = array("i")  # and of each token the first of its key
    begun = len(graph.doc)
    before, word = -1, -2
    for number, m in enumerate(WORD.finditer(text)):
        if not TELLING.search(m.group()):
            continue
        token = m.group().lstrip("\"'<[{,;:").rstrip(".,;:!?\"'>]}#*$%&|")
        if not token:
            continue
        start = m.start() + m.group().index(token)
        end = start + len(token)
        while at < len(ordered) and ordered[at][1] <= start:
            at += 1
        label, k = 0, at
        while k < len(ordered) and ordered[k][0] < end:
            if ordered[k][1] > start:
                label = ordered[k][2] + 1
                break
            k += 1
        node = len(graph.doc)
        digits = "".join(c for c in token if c in "0123456789")
        shape = _shape(token)
        graph.doc.append(row)
        graph.start.append(start)
        graph.end.append(end)
        graph.label.append(label)
        graph.features.append([bucket("shape", shape), bucket("digits", str(min(len(digits), 20))), bucket("marks", "".join(sorted({c for c in token if not c.isalnum()})))])
        if before >= 0 and word == number - 1:
            graph.chain.append((before, node))
        key = digits if len(digits) >= 7 else token.lower()
        last = met.get(key, -1)
        first = node if last < 0 else firsts[last - begun]
        if last >= 0:
            graph.skip.append((last, node))
            if first != last:
                graph.skip.append((first, node))
        firsts.append(first)
        met[key] = before = node
        word = number


def graph_of(block: textkit.Block) -> tuple[Graph, dict[int, tuple[str, list[Span]]]]:
    """The union graph of a block's documents, and text and base spans of those that have a telling character."""
    telling = ((block.data >= 48) & (block.data <= 57)) | (block.data == 64)
    sums = np.concatenate([[0], np.cumsum(telling)])
    graph, found = Graph.empty(), {}
    for i in np.flatnonzero(sums[block.offsets[1:]] > sums[block.offsets[:-1]]).tolist():
        text = block.text(i)
        spans = base_spans(text)
        found[i] = (text, spans)
        add_document(graph, i, text, spans)
    return graph, found


# --- training -----------------------------------------------------------------------------------------------------


def train(docs: DataFrame) -> Model:
    """Potentials from all documents (text), labelled by the fixed patterns."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unary, chain, skip = np.zeros((BUCKETS, LABELS), np.int64), np.zeros((LABELS, LABELS), np.int64), np.zeros((LABELS, LABELS), np.int64)
        for batch in batches:
            for block in textkit.blocks(batch.column(0)):
                graph, _ = graph_of(block)
                label = np.array(graph.label, np.int64)
                if len(label):
                    for k in range(3):
                        np.add.at(unary, (np.array(graph.features)[:, k], label), 1)
                    for table, links in ((chain, graph.chain), (skip, graph.skip)):
                        if len(links):
                            a, b = np.array(links).T
                            np.add.at(table, (label[a], label[b]), 1)
        parts = []
        for part, table in enumerate((unary, chain, skip)):
            i, j = np.nonzero(table)
            parts.append((np.full(len(i), part), i, j, table[i, j]))
        columns = [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*parts, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "i", "j", "n"])

    counts = docs.select("text").mapInArrow(work, "part long, i long, j long, n long").groupBy("part", "i", "j").agg(F.sum("n").alias("n")).toPandas()
    tables = [np.zeros((BUCKETS, LABELS)), np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS))]
    for part, i, j, n in counts.itertuples(index=False):
        tables[part][i, j] = n
    return potentials(*tables)


def potentials(unary: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> Model:
    """Log potentials: features vote by their label shares; a link by how much likelier than chance its labels meet."""
    prior = (unary.sum(axis=0) + 1) / (unary.sum() + LABELS)
    share = (unary + 2 * prior) / (unary.sum(axis=1, keepdims=True) + 2)

    def lift(table: np.ndarray, same: float) -> np.ndarray:
        joint = table + table.T + prior[:, None] * prior[None] + same * np.diag(prior)
        joint = joint / joint.sum()
        edge = joint.sum(axis=1)
        return np.clip(np.log(joint / (edge[:, None] * edge[None])), -3, 3)

    return Model(np.log(share), lift(chain, 1.0), lift(skip, 5.0), bool(unary[:, 1:].sum()))


# --- inference ----------------------------------------------------------------------------------------------------


def beliefs(graph: Graph, model: Model, options: PiiOptions = PiiOptions()) -> np.ndarray:
    """Label probabilities of every node, by damped loopy sum-product.

    Messages are single floats, two of each link, updated in place in chunks of links: both of a link's messages depend on
    the sums of the round and on each other alone, so a chunk needs no copy of the rest.  All else is by node.
    """
    features = np.array(graph.features).reshape(-1, 3)
    n = len(features)
    unary = np.zeros((n, LABELS), np.float32)
    for k in range(3):
        unary += model.unary[features[:, k]]
    unary /= 3
    label = np.array(graph.label)
    seen = np.flatnonzero(label > 0)
    unary[seen] = -50.0
    unary[seen, label[seen]] = 0.0
    chain, skip = _pairs(graph.chain), _pairs(graph.skip)
    a, b = (np.concatenate([chain[:, k], skip[:, k]]) for k in (0, 1))
    forth, back = np.zeros((LABELS, len(a)), np.float32), np.zeros((LABELS, len(a)), np.float32)
    parts = [(k, min(k + CHUNK, stop), weight) for begin, stop, weight in ((0, len(chain), np.exp(model.chain).astype(np.float32)), (len(chain), len(a), np.exp(model.skip).astype(np.float32))) for k in range(begin, stop, CHUNK)]

    def sums() -> np.ndarray:
        total = unary.copy()
        for k in range(LABELS):
            if len(a):
                total[:, k] += np.bincount(b, weights=forth[k], minlength=n)
                total[:, k] += np.bincount(a, weights=back[k], minlength=n)
        return total

    def passed(out: np.ndarray, weight: np.ndarray) -> np.ndarray:
        likely = np.exp(out - out.max(axis=1, keepdims=True)) @ weight
        return np.log(likely / likely.sum(axis=1, keepdims=True))

    # Links whose own messages and whose ends have come to rest are left alone, until an end moves again.
    rest, stir, before = options.still / 10, np.ones(len(a), np.float32), None
    for _ in range(options.rounds if len(a) else 0):
        total, moved = sums(), 0.0
        uneasy = np.ones(n, bool) if before is None else np.abs(total - before).max(axis=1) > rest
        before = total
        for begin, stop, weight in parts:
            links = begin + np.flatnonzero((stir[begin:stop] > rest) | uneasy[a[begin:stop]] | uneasy[b[begin:stop]])
            if not len(links):
                continue
            old = forth[:, links].T, back[:, links].T
            new = passed(total[a[links]] - old[1], weight), passed(total[b[links]] - old[0], weight)
            change = np.zeros(len(links), np.float32)
            for messages, was, now in zip((forth, back), old, new, strict=True):
                now = options.damping * was + (1 - options.damping) * now
                np.maximum(change, np.abs(np.exp(now) - np.exp(was)).max(axis=1), out=change)
                messages[:, links] = now.T
            stir[links] = change
            moved = max(moved, float(change.max()))
        if moved < options.still:
            break
    total = sums()
    total -= total.max(axis=1, keepdims=True) if n else 0
    np.exp(total, out=total)
    return total / total.sum(axis=1, keepdims=True)


def added_spans(graph: Graph, model: Model, found: dict[int, tuple[str, list[Span]]], options: PiiOptions) -> dict[int, list[Span]]:
    """Spans of unlabelled tokens that the field is sure of; neighbours of one kind are one span; none touches a base span."""
    added: dict[int, list[Span]] = {}
    if not graph.doc or not model.trained:
        return added
    p = beliefs(graph, model, options)
    best = p[:, 1:].argmax(axis=1)
    sure = (np.array(graph.label) == 0) & (p[np.arange(len(p)), best + 1] >= options.belief)
    a, b = _pairs(graph.chain).T
    joined = set(b[sure[a] & sure[b] & (best[a] == best[b])].tolist())
    for node in np.flatnonzero(sure).tolist():
        row = graph.doc[node]
        spans = added.setdefault(row, [])
        if node in joined and spans:
            spans[-1] = (spans[-1][0], spans[-1][1], graph.end[node])
        else:
            spans.append((int(best[node]), graph.start[node], graph.end[node]))
    for row, spans in added.items():
        base = sorted((s, e) for _, s, e in found[row][1])
        starts = np.array([s for s, _ in base])
        reach = np.maximum.accumulate(np.array([e for _, e in base])) if base else np.zeros(0)
        clear = lambda s, e: not base or (k := int(np.searchsorted(starts, e)) - 1) < 0 or reach[k] <= s  # noqa: B023, E731
        added[row] = [x for x in spans if clear(x[1], x[2])]
    return added


def scan_block(block: textkit.Block, model: Model, options: PiiOptions) -> dict[int, tuple[str, list[Span], list[Span]]]:
    """Per row with a telling character: its text, base spans and all spans, both by kind, then start."""
    graph, found = graph_of(block)
    added = added_spans(graph, model, found, options)
    return {i: (text, base, sorted(base + added.get(i, []))) for i, (text, base) in found.items()}


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))


def scan(docs: DataFrame, model: Model | None = None, options: PiiOptions = PiiOptions()) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (kind, start, stop) in code points, by kind as listed, then start."""
    docs = docs.drop("base", "spans")
    shared = docs.sparkSession.sparkContext.broadcast(train(docs) if model is None else model)
    spot = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in textkit.blocks(batch.column(spot)):
                found = scan_block(block, shared.value, options)
                rows = [found.get(i, ("", [], [])) for i in range(len(block))]
                shown = lambda spans: [{"kind": KINDS[k], "start": s, "stop": e} for k, s, e in spans]
                own = batch.slice(block.first, len(block))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array([shown(r[1]) for r in rows], _ARROW), pa.array([shown(r[2]) for r in rows], _ARROW)], names=[*own.schema.names, "base", "spans"])

    return docs.mapInArrow(work, T.StructType([*docs.schema.fields, T.StructField("base", SPANS), T.StructField("spans", SPANS)]))


def redact(docs: DataFrame, model: Model | None = None, options: PiiOptions = PiiOptions()) -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in brackets, as [EMAIL]; n_chars follows the text."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs) if model is None else model)
    spot = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(spot).to_pylist()
            for block in textkit.blocks(batch.column(spot)):
                for i, (text, _, spans) in scan_block(block, shared.value, options).items():
                    if spans:
                        out, at = [], 0
                        for start, stop, kind in sorted((s, e, k) for k, s, e in spans):
                            if start >= at:
                                out += [text[at:start], f"[{KINDS[kind].upper()}]"]
                            at = max(at, stop)
                        texts[block.first + i] = "".join(out) + text[at:]
            columns = list(batch.columns)
            columns[spot] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    done = docs.mapInArrow(work, docs.schema)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done
