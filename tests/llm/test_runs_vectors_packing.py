"""Periodic runs, hard negatives and packing against brute force and exact round trips; odd rows."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from texts import prose

from vulnloom.llm import hard_negatives, packing, periodic_runs
from vulnloom.llm.queries import planted_text

# --- op11 ---------------------------------------------------------------------------------------------------------


def runs_by_hand(w, exponent=4, least=6):
    """Maximal stretches for every period, the smallest period of each first."""
    n, out = len(w), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, exponent * q) and not any(s <= i and s + m >= j + q and q % p == 0 for s, m, p in out.values()):
                out[i, q] = (i, j + q - i, q)
            i = max(j, i + 1)
    return sorted(out.values(), key=lambda r: (r[0], r[2]))


def made_up(rng):
    k = rng.choice([1, 2, 2, 3])
    draw = lambda n: [rng.randrange(k) for _ in range(n)]
    kind = rng.randrange(3)
    if kind == 0:
        return draw(rng.randint(0, 40))
    if kind == 1:
        return draw(rng.randint(0, 6)) + draw(rng.randint(1, 6)) * rng.randint(1, 8) + draw(rng.randint(0, 6))
    w = draw(1)
    while len(w) < 40:
        w = w + w[rng.randrange(len(w)) :] if rng.random() < 0.7 else w + draw(1)
    return w


def test_lyndon_array_and_runs():
    rng = random.Random(5)
    for _ in range(1500):
        w = made_up(rng)
        following, shared = periodic_runs.lyndon_edges(w)
        assert following == [next((j for j in range(i + 1, len(w)) if w[j:] < w[i:]), len(w)) for i in range(len(w))]
        for i, j in enumerate(following):
            if j < len(w):
                a, b = w[i + shared[i] :], w[j + shared[i] :]
                assert w[i : i + shared[i]] == w[j : j + shared[i]] and (not b or a[0] != b[0])
        for exponent in (3, 4):
            assert periodic_runs.runs_of(np.array(w, np.uint64), exponent) == runs_by_hand(w, exponent)


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("sign", [1, -1])
def test_letters_are_read_once(sign):
    rng = random.Random(2)
    words = {
        "one": [1] * 20_000,
        "fibonacci": fibonacci(20_000),
        "thue-morse": [bin(i).count("1") % 2 for i in range(20_000)],
        "random": [rng.randrange(2) for _ in range(20_000)],
        "stairs": [x for k in range(200) for x in [0] * k + [1]],
        "falling stairs": [x for k in range(200, 0, -1) for x in [0] * k + [1]],
        "copies": (x := [rng.randrange(2) for _ in range(5000)]) + x + x[::-1] + x,
    }
    for name, w in words.items():
        tally = [0]
        periodic_runs.lyndon_edges([sign * x for x in w], tally)
        assert tally[0] <= len(w), name


def test_scan_of_runs(spark, odd_docs):
    rng = random.Random(9)
    vocabulary = ["a", "b", "hi", "straße", "a\x00", "antidisestablishment", "antidisestablishmenu", "eightchr", "eightchs", "twelveletter"]
    texts = [" ".join(vocabulary[x] for x in rng.sample(range(10), 4) * rng.randint(1, 7) + made_up(rng)) for _ in range(150)]
    texts += [" \n".join(["same"] * 50_000), "a b\tc\x0bd e f " * 4]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for cut in (True, False):
        for r in periodic_runs.scan(docs, cut=cut).collect():
            w = re.findall(r"[^ \t-\r]+", r.text)
            want = runs_by_hand(w) if len(w) < 10_000 else [(0, 50_000, 1)]
            assert [tuple(x) for x in r.runs] == want
            gone = {k for s, m, q in want for k in range(s + q, s + m)}
            assert r.collapsed == " ".join(x for k, x in enumerate(w) if k not in gone)
    odd = periodic_runs.scan(odd_docs.withColumnRenamed("kept", "runs"))
    assert odd.columns == ["doc_id", "text", "lang", "source", "n_chars", "words", "runs", "collapsed"]
    got = odd.collect()
    assert len(got) == 8 and all(r.runs == [] for r in got) and all(r.collapsed == " ".join((r.text or "").split()) for r in got)
    assert periodic_runs.scan(docs.limit(0)).count() == 0


def test_planted_text(spark):
    texts = [prose(k, k) for k in range(60)] + [None]
    got = spark.createDataFrame([*enumerate(texts), (None, "x y")], "doc_id long, text string").withColumn("text2", planted_text(F.col("doc_id"), F.col("text"))).collect()
    changed = 0
    for r in got:
        h = zlib.crc32(str(r.doc_id).encode()) if r.doc_id is not None else 1
        w, g = (r.text or "").split(), h // 10
        if h % 10 == 0 and w:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
            changed += 1
        assert (r.text2 or "").split() == w
    assert changed > 2


# --- op12 ---------------------------------------------------------------------------------------------------------


def mined_by_hand(rows, is_anchor, low=80, high=100, k=5):
    out = []
    for a, (i, label, x) in enumerate(rows):
        if not is_anchor(i):
            continue
        scored = sorted((-int(np.dot(x, y)), j, b) for b, (j, _, y) in enumerate(rows) if b != a)
        for s, j, _ in [t for t in scored if rows[t[2]][1] == label][:k]:
            fit = [t for t in scored if rows[t[2]][1] != label and low * -s <= 100 * -t[0] <= high * -s][:k]
            out += [(i, j, rank + 1, m, -s, -t) for rank, (t, m, _) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("shape", ["clusters", "copies", "spread"])
def test_hard_negatives(spark, shape):
    rng = np.random.default_rng(3)
    n, dim = 700, 6
    centre = rng.normal(size=(9, dim))
    x = {"clusters": centre[rng.integers(0, 9, n)] + 0.2 * rng.normal(size=(n, dim)), "copies": np.where(rng.random((n, 1)) < 0.4, centre[:1], rng.normal(size=(n, dim))), "spread": rng.normal(size=(n, dim)) * rng.random((n, 1)) * 3}[shape]
    x = np.floor(40 * x)
    rows = [(int(i), int(rng.integers(0, 3)), v.tolist()) for i, v in zip(rng.permutation(n), x, strict=True)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3)
    want = mined_by_hand(rows, lambda i: i % 20 == 0)
    for options in (hard_negatives.MineOptions(), hard_negatives.MineOptions(sample=128, part_rows=40, block=16, leaf=8, first=2)):
        got = hard_negatives.mine(frame, F.col("vec_id") % 20 == 0, options)
        assert sorted(map(tuple, got.collect())) == want
    assert want


def test_tree_leaves_rows_out():
    rng = np.random.default_rng(1)
    x = np.floor(100 * (np.repeat(rng.normal(size=(16, 8)), 64, axis=0) + 0.02 * rng.normal(size=(1024, 8))))
    square = float((x * x).sum(axis=1).max())
    part = hard_negatives.Part(x, np.arange(1024), np.arange(1024) % 2, np.arange(1024), square, 16)

    class Watched(np.ndarray):
        opened = 0

        def __matmul__(self, other):
            Watched.opened += len(self)
            return np.asarray(self) @ other

    part.x = part.x.view(Watched)
    q = x[5]
    seen = hard_negatives.distances(np.append(q, 0)[None], part.tree.points)[0]
    best = part.search(q, seen, 1, 5, [(-np.inf, np.inf)], 5, True, 1e-6)
    scores = sorted(((-float(x[i] @ q), i, i) for i in range(1024) if i % 2 == 1 and i != 5))[:5]
    assert best == [scores] and Watched.opened < 600


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 2.0]), (0, 1, [1.0, 2.0]), (1, 1, [3.0]), (2, 2, [2.0, 1.0]), (3, 2, [2.0, 1.0]), (4, None, [9.0, 9.0]), (5, 2, None), (6, 2, [nan, 1.0]), (7, 2, [inf, 1.0]), (None, 2, [2.0, 2.0]), (8, 2, [None, 1.0]), (9, 2, [])]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    sound = [(0, 1, [1, 2]), (0, 1, [1, 2]), (1, 1, [3, 0]), (2, 2, [2, 1]), (3, 2, [2, 1]), (9, 2, [0, 0])]
    got = hard_negatives.mine(frame.withColumn("row", F.col("vec_id")), F.col("vec_id") == 0)
    assert sorted(map(tuple, got.collect())) == mined_by_hand(sound, lambda i: i == 0)
    assert hard_negatives.mine(frame.limit(0), F.col("vec_id") == 0).count() == 0
    assert hard_negatives.mine(frame, F.col("vec_id") == 77).count() == 0
    with pytest.raises(ValueError):
        hard_negatives.mine(spark.createDataFrame([(0, 1, [1e9])], "vec_id long, label int, embedding array<double>"), F.col("vec_id") == 0)


# --- op13 ---------------------------------------------------------------------------------------------------------


def best_fit_by_hand(sizes, width):
    free, out = [], {}
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        fits = [w for w, c in enumerate(free) if c >= sizes[k]]
        w = min(fits, key=lambda w: free[w]) if fits else len(free)
        if not fits:
            free.append(width)
        out[k] = width - free[w]
        free[w] -= sizes[k]
    return sorted(free), out


def test_best_fit_decreasing():
    rng = random.Random(4)
    for width in (1, 5, 64, 100):
        for _ in range(30):
            sizes = [rng.randint(1, width) for _ in range(rng.randint(0, 60))]
            places, count = packing.best_fit_decreasing(sizes, width)
            filled = {}
            for size, (w, at) in sorted(zip(sizes, places, strict=True), key=lambda x: x[1]):
                assert filled.get(w, 0) == at
                filled[w] = at + size
            free, _ = best_fit_by_hand(sizes, width)
            assert len(filled) == count == len(free) and sorted(width - x for x in filled.values()) == free


@pytest.fixture(scope="module")
def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json")


def test_parts_encode_like_whole_texts(tokenizer):
    import pyarrow as pa
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer)
    rng = random.Random(1)
    signs = [*" \n\t'.,ab1é×  日😀\x1c\x85\r", "<|endoftext|>", " ", " ", "'s", "'ll", "word"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 12))) for _ in range(8000)] + [None, "", "a  <|endoftext|>  b", " \n<|endoftext|>x"]
    small = packing.Encoder(tokenizer, packing.PackOptions(parts=50))
    for encoder in (packing.Encoder(tokenizer), small):
        for text, ids in zip(texts, encoder.encode(pa.array(texts)), strict=True):
            assert ids.tolist() == whole.encode(text or "", add_special_tokens=False).ids, text


def test_packed_documents(spark, odd_docs, tokenizer):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer)
    texts = [prose(k, (k * 37) % 900) for k in range(120)] + [prose(7, 30_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    options = packing.PackOptions(width=256, hold=20_000)
    packed = packing.pack(docs, tokenizer, options)
    by_doc, by_sequence = {}, {}
    for r in packed.collect():
        assert len(r.ids) == 4 * r.length
        by_doc.setdefault(r.doc_id, []).append((r.start, r.ids, r.doc_tokens))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, text in enumerate(texts):
        want = [*whole.encode(text, add_special_tokens=False).ids, 0]
        own = sorted(by_doc[i])
        assert b"".join(x[1] for x in own) == np.array(want, "<u4").tobytes() and {x[2] for x in own} == {len(want)}
        assert [x[0] for x in own] == list(range(0, len(want), 256))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    told = packing.padding(packed, options).first()
    lengths = [sum(m for _, m in p) for p in by_sequence.values()]
    assert (told.sequences, told.tokens, told.padded) == (len(lengths), sum(lengths), sum(256 - n for n in lengths if n & (n - 1)))
    assert told.padded < 0.05 * told.tokens
    assert {tuple(r) for r in packed.collect()} == {tuple(r) for r in packed.collect()}
    odd = packing.pack(odd_docs, tokenizer)
    assert odd.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    assert odd.filter("doc_id in (1, 2)").select("doc_tokens").distinct().collect() == [(1,)]
    assert odd.filter("doc_id = 4").count() == 2 and odd.filter("doc_id is null").count() == 1
    assert packing.pack(docs.limit(0), tokenizer).count() == 0
