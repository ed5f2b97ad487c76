"""Models and passes held against plain Python: shrinkage, decoding, Markov ratios, windows, messages, templates; odd rows in the pipeline."""

import itertools
import math
import random
import re

import numpy as np
import pytest
import zstandard
from texts import prose

import corpus_pipeline
from vulnloom.llm import decontaminate, language, pii, quality_classifier, secrets, toxicity

# --- op1 ----------------------------------------------------------------------------------------------------------


def prior_weight(sites, most):
    """The moment estimate over sites (n, good, parent share)."""
    sites = [s for s in sites if s[0] > 1]
    own = sum((n - 1) * m * (1 - m) for n, _, m in sites)
    if not own:
        return most
    rho = (sum(n * (g / n - m) ** 2 for n, g, m in sites) - sum(m * (1 - m) for _, _, m in sites)) / own
    return most if rho <= 1 / (most + 1) else max(1 / rho - 1, 0.5)


def test_shrinkage(spark):
    rng = random.Random(1)
    rows = [(k, prose(k, 30), rng.choice(["a", "b", "c", None]), rng.choice(["x", "y", None])) for k in range(300)]
    labels = [(k, int(rng.random() < {"a": 0.9, "b": 0.2}.get(rows[k][2], 0.5))) for k in range(0, 300, 2)] + [(0, 1), (2, None), (None, 1), (999, 1)]
    docs = spark.createDataFrame([*rows, rows[5], (None, "some text", "a", "x")], "doc_id long, text string, source string, lang string")
    got = quality_classifier.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(got) == 302
    given = {}
    for i, q in labels:
        if i is not None and q is not None:
            given.setdefault(i, []).append(q)
    y = {i: sum(v) / len(v) for i, v in given.items() if i < 300}
    mean = sum(y.values()) / len(y)
    host, path = {}, {}
    for i, v in y.items():
        for table, key in ((host, rows[i][2]), (path, rows[i][2:])):
            n, g = table.get(key, (0, 0.0))
            table[key] = (n + 1, g + v)
    most = quality_classifier.QualityOptions().most_weight
    by_host = prior_weight([(n, g, mean) for n, g in host.values()], most)
    shrunk = {h: (g + by_host * mean) / (n + by_host) for h, (n, g) in host.items()}
    by_path = prior_weight([(n, g, shrunk[k[0]]) for k, (n, g) in path.items()], most)
    for r in got:
        own = y.get(r.doc_id)
        n, g = host.get(r.host, (0, 0.0))
        if own is not None:
            n, g = n - 1, g - own
        h = (g + by_host * mean) / (n + by_host)
        n, g = path.get((r.host, r.path), (0, 0.0))
        if own is not None:
            n, g = n - 1, g - own
        p = (g + by_path * h) / (n + by_path)
        assert r.host_share == pytest.approx(h) and r.path_share == pytest.approx(p)
        assert r.score == pytest.approx(1 / (1 + math.exp(-(math.log(p / (1 - p)) + r.evidence)))) and r.kept == (r.score >= 0.5)


# --- op2 ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [2, 5, 9])
def test_decoding(n):
    rng = np.random.default_rng(n)
    code = language.codewords(n)
    trust = rng.random(code.shape[1])
    model = language.Model(tuple(map(str, range(n))), code, np.zeros((1, 1)), np.zeros(code.shape[1]), trust / trust.sum())
    margins = rng.normal(size=(200, code.shape[1]))
    best, score, unsure = language.decode(model, margins)
    for row, b, s, u in zip(margins, best, score, unsure, strict=True):
        losses = [sum(t * math.log(1 + math.exp(-2 * m * c)) for m, c, t in zip(row, word, model.trust, strict=True)) for word in code]
        assert losses[b] == pytest.approx(min(losses))
        assert s == pytest.approx(1 / sum(math.exp(-4 * (x - min(losses))) for x in losses)) and u == (s < 0.6)


# --- op3 ----------------------------------------------------------------------------------------------------------


def test_markov_ratio(spark):
    """Tokens are added if, and only if, their ratio says so and they touch no base span; long texts are scanned whole."""
    rng = random.Random(3)
    letters = secrets.ALPHABET + "+/_-"
    ratios = [round(rng.uniform(-1, 2.2), 6) for _ in range(secrets.STATES**2)]
    piece = lambda: rng.choice([lambda: "".join(rng.choice(letters) for _ in range(rng.randint(5, 60))), lambda: f"token={''.join(rng.choice(letters) for _ in range(rng.randint(4, 30)))}", lambda: "%032x" % rng.getrandbits(128), lambda: "é,", lambda: prose(rng.random(), 3)])()
    texts = [rng.choice([" ", "\n", ""]).join(piece() for _ in range(rng.randint(0, 40))) for _ in range(60)] + [" ".join("%040x" % rng.getrandbits(160) for _ in range(25_000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    limits = secrets.MarkovLimits()
    state = lambda c: secrets.ALPHABET.find(c) if c in secrets.ALPHABET else secrets.STATES - 1
    added = 0
    for r in secrets.scan(df, ratios).select("doc_id", "base", "added").collect():
        text, want = texts[r.doc_id], []
        covered = bytearray(len(text))
        for b in r.base:
            covered[b.start : b.stop] = b"\x01" * (b.stop - b.start)
        for m in secrets_tokens(text):
            total = sum(ratios[state(a) * secrets.STATES + state(b)] for a, b in itertools.pairwise(m.group()))
            if total > limits.total and total > limits.mean * (len(m.group()) - 1) and not any(covered[m.start() : m.end()]):
                want.append((m.start(), m.end()))
        assert [(s.start, s.stop) for s in r.added] == want
        added += len(want)
    assert added > 20
    cleaned = {r.doc_id: r.text for r in secrets.redact(df, ratios).collect()}
    for r in secrets.scan(df, ratios).select("doc_id", "spans").collect():
        text, out, at = texts[r.doc_id], "", 0
        for s in sorted(r.spans, key=lambda s: s.start):
            if s.start >= at:
                out += text[at : s.start] + "[SECRET]"
            at = max(at, s.stop)
        assert cleaned[r.doc_id] == out + text[at:]


def secrets_tokens(text):
    return re.finditer(secrets.TOKEN, text)


# --- op6 ----------------------------------------------------------------------------------------------------------


def test_window_savings():
    rng = random.Random(4)
    ordinary, toxic = prose(1, 900).encode(), " ".join(rng.choice(["moron", "idiot", "scum"]) for _ in range(80)).encode()
    text = prose(2, 57) + " idiot scum MORON idiot " + prose(3, 40)
    words = text.lower().split()
    cut = [f" {' '.join(words[i : i + 10])} ".encode() for i in range(0, len(words), 10)]
    how = zstandard.ZstdCompressionParameters.from_level(5, min_match=4, strategy=zstandard.STRATEGY_LAZY, write_checksum=0, write_content_size=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    size = lambda content, w: len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how).compress(w))
    apart = [size(ordinary, w) - size(toxic, w) for w in cut]
    saved = [size(ordinary, w) - size(toxic + ordinary, w) for w in cut]
    found = toxicity.Evidence(ordinary, toxic, 10).features(text)
    assert found[:2] == pytest.approx([np.mean(apart), max(apart)]) and found[3:5] == pytest.approx([np.mean(saved), max(saved)])
    assert max(saved) == saved[5] or max(saved) == saved[6]
    assert toxicity.Evidence(ordinary, toxic, 10).features("") == [0.0] * toxicity.FEATURES == toxicity.Evidence(ordinary, toxic, 10).features(None)


# --- op7 ----------------------------------------------------------------------------------------------------------


def field(n, chain, skip, features, label):
    return pii.Graph([0] * n, list(range(n)), list(range(1, n + 1)), label, features, chain, skip)


def model_of(rng):
    counts = rng.integers(1, 30, size=(pii.BUCKETS, pii.LABELS)).astype(float)
    pair = lambda: rng.integers(1, 60, size=(pii.LABELS, pii.LABELS)).astype(float)
    return pii.potentials(counts, pair(), pair())


@pytest.mark.parametrize("seed", range(4))
def test_messages_on_trees(seed):
    """On graphs without loops the passed messages give the exact marginals."""
    rng = np.random.default_rng(seed)
    n, model = 6, model_of(rng)
    links = [(int(rng.integers(0, k)), k) for k in range(1, n)]
    chain, skip = links[:3], links[3:]
    label = [0] * n
    label[2] = 3
    graph = field(n, chain, skip, rng.integers(0, pii.BUCKETS, size=(n, 3)).tolist(), label)
    got = pii.beliefs(graph, model, pii.PiiOptions(still=1e-9))
    unary = model.unary[np.array(graph.features)].mean(axis=1)
    exact = np.zeros((n, pii.LABELS))
    for labels in itertools.product(range(pii.LABELS), repeat=n):
        if labels[2] == 3:
            energy = sum(unary[k, x] for k, x in enumerate(labels) if k != 2)
            energy += sum(model.chain[labels[a], labels[b]] for a, b in chain) + sum(model.skip[labels[a], labels[b]] for a, b in skip)
            for k, x in enumerate(labels):
                exact[k, x] += math.exp(energy)
    exact /= exact.sum(axis=1, keepdims=True)
    assert np.abs(got - exact).max() < 1e-4


def test_distant_repeats(spark):
    """A label seen once reaches every repeat of its token, however far off, and the spans are added."""
    rows = [(k, f"{prose(k, 6)} call +1555000{1000 + k} now, {prose(k + 500, 6)} or +1555000{1000 + k} later and pay {k % 7} times in 20{10 + k % 9}, so 20{10 + k % 9}; room {300 + k} {prose(k, 3)} room {300 + k}") for k in range(80)]
    model = pii.train(spark.createDataFrame(rows, "doc_id long, text string"))
    repeats = " ".join(f"{prose(900 + k, 12)} 15550007777 {k % 7}" for k in range(40))
    text = f"call +15550007777 now {repeats}"
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, prose(77, 400) + " 15550008888 " + prose(78, 40))], "doc_id long, text string")
    got = pii.scan(df, model).collect()
    spans = [[text[s.start : s.stop] for s in r.spans] for r in got[:3]]
    assert spans == [["+15550007777"] + ["15550007777"] * 40] * 3
    assert all(len(r.base) == 1 for r in got[:3]) and got[3].spans == []


# --- op10 ---------------------------------------------------------------------------------------------------------


def test_verbatim_items(spark):
    """Every document that holds an item word for word is found, wherever, however often and in whatever case; others are not."""
    rng = random.Random(6)
    names = ["Alice", "Robert", "Boston", "Denver"]
    word = lambda: rng.choice([prose(rng.random(), 1), prose(rng.random(), 1), prose(rng.random(), 1), str(rng.randint(2, 999)), rng.choice(names), "km"])
    items = {k: " ".join([prose(k, 1), *(word() for _ in range(rng.choice([4, 9, 16, 30])))]) for k in range(25)}
    docs, holds = [], {}
    for k in range(80):
        own = rng.sample(sorted(items), rng.choice([0, 0, 1, 2]))
        parts = [prose(1000 + k, 25) + ".", *(f"{items[i]}." for i in own for _ in range(rng.choice([1, 3]))), prose(2000 + k, 15)]
        text = " ".join(parts)
        docs.append((k, text.upper() if k % 11 == 0 and not any(n in text for n in names) else text))
        holds[k] = set(own)
    long = " ".join(prose(k, 200) for k in range(5000, 5800))
    docs += [(200, f"{long} {items[3]}. {long}"), (None, items[4]), docs[5], (201, None), (202, "")]
    holds |= {200: {3}}
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame([*items.items(), (100, None), (101, ""), (None, items[1])], "item_id long, text string")
    found = {}
    for r in decontaminate.matches(d, b).collect():
        found.setdefault(r.doc_id, set()).add(r.item_id)
    assert set(found) <= set(holds)
    for k, want in holds.items():
        assert want <= found.get(k, set()), (k, want)
        shared = lambda i: set(items[i].lower().split()) & {w for j in want for w in items[j].lower().split()}  # noqa: B023, E731
        assert all(len(shared(i)) > 0 for i in found.get(k, set()) - want)
    clean = [k for k, v in holds.items() if not v]
    assert len(clean) > 10 and not any(k in found for k in clean)


# --- the pipeline -------------------------------------------------------------------------------------------------


def test_stages_on_odd_rows(spark, odd_docs, tmp_path):
    """Nulls, blanks, long texts and repeats pass every stage; an empty table stays empty."""
    spark.createDataFrame([(1, prose(1, 30)), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs, kept in ((odd_docs, {4, 5, None}), (odd_docs.limit(0), set())):
        before = docs
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            after = corpus_pipeline.stored(stage(spark, before, str(tmp_path)), "odd")
            assert after.columns[: len(docs.columns)] == docs.columns
            assert {r.doc_id for r in after.select("doc_id").collect()} == kept
            before = after if k < len(corpus_pipeline.STAGES) - 1 else before
        if kept:
            assert before.filter("doc_id = 4").count() == 1


def test_run_reads_whole_tables(spark, odd_docs, tmp_path):
    odd_docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()} == {4, 5, None}
