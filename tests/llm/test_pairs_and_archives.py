"""Similarity join, decontamination, archives and the pipeline against brute force."""

import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from texts import prose

import corpus_pipeline
from vulnloom.llm import components, decontaminate, jaccard_join, queries, textkit, warc

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(FOLD))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(texts, percent=80):
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(texts)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in texts}


def near_copies(seed, n_groups=12):
    """Groups of copies with a few edits each, short and long, around a passage that many documents share."""
    rng = random.Random(seed)
    shared, texts = prose(seed + 1000, 40), {}
    for g in range(n_groups):
        base = prose(seed * 100 + g, rng.choice([4, 7, 12, 25, 60, 300, 1500])).split()
        for _ in range(rng.choice([1, 2, 5, 12])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, len(base) // 60, len(base) // 40])):
                words[rng.randrange(len(words))] = prose(rng.random(), 1)
            text = " ".join(words)
            if g % 3 == 0:
                text += " " + shared
            texts[len(texts)] = text.upper() if rng.random() < 0.1 else text
    return texts


@pytest.mark.parametrize(("seed", "options"), [(1, jaccard_join.JoinOptions()), (2, jaccard_join.JoinOptions(often=2, watched=1, salt_rows=3, ids_most=3)), (3, jaccard_join.JoinOptions(list_rows=2)), (4, jaccard_join.JoinOptions(often=10**9, list_rows=1, ids_most=3))])
def test_jaccard_components(spark, seed, options):
    texts = near_copies(seed) | {1000: None, 1001: "", 1002: "a b", 1003: "A  b"}
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, rep string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.components(df, options).collect()}
    assert got == brute_components(texts)


def test_jaccard_long_lists(spark):
    """A passage that all documents hold and no task names: its lists are refined, and near copies beside it are still found."""
    rng = random.Random(8)
    passage, texts = prose(500, 60), {}
    for k in range(60):
        own = prose(600 + k, 70).split()
        texts[2 * k] = f"{passage} {' '.join(own)}"
        if k % 3 == 0:
            own[rng.randrange(10, 60)] = "changed"
            texts[2 * k + 1] = f"{' '.join(own)} {passage}"
    texts |= {1000 + k: f"{passage} {prose(k, 12)}" for k in range(30)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    options = jaccard_join.JoinOptions(often=10**9, list_rows=8)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.components(df, options).collect()}
    assert got == brute_components(texts)


def test_jaccard_odd(spark, odd_docs):
    got = [(r.doc_id, r.component_id) for r in jaccard_join.components(odd_docs).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (2, 2), (3, 3), (4, 4), (4, 4), (5, 5), (6, 6), (None, None)], key=str)
    assert jaccard_join.components(odd_docs.limit(0)).count() == 0
    assert jaccard_join.keep_first(odd_docs).columns == odd_docs.columns


def test_jaccard_repeated_ids(spark):
    """An id with two texts links by each of them; equal rows of an id are kept once."""
    a, b, c = prose(1, 60), prose(2, 60), prose(3, 60)
    near = b + " more"
    rows = [(5, a), (5, b), (9, b), (12, near), (20, c), (20, c), (30, prose(4, 60)), (30, None), (31, ""), (40, c + " more"), (None, prose(6, 60)), (30, prose(5, 60)), (29, prose(5, 60)), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for flipped in (rows, rows[::-1]):
        got = {(r.doc_id, r.component_id) for r in jaccard_join.components(spark.createDataFrame(flipped, docs.schema).coalesce(1)).collect()}
        assert got == {(5, 5), (9, 5), (12, 5), (20, 20), (40, 20), (29, 29), (30, 29), (31, 31), (None, None)}
    kept = [tuple(r) for r in jaccard_join.keep_first(docs).collect()]
    assert sorted(kept, key=str) == sorted([(5, a), (5, b), (20, c), (29, prose(5, 60)), (31, ""), (None, prose(6, 60)), (None, a)], key=str)


def test_jaccard_split_key(spark):
    """A near copy alone in its part of a key, whose other documents are copies that speak once a task."""
    options = jaccard_join.JoinOptions(often=2, watched=1, salt_rows=1)
    elements = lambda words: next(textkit.shingle_sets(next(textkit.blocks(pa.array([" ".join(words)])))))
    words = next(w for w in (prose(k, 9).split() for k in range(1000)) if elements(w)[-1] not in elements(w[:8]))
    parts = 1 + 2 // options.salt_rows
    part = lambda i: int(textkit.mix(np.array([i], np.uint64))[0] >> np.uint64(1)) % parts
    rows = [(i, " ".join(words)) for i in [k for k in range(30_000) if part(k) == 1][:5000]]
    rows.append((next(k for k in range(50_000, 60_000) if part(k) == 0), " ".join(words[:8])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    assert {r["component_id"] for r in jaccard_join.components(docs, options).collect()} == {rows[0][0]}


def test_jaccard_percent(spark):
    texts = near_copies(5, 6) | {500: "a b c d e f g", 501: "a b c d e f", 502: "x y"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.components(docs, jaccard_join.JoinOptions(percent=60)).collect()}
    assert got == {i: c for i, (_, c) in brute_components(texts, 60).items()}
    with pytest.raises(ValueError):
        jaccard_join.JoinOptions(percent=50)


def test_boundary():
    assert jaccard_join.boundary({}, 80) == 0
    assert jaccard_join.boundary({6: 1000, 500: 1000}, 80) > 0
    assert [jaccard_join.prefix_size(n, 80) for n in (1, 4, 5, 10, 100)] == [1, 1, 2, 3, 21]


def test_connected(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(30)]
    got = {r.node: r.component for r in components.connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(100):
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    linked = {x for u, v in edges if u != v for x in (u, v)}
    assert got == {x: root[x] for x in linked}


def test_decontamination(spark):
    items = {
        1: "A train leaves Boston at 9 am and travels 120 km before it meets Alice who walked 3 hours from Denver to see it",
        2: prose(77, 30),
        3: "tiny one",
        4: None,
    }
    filler = lambda k: prose(k, 60)
    docs = {
        1: f"{filler(1)}. {items[1]}. {filler(2)}",
        2: f"{filler(3)} " + items[1].replace("120", "75").replace("9 am", "4 am").replace("Alice", "Robert").replace("Boston", "Berlin"),
        3: filler(4) + " " + items[2].upper().replace(" ", "!! "),
        4: filler(5),
        5: None,
        6: "tiny one",
        7: filler(6) + " " + " ".join(items[2].split()[:6]),
        8: "",
    }
    d = spark.createDataFrame([(i, t, 1) for i, t in docs.items()], "doc_id long, text string, item_id int")
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    for options in (decontaminate.TemplateOptions(), decontaminate.TemplateOptions(block=5)):
        got = {r.doc_id: (r.item_ids, r.reparameterised) for r in decontaminate.contaminated(d, b, options).collect()}
        assert got == {1: ([1], False), 2: ([1], True), 3: ([2], False)}
    assert decontaminate.contaminated(d, b.limit(0)).count() == 0 and decontaminate.contaminated(d.limit(0), b).count() == 0
    kept = decontaminate.remove_contaminated(d, b)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {4, 5, 6, 7, 8}


def test_decontamination_occurrences(spark):
    """Items that a document holds several times, with other values each time, and items of one template."""
    one = "A train leaves the city at 9 and travels 120 km to a town where 45 people have waited for 3 hours"
    other = one.replace("9", "8").replace("120", "75").replace("45", "61").replace("3 hours", "2 hours")
    third = one.replace("9", "5").replace("120", "31").replace("45", "17").replace("3 hours", "6 hours")
    shifted = other.replace("travels", "slowly travels")
    docs = {
        1: f"{one}. {other}.",
        2: f"{prose(1, 30)}. {other}. {prose(2, 30)}. {third}.",
        3: f"{one}. {other}. {third}. {shifted}.",
        4: prose(3, 60),
        5: f"{other}. {prose(4, 30)}. {third.replace('people have', 'people there have')}.",
    }
    d = spark.createDataFrame([*docs.items(), (6, one), (6, other), (6, third)], "doc_id long, text string")
    b = spark.createDataFrame([(1, one), (2, third)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.coverage, r.exact) for r in decontaminate.matches(d, b).collect()}
    assert {k: v for k, v in got.items() if k[0] != 5} == {(1, 1): (1, True), (1, 2): (1, False), (2, 1): (1, False), (2, 2): (1, True), (3, 1): (1, True), (3, 2): (1, True), (6, 1): (1, True), (6, 2): (1, True)}
    assert {k for k in got if k[0] == 5} == {(5, 1), (5, 2)}


def test_decontamination_verbatim(spark):
    """Items that are no templates, rich in numbers, names and units or short, are found where they stand verbatim."""
    items = {
        1: "Compute 12 * 7 + 3 - 9",
        2: "3 7 12 45 61 8 99 23 51 17 4 76 31 88 2",
        3: "What is 6 x 7?",
        4: "A tank holds 5 kg 7 m 12 km 9 mg 14 cm 3 ft 8 lb 6 oz of salt and water when it is full to the brim today",
        5: "It met Alice, Robert, Maria, 4 kg, 7 lb, Peter, 9 oz, Susan, 12 km, Tom",
    }
    d = {k: f"{prose(k, 30)}. {t}. {prose(k + 20, 30)}" for k, t in items.items()}
    d |= {10 + k: f"{prose(k, 30)} {t.lower()} {prose(k + 20, 30)}" for k, t in items.items()}
    d |= {21: prose(9, 30) + " compute 13 * 7 + 3 - 9", 22: "3 7 12 45 61 9 99 23 51 18 4 76 31 89 2", 23: "what is 6 x 8?", 24: "", 25: None}
    d |= {26: items[4].replace("6 oz", "7 oz")}
    docs = spark.createDataFrame(list(d.items()), "doc_id long, text string")
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    for options in (decontaminate.TemplateOptions(), decontaminate.TemplateOptions(block=5)):
        got = {(r.doc_id, r.item_id): (r.coverage, r.exact) for r in decontaminate.matches(docs, b, options).collect()}
        assert {k: v for k, v in got.items() if k[0] != 26} == {(k + n, k): (1, True) for k in items for n in (0, 10)}
        assert {k: v[1] for k, v in got.items() if k[0] == 26} == {(26, 4): False}


PAGES = "page_id long, url string, html string, digest string"


def test_archives_round_trip(spark):
    big, other = "<p>" + "é" * 700 + "</p>", "x" * 1000
    rows = [(1, "http://a", big, "d"), (2, "http://b", big, "d"), (3, None, big, "d"), (4, "u\r\nX: y", "short", "d"), (5, "u", "short", "d"), (6, "u", None, "d"), (7, "u", other, None), (None, "u", other, "d"), (8, "u", "\r\n\r\nWARC/1.1\r\n" * 100, "d")]
    pages = spark.createDataFrame(rows, PAGES)
    index = warc.write(pages, warc.BundleOptions(frame_bytes=2000, bundle_bytes=4000))
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.read(spark, index).collect()}
    n = len(big.encode())
    assert got == {1: (n, "revisit", 3), 2: (n, "revisit", 3), 3: (n, "response", None), 4: (5, "response", None), 5: (5, "response", None), 6: (0, "response", None), 7: (1000, "response", None), None: (1000, "response", None), 8: (1400, "response", None)}
    for row in index.filter("page_id IN (2, 3, 8)").collect():
        record = warc.read_record(row.asDict())
        assert record.headers["WARC-Record-ID"] == f"<urn:page:{row.page_id}>"
        assert record.payload.decode() == ("" if row.page_id == 2 else dict((r[0], r[2]) for r in rows)[row.page_id])
    assert warc.read(spark, warc.write(pages.limit(0))).count() == 0


def test_archives_spread(spark):
    """Frames are read by several tasks however many bundles there are, and a very long payload survives."""
    rows = [(k, "u", prose(k, 400), "d") for k in range(60)] + [(1000, "u", "<p>" + "x" * 3_000_000 + "</p>", "d")]
    pages = spark.createDataFrame(rows, PAGES).repartition(4)
    for bundle_bytes in (1 << 26, 10_000):
        options = warc.BundleOptions(frame_bytes=3000, bundle_bytes=bundle_bytes)
        index = warc.write(pages, options)
        assert bundle_bytes > 1 << 20 or index.select("bundle").distinct().count() > 4
        found = warc.read(spark, index)
        assert found.groupBy(F.spark_partition_id()).count().count() > 2
        assert {r.page_id: r.payload_bytes for r in found.collect()} == {r[0]: len(r[2]) for r in rows}


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = corpus_pipeline.stored(stage(spark, before, SF), "test")
        assert after.columns[: len(docs.columns)] == docs.columns and (k == len(corpus_pipeline.STAGES) - 1 or after.columns == docs.columns)
        if name == "n-gram Jaccard join":
            texts = {r.doc_id: r.text for r in before.collect()}
            assert {r.doc_id for r in after.collect()} == {i for i, (_, c) in brute_components(texts).items() if i == c}
        if name == "personal data":
            assert after.count() == before.count() and after.filter(F.col("text").rlike(r"[a-z0-9]@[a-z0-9]+\.")).count() == 0
        before = after
    assert before.count() > 0


def test_registered():
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in queries.queries()}
    assert set(queries.oracle_sql()) <= set(queries.queries())
