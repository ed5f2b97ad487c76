"""Rules, secrets, personal data, languages and mixing against plain Python."""

import hashlib
import math
import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from texts import prose

from vulnloom.llm import decontaminate, jaccard_join, language, mixing, pii, quality_classifier, quality_rules, secrets, textkit, toxicity

WORD = re.compile("[^\x20\x09-\x0d]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {g for g in grams if grams.count(g) > 1}
    covered = {j for i, g in enumerate(grams) if g in twice for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def brute_kept(rows, limits):
    """(n_removed_words, kept) of each row (doc_id, source, text), by the plain rule."""
    norm = lambda x: re.sub("[ \t\x0b\x0c\r]+", " ", x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000"))).strip(" ")
    own = lambda t: [x for x in (t or "").split("\n") if WORD.search(x)]
    hosts = collections.Counter(s for _, s, _ in rows)
    docs = collections.defaultdict(list)
    for i, s, t in rows:
        for key in {norm(x) for x in own(t)}:
            docs[s, key].append((i is None, i or 0))
    frequent = {k: min(v) for k, v in docs.items() if len(v) > min(max(hosts[k[0]] * limits.share, limits.min_docs), limits.max_docs)}
    out = []
    for i, s, t in rows:
        n, gone = counts(t)[0], sum(len(WORD.findall(x)) for x in own(t) if (s, norm(x)) in frequent and (not limits.spare_first or frequent[s, norm(x)] != (i is None, i or 0)))
        failed = n < 10 or 100 * counts(t)[4] > 20 * n
        out.append((i, gone, not failed and n - gone >= limits.min_words and n - gone >= limits.min_left * n))
    return sorted(out, key=str)


@pytest.mark.parametrize("limits", [quality_rules.LineLimits(), quality_rules.LineLimits(share=0.4), quality_rules.LineLimits(max_docs=6, min_docs=2, spare_first=False)])
def test_frequent_lines_by_brute_force(spark, limits):
    rng = random.Random(5)
    stock = [prose(900 + k, rng.randint(3, 14)) for k in range(12)]
    rows = [(k, rng.choice(["a", "a", "a", "b", None]), "\n".join(rng.sample(stock, rng.randint(0, 4)) + [prose(k, rng.randint(1, 30))])) for k in range(90)]
    rows += [(200 + k, "a", rows[0][2]) for k in range(15)] + [(300, "b", None), (301, None, ""), (None, "a", rows[1][2])]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    got = [(r.doc_id, r.n_removed_words, r.kept) for r in quality_rules.judge(df, "source", limits).collect()]
    assert sorted(got, key=str) == brute_kept(rows, limits)
    assert {r.doc_id for r in quality_rules.clean(df, "source", limits).collect()} == {i for i, _, kept in brute_kept(rows, limits) if kept}


def test_measures(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "b", "c#", "dé", "<e>\n", "\tf\n\n"]) for _ in range(rng.randint(0, 60))) for _ in range(150)] + [None, "", "x\n\nx\nx y\x0b z"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.measure(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(texts[r.doc_id]), texts[r.doc_id]


def test_frequent_lines(spark):
    own = lambda k: f"{prose(k, 14)}\n"
    rows = [(k, "s", f"Same Line 7 here\n{own(k)}") for k in range(40)] + [(100 + k, "s", "same  line 9 HERE\nsame line 1 here") for k in range(3)] + [(200, "t", "same line 7 here\n" + own(999))]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    limits = quality_rules.LineLimits(min_docs=30, share=0.1)
    found = quality_rules.frequent_lines(quality_rules.line_rows(df, "source"), df, "source", limits).collect()
    assert [(r.host, r.n_docs, r["first"].doc_id) for r in found] == [("s", 43, 0)]
    got = {r.doc_id: (r.n_removed_words, r.kept) for r in quality_rules.judge(df, "source", limits).collect()}
    assert got[0] == (0, True) and got[1] == (4, True) and got[100][1] is False and got[200] == (0, True)
    cleaned = {r.doc_id: r.text for r in quality_rules.clean(df, "source", limits).collect()}
    assert cleaned[5] == own(5) and cleaned[0].startswith("Same Line") and 100 not in cleaned and cleaned[200].startswith("same line")


def test_odd_rows(spark, odd_docs):
    judged = quality_rules.judge(odd_docs, "source").collect()
    assert len(judged) == 8 and {r.doc_id: r.kept for r in judged}[4] is True and not any(r.kept for r in judged if r.doc_id in (1, 2, 3, 6))
    assert {r.doc_id for r in quality_rules.clean(odd_docs).collect()} == {4, 5, None}
    assert secrets.scan(odd_docs.limit(0)).count() == 0 and secrets.scan(odd_docs).count() == 8
    assert pii.scan(odd_docs.limit(0)).count() == 0 and [len(r.spans) for r in pii.scan(odd_docs).collect()] == [0] * 8
    assert sorted(r.text or "-" for r in pii.redact(odd_docs).collect()) == sorted(r.text or "-" for r in odd_docs.collect())
    mixed = mixing.assign_copies(odd_docs).collect()
    assert len(mixed) == 8 and all(0 <= r.mix_copies <= 3 for r in mixed) and mixing.mix(odd_docs.limit(0)).count() == 0
    model = language.train(odd_docs.select("text", "lang"))
    got = language.predict(odd_docs, model).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {1: "und", 2: "und", 3: "und", 4: "en", 5: "en", None: "en", 6: "und"}
    assert {r.lang_pred for r in language.predict(odd_docs, language.train(odd_docs.limit(0).select("text", "lang"))).collect()} == {"und"}
    labels = spark.createDataFrame([(4, 1, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality_classifier.classify(odd_docs, labels).count() == 8 and quality_classifier.classify(odd_docs.limit(0), labels.limit(0)).count() == 0
    scored = toxicity.score(odd_docs, toxicity.train(odd_docs, labels)).collect()
    assert len(scored) == 8 and all(0 <= r.score <= 1 for r in scored)
    assert {r.score for r in toxicity.score(odd_docs, toxicity.train(odd_docs, labels.limit(0))).collect()} == {0.0}


# --- secrets ------------------------------------------------------------------------------------------------------

SECRET = [
    re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    re.compile(r"AKIA[A-Z0-9]+"),
    re.compile(r"[0-9a-f]+"),
]


def secret_spans(text):
    out = []
    for k, p in enumerate(SECRET):
        for m in p.finditer(text or ""):
            if (len(m.group(1)) >= 8) if k == 0 else (m.end() - m.start() >= (16, 32)[k - 1]):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_secret_positions(spark):
    rng = random.Random(2)
    parts = ["é", " ", "\n", "token", "TOKEN", "secret: ", "api_key=", "apikey", "password", "passwd", "'", '"', ":", "=", "AKIA", "AKIA" + "Z" * 12, "0123456789abcdef", "f" * 32, "abcDEF12", "x", "𝒳"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(400)] + [None, "secret: token = abcdefghijk"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secrets.base_spans(df).collect():
        assert [(s.start, s.kind, s.stop) for s in r.base] == secret_spans(texts[r.doc_id]), texts[r.doc_id]


def test_markov_model(spark):
    rng = random.Random(3)
    key = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    names = ["configuration", "documentHandler", "internationalization", "performance_monitoring", "applicationContext", "transformation"]
    rows = [(k, f"{' '.join(rng.choice(names) for _ in range(30))} token = {key(30)}") for k in range(200)]
    model = secrets.train(spark.createDataFrame(rows, "doc_id long, text string"))
    plain = ["internationalizationConfiguration", "performance_monitoring_transformation", "documentHandlerApplicationContext"]
    random_one = [key(32) for _ in range(3)]
    df = spark.createDataFrame([(0, " ".join(plain) + " and " + " ".join(random_one)), (1, f"token: {random_one[0]}")], "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.scan(df, model).collect()}
    text = df.first().text
    assert [text[s.start : s.stop] for s in got[0].added] == random_one and len(got[1].base) == 1 and got[1].added == []
    assert secrets.redact(df, model).filter("doc_id = 1").first().text == "[SECRET]"


# --- personal data ------------------------------------------------------------------------------------------------

PERSONAL = [re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")]


def personal_spans(text):
    out = []
    for k, p in enumerate(PERSONAL):
        for m in p.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            fit = (True, k == 1 and all(int(x) <= 255 for x in m.group().split(".")), 13 <= len(digits) <= 19 and pii.luhn(digits), 9 <= len(digits) <= 15)[k]
            if fit:
                out.append((k, m.start(), m.end()))
    return out


def test_personal_patterns():
    rng = random.Random(4)
    for _ in range(20_000):
        text = "".join(rng.choice("a1@.+ -0(9)%_é5") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == personal_spans(text), text
    assert pii.base_spans("4111 1111 1111 1111") == [(2, 0, 19)] and not pii.luhn("4111111111111112")
    pii.base_spans("a" * 300_000 + "@" + "1" * 300_000)  # linear


def test_skip_chain(spark):
    rows = [(k, f"{prose(k, 5)} 4111 1111 1111 1111 and 5500005555555559 then mail{k}@host.org or +1 (301) 555-0{100 + k} end {k % 10} times") for k in range(60)]
    model = pii.train(spark.createDataFrame(rows, "doc_id long, text string"))
    text = "card 5500005555555559 later again, 5500-0055-5555-5559x and plain 12 words"
    df = spark.createDataFrame([(1, text, 7), (2, None, 7)], "doc_id long, text string, n_chars int")
    got = {r.doc_id: r for r in pii.scan(df, model).collect()}
    assert [(s.kind, text[s.start : s.stop]) for s in got[1].base] == [("card", "5500005555555559"), ("card", "5500-0055-5555-5559")] and got[2].spans == []
    clean = {r.doc_id: r for r in pii.redact(df, model).collect()}
    assert clean[1].text == "card [CARD] later again, [CARD]x and plain 12 words" and clean[1].n_chars == len(clean[1].text) and clean[2].text is None
    graph = pii.Graph([], [], [], [], [], [], [])
    pii.add_document(graph, 0, "+1 (301) 555-0123 xx +1 (301) 555-0123", [(3, 0, 17)])
    assert graph.label == [4, 4, 4, 0, 0, 0] and graph.skip == [(0, 3), (1, 4), (2, 5)]
    assert (pii.beliefs(graph, model)[3:, 4] > 0.9).all()


# --- languages, toxicity, quality, mixing -------------------------------------------------------------------------


def test_languages_held_out(spark):
    words = {"aa": "kalo miru tane solu peka".split(), "bb": "strchz gwrty plmnk vrrts kkjdt".split(), "cc": "ouille eauxel aientre quelou dansai".split(), "dd": "zungkeit schaft lichter heitung ganzer".split(), "ee": "xaxo xixu yexo yoxa xuyi".split()}
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice(words[lang]) for _ in range(30)), lang) for k, lang in enumerate(list(words) * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df.filter("doc_id % 4 <> 2"))
    assert model.code.shape == (5, 15)
    got = language.predict(df.filter("doc_id % 4 = 2"), model).collect()
    assert len(got) == 50 and all(r.lang == r.lang_pred and r.score > 0.5 for r in got)
    both = spark.createDataFrame([(1, " ".join(words["aa"] + words["bb"]) * 5)], "doc_id long, text string")
    assert language.predict(both, model).first().score < min(r.score for r in got)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 20])
def test_codewords(n):
    code = language.codewords(n)
    assert len(code) == n and set(np.unique(code)) <= {-1.0, 1.0}
    assert all((code[i] != code[j]).sum() >= max(1, code.shape[1] // 4) for i in range(n) for j in range(i))


def test_toxicity_held_out(spark):
    bad = "moron idiot scum trash worthless pathetic".split()
    rng = random.Random(6)
    rows = []
    for k in range(400):
        words = prose(k, 60).split()
        if k % 4 == 0:
            for _ in range(8):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((k, " ".join(words), int(k % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = toxicity.train(df.drop("toxic"), df.filter(~held).select("doc_id", "toxic"))
    got = toxicity.score(df.filter(held), model).collect()
    right = np.mean([(r.score >= 0.5) == bool(r.toxic) for r in got])
    assert right > 0.9 and all(r.predicted == int(r.score >= 0.5) for r in got)


def test_quality_sites(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for k in range(600):
        good = rng.random() < (0.9 if k % 3 == 0 else 0.3)
        text = prose(k, 50) if good or rng.random() < 0.5 else "## " * 40
        rows.append((k, text, "good" if k % 3 == 0 else "bad", "x"))
        if k % 2:
            labels.append((k, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {r.doc_id: r for r in quality_classifier.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert got[0].host_share > 0.7 > 0.5 > got[1].host_share
    assert np.mean([got[k].kept == bool(q) for k, q in labels]) > 0.75
    lone = quality_classifier.classify(docs.withColumn("source", F.when(F.col("doc_id") == 1, "new").otherwise(F.col("source"))), spark.createDataFrame(labels, "doc_id long, quality int")).filter("doc_id = 1").first()
    share = np.mean([q for _, q in labels])
    assert abs(lone.path_share - share) < 0.05


def targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    out, left, open_ = {}, sum(sizes.values()), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        for s in over or open_:
            out[s] = 3 * sizes[s] if over else level * weight[s]
            left -= out[s]
        open_ -= over or open_
    return out


def test_targets(spark):
    rng = random.Random(8)
    for _ in range(4):
        sizes = {s: rng.choice([0, 5, 40, 1000, 7000]) for s in ["a", "b", "é", "zz", None, "B", "c"]}
        got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        want = targets(sizes)
        assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], abs_tol=1e-6) for s in got)


def test_mix(spark):
    rows = [(k, prose(k, 20), "big" if k % 3 else "small") for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one = sorted(map(tuple, mixing.mix(df).collect()))
    assert one == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()))
    taken = {s: 0 for s in ("big", "small")}
    for r in one:
        taken[r[2]] += 20
    want = targets({"big": 12000, "small": 6000})
    assert all(abs(taken[s] - want[s]) < 0.1 * want[s] for s in taken)
    assert mixing.draw(F.lit(1), 17) is not None and 0 <= int(hashlib.md5(b"17:1").hexdigest()[:13], 16) / 2**52 < 1


def test_words_and_hashes():
    import pyarrow as pa

    rng = random.Random(9)
    texts = ["".join(rng.choice("aB é\n\t\x0b,") for _ in range(rng.randint(0, 30))) for _ in range(300)] + ["", "x"]
    for size in (64, 1 << 19):
        rows = []
        for block in textkit.blocks(pa.array([*texts, None]), size):
            words = textkit.words_of(block)
            for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True):
                rows.append([block.data[s:e].tobytes().decode() for s, e in zip(words.starts[a:b], words.ends[a:b], strict=True)])
        assert rows == [WORD.findall(t) for t in texts] + [[]]
    assert zlib.crc32(b"1") % 4 == spark_crc(1)


def spark_crc(k):
    return zlib.crc32(str(k).encode()) % 4


def test_blocks_bounded():
    """Rows and bytes of a block are bounded, nulls and slices included, and nothing is lost."""
    texts = ["a", None, "", "b c", "x" * 50, "d"] * 7
    column = pa.array(["cut", *texts, "cut"]).slice(1, len(texts))
    made = list(textkit.blocks(column, size=20, rows=4))
    assert max(map(len, made)) <= 4 and [b.text(i) for b in made for i in range(len(b))] == [x or "" for x in texts]
    assert [b.first for b in made] == [sum(map(len, made[:k])) for k in range(len(made))]


TAKEN = "n_words N_Symbols kept base spans added score predicted lang_pred mix_size mix_source mix_target mix_copy _tokens element hash u v rep host line content".split()


def test_clashing_names(spark, odd_docs):
    """Columns whose names operators add or use: operators that add columns replace them, stages hand them on."""
    docs = odd_docs.drop("kept").select("*", *[F.lit("own").alias(c) for c in TAKEN])
    labels = spark.createDataFrame([(4, 1, 1), (6, 0, 0)], "doc_id long, quality int, toxic int")
    assert {r.n_words for r in quality_rules.judge(docs, "source").select("n_words", "kept").collect()} != {"own"}
    secrets.scan(docs).select("base", "spans").collect()
    pii.scan(docs).select("base", "spans").collect()
    language.predict(docs, language.train(docs)).select("lang_pred", "score").collect()
    toxicity.score(docs, toxicity.train(docs, labels)).select("score", "predicted").collect()
    quality_classifier.classify(docs, labels).select("host", "score").collect()
    mixing.assign_copies(docs).select("mix_size", "mix_target").collect()
    benchmark = spark.createDataFrame([(1, "what is the sum of all the numbers from one to ten")], "item_id long, text string")
    stages = {
        "quality": quality_rules.clean(docs),
        "near": jaccard_join.keep_first(docs),
        "benchmark": decontaminate.remove_contaminated(docs, benchmark),
        "personal": pii.redact(docs),
        "secrets": secrets.redact(docs),
        "mix": mixing.mix(docs),
    }
    for name, kept in stages.items():
        expected = [c for c in docs.columns if c != "mix_copy"] + ["mix_copy"] if name == "mix" else docs.columns
        assert kept.columns == expected, name
        rows = kept.collect()
        assert rows and all(r[c] == "own" for r in rows for c in TAKEN if (name, c) != ("mix", "mix_copy")), name


def test_mixing_without_ids(spark):
    """Rows without an id are drawn one by one, so their source comes near its target too."""
    rows = [(k, "word " * 10, "a") for k in range(10)] + [(None, f"{prose(k, 10)}", "b") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = [r.mix_copies for r in mixing.assign_copies(df).filter("source = 'b'").collect()]
    rate = (100 + 3000 - 300) / 3000
    assert set(kept) == {0, 1} and abs(sum(kept) / 300 - rate) < 0.07
    again = [r.mix_copies for r in mixing.assign_copies(df.repartition(3)).filter("source = 'b'").orderBy("text").collect()]
    assert again == [r.mix_copies for r in mixing.assign_copies(df).filter("source = 'b'").orderBy("text").collect()]
