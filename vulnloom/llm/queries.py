"""The corpus operators applied to their whole tables with production parameters, and SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnloom.llm import decontaminate, hard_negatives, jaccard_join, language, mixing, packing, periodic_runs, pii, quality_classifier, quality_rules, secrets, toxicity, warc
from vulnloom.llm.common import crc_mod, let, table, words

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    model = language.train(docs.filter(~held).select("text", "lang"))
    predicted = language.predict(docs.select("doc_id", held.alias("held_out"), "text"), model)
    return predicted.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind_name"] == kind)).cast("long")
    return scanned.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(secrets.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"),
    )


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.assign_copies(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
    )


OP4_SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM totals),
weighted AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 3.0::DOUBLE AS cap FROM ranked),
leveled AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighted),
chosen AS (SELECT arg_min(level, struct_pack(r := cap / weight, k := rank)) AS level FROM leveled WHERE level * weight <= cap),
targets AS (
  SELECT source, source_size, CASE WHEN source_size = 0 THEN 0 ELSE least(cap, chosen.level * weight) END AS target FROM leveled, chosen),
rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN ('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT / 4503599627370496.0 < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rated
"""


def op5_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(spark, warc.write(table(spark, sf_dir, "pages")))


OP5_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
f AS (SELECT payload_digest, max(page_id) AS first FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT d.page_id, CAST(d.payload_bytes AS BIGINT) AS payload_bytes, d.payload_digest,
  CASE WHEN f.first > d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first > d.page_id THEN f.first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(crc_mod(F.col("doc_id"), 5) != 0)
    model = toxicity.train(docs, labels)
    held = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    scored = toxicity.score(docs.select("doc_id", held.alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", "predicted")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = pii.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return scanned.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(shown("base").cast("binary"), 256).alias("base_sha256"),
        shown("spans").alias("spans"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
grams AS (
  SELECT doc_id, i, list_slice(words, i, i + 4) AS gram FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 4)) AS i FROM w WHERE len(words) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM grams) WHERE n > 1),
covered AS (SELECT doc_id, CAST(count(DISTINCT j) AS BIGINT) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 4)) AS j FROM twice) GROUP BY doc_id),
line AS (
  SELECT doc_id, source, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n,
    trim(regexp_replace(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS key
  FROM (SELECT doc_id, source, unnest(lines) AS l FROM w)),
per_line AS (SELECT source, key, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_doc FROM line GROUP BY source, key),
host AS (SELECT source, count(*) AS host_docs FROM d GROUP BY source),
frequent AS (
  SELECT p.* FROM per_line p JOIN host h ON p.source IS NOT DISTINCT FROM h.source WHERE n_docs > least(greatest(host_docs * 0.02::DOUBLE, 5), 100)),
removed AS (
  SELECT l.doc_id, CAST(sum(l.n) AS BIGINT) AS n FROM line l JOIN frequent f ON l.key = f.key AND l.source IS NOT DISTINCT FROM f.source AND l.doc_id <> f.first_doc
  GROUP BY l.doc_id),
m AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    coalesce(c.n, 0) AS n_repeat_words, coalesce(r.n, 0) AS n_removed_words
  FROM w LEFT JOIN covered c USING (doc_id) LEFT JOIN removed r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - n_removed_words >= 10 AND n_words - n_removed_words >= 0.2::DOUBLE * n_words AS kept,
  n_removed_words
FROM m
"""


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def planted_text(doc_id: Column, text: Column) -> Column:
    """The text; if h = crc32 of the id ends in 0, with its words from a = g % n on repeating p of them (g = h // 10)."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % F.greatest(n, F.lit(1))
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return let(F.struct(a.alias("a"), p.alias("p")), lambda k: F.transform(w, lambda x, i: F.when(i < k["a"], x).otherwise(F.get(w, (k["a"] + (i - k["a"]) % k["p"]).cast("int")))))

    return F.when(h % 10 == 0, F.array_join(let(words(text), repeated), " ")).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", planted_text(F.col("doc_id"), F.col("text")).alias("text"))
    scanned = periodic_runs.scan(docs)
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    scanned = scanned.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), sha(F.array_join(F.transform("runs", line), "")).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))
    return scanned.select(
        "doc_id",
        "n_runs",
        (-F.col("b.start")).alias("start"),
        F.col("b.length").alias("length"),
        (-F.col("b.period")).alias("period"),
        F.floor(1000 * F.col("b.length") / -F.col("b.period")).alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("double"))
    sound = hard_negatives.usable(vectors).select("vec_id", moved.alias("label"), whole.alias("embedding"))
    return hard_negatives.mine(sound, F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, x.vec_id, x.label = a.label AS same, CAST(list_inner_product(a.e, x.e) AS BIGINT) AS score
  FROM v a JOIN v x ON a.vec_id % 100 = 0 AND x.vec_id <> a.vec_id),
positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positive p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= 5
"""


def op13_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def queries() -> dict[str, Query]:
    return {
        "op1_quality_classifier": op1_quality_classifier,
        "op2_language_id": op2_language_id,
        "op3_secret_scans": op3_secret_scans,
        "op4_source_mixing": op4_source_mixing,
        "op5_warc_bundles": op5_warc_bundles,
        "op6_toxicity": op6_toxicity,
        "op7_personal_data": op7_personal_data,
        "op8_quality_rules": op8_quality_rules,
        "op9_jaccard_join": op9_jaccard_join,
        "op10_decontamination": op10_decontamination,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_sequence_packing": op13_sequence_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_source_mixing": OP4_SQL, "op5_warc_bundles": OP5_SQL, "op8_quality_rules": OP8_SQL, "op12_hard_negatives": OP12_SQL}
