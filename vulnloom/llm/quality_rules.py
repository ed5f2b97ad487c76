"""Quality rules: per-document rules, then cross-document line frequency.

Normalised lines are hashed and counted by distinct documents per host; a line above its host's limit is removed from every
document (but, unless ``spare_first`` is off, the first that has it, so that a text does not vanish because it was copied), and
a document that removal leaves depleted is rejected.

All of it is DataFrame functions.  Texts are split once, into a stored table of (host, id, content, 64-bit hash) without the
lines themselves; counting combines on the map side, so a line on a third of all documents is one row a task.  Only lines
above the limit meet that table again, in a join that Spark may split at a hot line.

Defined cases: a null or empty text has no words and fails the base rules; a null host is a host of its own; rows of
one id are one document when lines are counted, rows without an id are one by their text, and each row is judged by its
own text; an empty table gives an empty result; other columns pass through, but ``measure`` and ``judge`` replace those of their own names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnloom.llm.common import SPACE_RUN, SPACES, aside, let, passing, stored, words

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MEASURES = ("word_chars", "n_symbols", "n_dup_lines", "n_words", "n_repeat_words")
VERDICTS = ("n_removed_words", "base_failed", "kept")


@dataclass(frozen=True)
class LineLimits:
    """A line is frequent in a host if more of its documents have it than ``share`` of them, but at least ``min_docs`` and
    at most ``max_docs``: the bounds keep a line's fate from hanging on the size of its host."""

    min_docs: int = 5
    max_docs: int = 100
    share: float = 0.02
    min_words: int = 10
    min_left: float = 0.2
    spare_first: bool = True


def normalised(line: Column) -> Column:
    """ASCII lower case, digits as 0, runs of spaces as one, trimmed."""
    folded = F.translate(line, UPPER + "123456789", UPPER.lower() + "000000000")
    return F.btrim(F.regexp_replace(folded, SPACE_RUN, " "), F.lit(" "))


def lines(text: Column) -> Column:
    """The \\n-split lines that have a word."""
    has_word = lambda x: F.btrim(x, F.lit(SPACES)) != ""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), has_word)


def repeated_words(windows: Column, n: int = 5) -> Column:
    """Words that windows of n words cover whose hash occurs twice or more; ``windows`` has the hashes by position.

    Equal hashes are neighbours once (hash, position) pairs are sorted; each of their positions covers n words or as
    many as lie before the next.
    """
    rest = lambda c: F.greatest(F.size(c) - 1, F.lit(0))
    paired = lambda c, f: F.zip_with(F.slice(c, 1, rest(c)), F.slice(c, 2, rest(c)), f)
    at = lambda c, k: F.coalesce(F.get(c, k), F.lit(False))
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(p: Column) -> Column:
        twice = lambda equal: F.filter(p, lambda x, k: at(equal, k - 1) | at(equal, k))
        return F.sort_array(F.transform(let(paired(p, lambda a, b: a["h"] == b["h"]), twice), lambda x: x["i"]))

    covered = lambda s: F.aggregate(paired(s, lambda a, b: F.least(b - a, F.lit(n))), F.lit(n).cast("long"), lambda t, x: t + x)
    return let(let(placed, starts), covered)


def _counts(text: Column, n: int) -> Column:
    """(n_words, n_repeat_words)."""

    def of(hashes: Column) -> Column:
        size = F.size(hashes)
        spots = F.when(size >= n, F.sequence(F.lit(0), size - n)).otherwise(F.array().cast("array<int>"))
        windows = F.transform(spots, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(n)]))
        again = let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), repeated_words(w, n)).otherwise(F.lit(0).cast("long")))
        return F.struct(size.cast("long").alias("n_words"), again.alias("n_repeat_words"))

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), of)


def measure(docs: DataFrame, n: int = 5) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (all long)."""
    docs = docs.drop(*MEASURES)
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.withColumns(
        {
            "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": let(lines(docs["text"]), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
            "_counts": _counts(docs["text"], n),
        }
    ).select(*docs.columns, "word_chars", "n_symbols", "n_dup_lines", "_counts.n_words", "_counts.n_repeat_words")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _content(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_rows(docs: DataFrame, host: str) -> DataFrame:
    """(host, doc_id, content, line, line_words, new) for every line with a word; ``new``: 1 for one of a document's equal lines, else 0."""
    one = lambda x: F.struct(F.xxhash64(normalised(x)).alias("line"), F.size(words(x)).alias("line_words"))
    placed = F.sort_array(F.transform(lines(docs["text"]), one))
    fresh = lambda p: F.transform(p, lambda x, i: x.withField("new", F.when((i > 0) & (F.get(p, i - 1)["line"] == x["line"]), 0).otherwise(1)))
    rows = docs.select(F.col(host).alias("host"), "doc_id", _content(docs["text"]).alias("content"), F.explode(let(placed, fresh)).alias("x"))
    return rows.select("host", "doc_id", "content", "x.line", "x.line_words", "x.new")


def frequent_lines(rows: DataFrame, docs: DataFrame, host: str = "source", limits: LineLimits = LineLimits()) -> DataFrame:
    """(host, line, n_docs, first) of the lines above their host's limit; ``rows`` are the ``line_rows`` of ``docs``.

    ``first``: the document (id, content) that is spared.
    """
    per_line = rows.groupBy("host", "line").agg(F.sum("new").alias("n_docs"), F.min(_document(rows)).alias("first"))
    hosts = docs.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("host_docs"))
    many = per_line.filter(F.col("n_docs") > limits.min_docs).alias("l")
    met = many.join(hosts.alias("h"), F.col("l.host").eqNullSafe(F.col("h.host")))
    most = F.least(F.greatest(F.col("host_docs") * limits.share, F.lit(float(limits.min_docs))), F.lit(float(limits.max_docs)))
    often = stored(met.withColumn("most", most).filter(F.col("n_docs") > F.col("most")).select("l.host", "l.line", "l.first", "most"), "often")
    # Rows are at least as many as documents, so only lines above the limit by rows are counted by document.
    document = F.coalesce(F.col("r.doc_id").cast("string"), F.concat(F.lit("-"), F.col("r.content").cast("string")))
    of = rows.alias("r").join(often.alias("o"), (F.col("r.line") == F.col("o.line")) & F.col("r.host").eqNullSafe(F.col("o.host")))
    each = of.select("o.host", "o.line", document.alias("document")).distinct().groupBy("host", "line").agg(F.count("*").alias("n_docs")).alias("e")
    counted = often.alias("o").join(each, (F.col("o.line") == F.col("e.line")) & F.col("o.host").eqNullSafe(F.col("e.host")))
    return counted.filter(F.col("e.n_docs") > F.col("o.most")).select("o.host", "o.line", "e.n_docs", "o.first")


def _document(rows: DataFrame) -> Column:
    """A row's document, ids before none."""
    return F.struct(rows["doc_id"].isNull().alias("none"), rows["doc_id"].alias("doc_id"), rows["content"].alias("content"))


KEY = ("host", "doc_id", "content")
OWN = ("_host", "_doc_id", "_content", "_cut", "_own", "_removed", "_left")


def _cuts(docs: DataFrame, host: str, limits: LineLimits) -> DataFrame:
    """(_host, _doc_id, _content, _cut, _removed): documents with lines to remove, the hashes of these, and their words.

    Rows that are equal in all of the key repeat each line once a row, which ``new`` counts.
    """
    rows = stored(line_rows(docs, host), "lines").alias("r")
    frequent = stored(frequent_lines(rows, docs, host, limits), "frequent").alias("f")
    hit = rows.join(frequent, (F.col("r.line") == F.col("f.line")) & F.col("r.host").eqNullSafe(F.col("f.host")))
    if limits.spare_first:
        hit = hit.filter(~(F.col("r.doc_id").eqNullSafe(F.col("f.first.doc_id")) & (F.col("r.content") == F.col("f.first.content"))))
    per_line = hit.groupBy(*[F.col(f"r.{k}").alias(f"_{k}") for k in KEY], "r.line").agg((F.sum("line_words") / F.sum("new")).cast("long").alias("n"))
    return per_line.groupBy(*[f"_{k}" for k in KEY]).agg(F.collect_set("line").alias("_cut"), F.sum("n").alias("_removed"))


def _joined(docs: DataFrame, cuts: DataFrame, host: str, content: Column) -> DataFrame:
    return docs.join(cuts, docs["doc_id"].eqNullSafe(cuts["_doc_id"]) & (content == cuts["_content"]) & docs[host].eqNullSafe(cuts["_host"]), "left").drop(*[f"_{k}" for k in KEY])


def judge(docs: DataFrame, host: str = "source", limits: LineLimits = LineLimits()) -> DataFrame:
    """``docs`` with the measures, base_failed, n_removed_words and kept.

    Measures are taken before documents meet their cuts, so texts that nobody asks for are not shuffled.
    """
    docs, back = aside(docs.drop(*MEASURES, *VERDICTS), *OWN)
    measured = measure(docs).withColumn("_own", _content(docs["text"]))
    judged = _joined(measured, _cuts(docs, host, limits).drop("_cut"), host, measured["_own"]).withColumn("base_failed", base_failed())
    judged = judged.withColumn("n_removed_words", F.coalesce(F.col("_removed"), F.lit(0).cast("long")))
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (left < limits.min_words) | (left < limits.min_left * F.col("n_words"))
    return judged.withColumn("kept", ~F.col("base_failed") & ~depleted).drop("_own", "_removed").withColumnsRenamed(back)


def clean(docs: DataFrame, host: str = "source", limits: LineLimits = LineLimits()) -> DataFrame:
    """The documents that pass, in ``docs``' columns, without the lines that were frequent in their host."""
    columns = docs.columns
    docs, back = aside(docs, *MEASURES, *OWN)
    measured = passing(measure(docs), ~base_failed())
    measured = _joined(measured, _cuts(docs, host, limits).drop("_removed"), host, _content(measured["text"]))
    stays = lambda x: ~F.array_contains(F.col("_cut"), F.xxhash64(normalised(x)))
    text = F.when(F.col("_cut").isNull(), F.col("text")).otherwise(F.array_join(F.filter(F.split("text", "\n"), stays), "\n"))
    left = F.size(words(F.col("text")))
    cleaned = measured.withColumn("text", text).withColumn("_left", left)
    passed = passing(cleaned, (F.col("_left") >= limits.min_words) & (F.col("_left") >= limits.min_left * F.col("n_words")))
    if "n_chars" in columns:
        passed = passed.withColumn("n_chars", F.length("text").cast("long"))
    return passed.select(*docs.columns).withColumnsRenamed(back)
