"""Quality classifier: hierarchical empirical Bayes over documents, paths and hosts.

A document's own evidence is a log-odds sum over binned text features, learned by one group-by over all labelled
documents and put to scale by a one-dimensional calibration.  To it come the posteriors of where it stands: the share of
good documents of its host, shrunk to the global share, and that of its path in the host, shrunk to the host's.  How
strongly a level shrinks (its prior's weight in documents) is estimated by moments from how much shares differ
beyond chance, so a site with few labels takes its parent's value and one with many its own.

Features are DataFrame functions and the labelled part is aggregated in place: per task a few hundred counts, whatever the
size of a host.  A labelled document's own label is left out of its site's counts.

Defined cases: a null or empty text has the lowest bins; a null host or path is a site of its own; a document without a
label is scored like any other; labels that repeat an id count once, by their mean; without labels of both kinds the
score is the share of good labels (one half without any); rows that repeat an id are scored each, rows without one too; an empty
table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnloom.llm.common import SPACES, stored, words
from vulnloom.llm.quality_rules import SYMBOLS, UPPER, lines

BINS = 16
FEATURES = ("size", "word_length", "symbols", "capitals", "digits", "marks", "distinct", "lines_again")


@dataclass(frozen=True)
class QualityOptions:
    threshold: float = 0.5
    most_weight: float = 500.0


def _bin(x: Column) -> Column:
    return F.least(F.greatest(F.floor(x), F.lit(0)), F.lit(BINS - 1)).cast("int")


def binned(docs: DataFrame) -> DataFrame:
    """``docs`` with one bin (0 to 15) per feature of ``text``."""
    text = F.coalesce(docs["text"], F.lit(""))
    share = lambda chars: (F.length(text) - F.length(F.translate(text, chars, ""))) / F.greatest(F.length(text), F.lit(1))
    letters = F.length(F.translate(text, SPACES, ""))
    ready = docs.withColumns({"_words": words(docs["text"]), "_lines": lines(docs["text"])})
    n, m = F.greatest(F.size("_words"), F.lit(1)), F.greatest(F.size("_lines"), F.lit(1))
    return ready.withColumns(
        {
            "size": _bin(F.log2(F.size("_words") + F.lit(1.0))),
            "word_length": _bin(letters / n),
            "symbols": _bin(F.ceil(share(SYMBOLS) * 100)),
            "capitals": _bin(F.ceil(share(UPPER) * 40)),
            "digits": _bin(F.ceil(share("0123456789") * 100)),
            "marks": _bin(F.ceil(share("!?|=~^_{}[]@") * 100)),
            "distinct": _bin(F.size(F.array_distinct("_words")) / n * (BINS - 1)),
            "lines_again": _bin((m - F.size(F.array_distinct("_lines"))) / m * (BINS - 1)),
        }
    ).drop("_words", "_lines")


def evidence_weights(labelled: DataFrame) -> list[list[float]]:
    """Log odds of good per feature and bin, half a document added to each count; (bins..., y)."""
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("f"), F.col(name).alias("b")) for k, name in enumerate(FEATURES)])).alias("c")
    rows = labelled.select("y", cells).groupBy("c.f", "c.b").agg(F.sum("y").alias("good"), F.sum(1 - F.col("y")).alias("bad")).collect()
    good, bad = np.full((len(FEATURES), BINS), 0.5), np.full((len(FEATURES), BINS), 0.5)
    for f, b, g, w in rows:
        good[f, b] += g
        bad[f, b] += w
    return (np.log(good / good.sum(axis=1, keepdims=True)) - np.log(bad / bad.sum(axis=1, keepdims=True))).round(9).tolist()


def evidence(weights: list[list[float]]) -> Column:
    terms = [F.get(F.array(*[F.lit(float(w)) for w in row]), F.col(name)) for row, name in zip(weights, FEATURES, strict=True)]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def slope(labelled: DataFrame, total: Column) -> float:
    """By how much to scale the evidence: logistic regression on its histogram (400 bins at most)."""
    step = F.greatest(F.least(F.round(total * 5), F.lit(200)), F.lit(-200)).cast("int")
    rows = labelled.groupBy(step.alias("s")).agg(F.sum("y").alias("good"), F.count("*").alias("n")).collect()
    x, good, n = (np.array([float(r[k] or 0) for r in rows]) for k in range(3))
    a, w = np.column_stack([x / 5, np.ones(len(x))]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w = w + np.linalg.solve(a.T @ (a * (n * p * (1 - p))[:, None]) + 1e-3 * np.eye(2), a.T @ (good - n * p) - 1e-3 * w)
    return float(min(max(w[0], 0.0), 2.0)) if np.isfinite(w[0]) else 1.0


def prior_weight(sites: DataFrame, parent: Column, most: float) -> float:
    """Weight of a level's prior, by moments: sites (n, good) vary about ``parent`` by chance and by themselves."""
    p = F.col("good") / F.col("n")
    row = sites.filter("n > 1").agg(
        F.sum(F.col("n") * (p - parent) ** 2).alias("spread"),
        F.sum(parent * (1 - parent)).alias("chance"),
        F.sum((F.col("n") - 1) * parent * (1 - parent)).alias("own"),
    ).first()
    if not row["own"]:
        return most
    rho = (row["spread"] - row["chance"]) / row["own"]
    return most if rho <= 1 / (most + 1) else max(1 / rho - 1, 0.5)


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", options: QualityOptions = QualityOptions()) -> DataFrame:
    """One row per row of ``docs``: doc_id, host, path, evidence, host_share, path_share, score, kept.

    ``labels``: doc_id, quality (0 or 1).
    """
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.avg("quality").cast("double").alias("y"))
    facts = binned(docs.select("doc_id", F.col(host).alias("host"), F.col(path).alias("path"), "text")).drop("text")
    facts = stored(facts.join(known, facts["doc_id"] == known["_id"], "left").drop("_id"), "quality-facts")
    labelled = facts.filter("y IS NOT NULL")
    n, good = labelled.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    mean = good / n if n else 0.5
    if not n or good in (0, n):
        flat = facts.withColumn("evidence", F.lit(0.0)).withColumn("host_share", F.lit(float(mean))).withColumn("path_share", F.lit(float(mean)))
        return _judged(flat.withColumn("score", F.lit(float(mean))), options)
    weights = evidence_weights(labelled)
    scale = slope(labelled, evidence(weights))
    hosts = labelled.groupBy("host").agg(F.count("*").alias("n"), F.sum("y").alias("good"))
    by_host = prior_weight(hosts, F.lit(mean), options.most_weight)
    paths = labelled.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("y").alias("good"))
    parents = hosts.select(F.col("host").alias("_h"), ((F.col("good") + by_host * mean) / (F.col("n") + by_host)).alias("_parent"))
    met = paths.join(parents, paths["host"].eqNullSafe(parents["_h"]))
    by_path = prior_weight(met, F.col("_parent"), options.most_weight)
    h = hosts.select(F.col("host").alias("_h"), F.col("n").alias("hn"), F.col("good").alias("hg"))
    p = paths.select(F.col("host").alias("_ph"), F.col("path").alias("_pp"), F.col("n").alias("pn"), F.col("good").alias("pg"))
    placed = facts.join(h, facts["host"].eqNullSafe(h["_h"]), "left").join(p, facts["host"].eqNullSafe(p["_ph"]) & facts["path"].eqNullSafe(p["_pp"]), "left")
    one, own = F.when(F.col("y").isNull(), 0).otherwise(1), F.coalesce("y", F.lit(0.0))
    less = lambda c, x: F.coalesce(F.col(c), F.lit(0)) - x
    host_share = (less("hg", own) + by_host * mean) / (less("hn", one) + by_host)
    path_share = (less("pg", own) + by_path * F.col("host_share")) / (less("pn", one) + by_path)
    scored = placed.withColumn("host_share", host_share).withColumn("path_share", path_share).withColumn("evidence", evidence(weights) * scale)
    logit = F.log(F.col("path_share") / (1 - F.col("path_share"))) + F.col("evidence")
    return _judged(scored.withColumn("score", 1 / (1 + F.exp(-logit))), options)


def _judged(scored: DataFrame, options: QualityOptions) -> DataFrame:
    return scored.select("doc_id", "host", "path", "evidence", "host_share", "path_share", "score", (F.col("score") >= options.threshold).alias("kept"))
