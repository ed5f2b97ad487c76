"""The corpus pipeline: five operators in turn over ``documents``, each stage's rows written and read again.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, in the columns of ``documents``; the last returns
a row for every copy that the mixture takes, with ``mix_copy``.  What a stage decides happens: rejected, repeated and
contaminated documents go, frequent lines and personal data leave the texts, copies are emitted.

Defined cases: a null or empty text fails the quality rules and goes; a document without an id stays in every stage that would
compare ids, and is copied by its text; equal rows of one id are one document to the second stage; columns beside those of
``documents`` pass through, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vulnloom.llm import decontaminate, jaccard_join, mixing, pii, quality_rules
from vulnloom.llm.common import drop_stored, stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines that are frequent in their source."""
    return quality_rules.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group that links of 0.8 connect."""
    return jaccard_join.keep_first(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per copy that the mixture of sources takes."""
    return mixing.mix(docs)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("personal data", personal_data),
    ("source mixing", mixture),
]

#: The similarity join and the loopy inference have no SQL form; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{k}")
            if last is not None:
                drop_stored(last)
            last = docs
    return docs
