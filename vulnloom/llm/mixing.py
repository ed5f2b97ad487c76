"""Mixing sources to target weights.

Tokens are summed per source, target sizes follow from weights and a repetition ceiling, and every document
is emitted floor(rate) times plus one hash-seeded Bernoulli copy whose probability is the rate's fraction.

Plan: one pre-aggregated group-by over sources (so a source with a third of all rows costs one partial row a
task), a window over the sources alone, and a join of that summary back to the documents.  The summary is a stored
table, so the join knows its size: where it is small no document is shuffled.

Defined cases: a null source is a source of its own and the last in order; a null or empty text has size 0 and
is taken with its source's rate (it adds no words); a source whose size is 0 has target 0 and rate 0; rows that
repeat an id get the same draw, rows without one are drawn by their text; an empty table gives an empty result; other columns pass through ``mix``, but a
column named ``mix_copy`` is replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vulnloom.llm.common import aside, stored, word_count

WEIGHTS = (5.0, 2.0, 1.0)
CEILING = 3.0
ADDED = ("mix_size", "mix_source", "mix_source_size", "mix_target", "mix_copies")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, ceiling: float = CEILING) -> DataFrame:
    """(source, source_size, target) from one row per (source, source_size).

    Sources in code-point order (null last) get ``weights`` in turn.  Targets are min(ceiling * size, level * weight)
    with the one level at which they sum to the sum of all sizes: what resharing the excess by weight ends in.
    ``sizes`` has a row per source, a dimension that one task orders.
    """
    everything = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("rank", F.row_number().over(everything) - 1)
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights)).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(ceiling)))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # The level if exactly the sources before this one stop at their ceiling; the first that fits is the one.
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    leveled = ranked.withColumn("level", level)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    leveled = leveled.withColumn("level", F.first(fits, ignorenulls=True).over(whole))
    target = F.when(F.col("source_size") == 0, 0.0).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    return leveled.select("source", "source_size", target.alias("target"))


def draw(doc_id: Column, seed: int, text: Column | None = None) -> Column:
    """A number in [0, 1) that depends on the id (without one, on the text) and the seed alone (52 bits of an MD5 digest)."""
    spare = F.lit("") if text is None else F.concat(F.lit("-"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), spare)).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def assign_copies(docs: DataFrame, weights: Sequence[float] = WEIGHTS, ceiling: float = CEILING, seed: int = 17) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with mix_size, mix_source_size, mix_target and mix_copies added (or replaced)."""
    docs = docs.drop(*ADDED)
    sized = docs.withColumn("mix_size", word_count(docs["text"]))
    totals = sized.groupBy("source").agg(F.sum("mix_size").alias("source_size"))
    targets = source_targets(totals, weights, ceiling).select(
        F.col("source").alias("mix_source"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target")
    )
    targets = stored(targets, "mix-targets")
    joined = sized.join(targets, sized["source"].eqNullSafe(targets["mix_source"]), "left").drop("mix_source")
    rate = F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(0.0)
    whole = F.floor(rate)
    return joined.withColumn("mix_copies", whole + (draw(joined["doc_id"], seed, joined["text"]) < rate - whole).cast("long"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, ceiling: float = CEILING, seed: int = 17) -> DataFrame:
    """The mixed corpus: each document's columns once per copy, with ``mix_copy`` from 0."""
    columns = [c for c in docs.columns if c.lower() != "mix_copy"]
    docs, back = aside(docs.select(*columns), *ADDED)
    taken = assign_copies(docs, weights, ceiling, seed).filter("mix_copies > 0")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("mix_copies") - 1))
    copied = taken.select(*docs.columns, copies.alias("mix_copy"))
    return copied.withColumnsRenamed(back)
