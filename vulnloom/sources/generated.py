"""Sinks in generated texts, whose JSON has no fixed shape: read as VARIANT, damaged ones kept apart with a reason.

A text holds one JSON value, perhaps between fences.  Its sinks are the entries of ``sinks`` of an object; of a list, the
entries themselves, or those of the ``sinks`` of each, which then inherit the package and ecosystem that stand beside them.

Defined cases: a text that is null or blank, no JSON, or JSON without a list of sinks is a reject, as is an entry that is no
object; fields of another type than expected count as not given; repeated texts give repeated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def body(text: Column) -> Column:
    """What stands between the first fences of a text, those of JSON before others; without fences the text."""
    cut = lambda mark: F.get(F.split(F.get(F.split(text, mark), F.lit(1)), "```"), F.lit(0))
    return F.trim(F.when(F.contains(text, F.lit("```json")), cut("```json")).when(F.contains(text, F.lit("```")), cut("```")).otherwise(text))


def _kind(value: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(value), r"^\w+", 0)


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is evaluated where it is made, not again wherever it is named."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _parsed(texts: DataFrame) -> DataFrame:
    """``texts`` (vuln_id, package_name, text) with ``_v`` and, where it has one, the list of its sinks."""
    rows = _once(texts.select("vuln_id", "package_name", "text"), "_body", body(F.col("text")))
    rows = _once(rows, "_v", F.try_parse_json(F.nullif("_body", F.lit(""))))
    v = F.col("_v")
    rows = _once(rows, "_kind", _kind(v))
    whole = F.when(F.col("_kind") == "ARRAY", F.try_variant_get(v, "$", "array<variant>")).when(F.col("_kind") == "OBJECT", F.try_variant_get(v, "$.sinks", "array<variant>"))
    return _once(rows, "_list", whole).withColumn("_bare", F.col("_kind") == "ARRAY")


def _items(texts: DataFrame) -> DataFrame:
    """An entry a row: (vuln_id, package_name, seq, item, package, ecosystem), the last two as its batch has them."""
    outer = _parsed(texts).select("vuln_id", "package_name", "_bare", F.posexplode("_list").alias("_i", "_e"))
    inner = F.when(F.col("_bare") & (_kind(F.col("_e")) == "OBJECT"), F.try_variant_get(F.col("_e"), "$.sinks", "array<variant>"))
    outer = _once(outer, "_inner", inner)
    of_batch = lambda path: F.when(F.col("_inner").isNotNull(), F.try_variant_get(F.col("_e"), path, "string"))
    keyed = outer.select("vuln_id", "package_name", "_i", "_e", "_inner", of_batch("$.package").alias("package"), of_batch("$.ecosystem").alias("ecosystem"))
    plain = keyed.filter("_inner IS NULL").select("vuln_id", "package_name", "package", "ecosystem", "_i", F.lit(0).alias("_j"), F.col("_e").alias("item"))
    batch = keyed.filter("_inner IS NOT NULL").select("vuln_id", "package_name", "package", "ecosystem", "_i", F.posexplode("_inner").alias("_j", "item"))
    return plain.unionByName(batch)


def sinks(texts: DataFrame) -> DataFrame:
    """Rows of sinks from ``texts`` (vuln_id, package_name, text), in the columns of ``rules.SINKS`` and ``note``; ``seq`` is
    the place in the text."""
    get = lambda path, kind="string": F.try_variant_get(F.col("item"), path, kind)
    rows = _once(_items(texts), "_of", _kind(F.col("item"))).filter("_of = 'OBJECT'")
    return rows.select(
        "vuln_id",
        F.coalesce(get("$.package_name"), F.col("package"), F.col("package_name")).alias("package_name"),
        F.coalesce(get("$.ecosystem"), F.col("ecosystem"), F.lit("")).alias("ecosystem"),
        get("$.function_name").alias("function_name"),
        get("$.class_name").alias("class_name"),
        get("$.call_pattern").alias("call_pattern"),
        F.coalesce(get("$.sink_type"), F.lit("function_call")).alias("sink_type"),
        F.coalesce(get("$.vuln_type"), get("$.vulnerability_type"), F.lit("")).alias("vuln_type"),
        F.least(F.coalesce(get("$.confidence", "double"), F.lit(0.5)), F.lit(1.0)).alias("confidence"),
        (F.col("_i") * 1000 + F.col("_j")).cast("long").alias("seq"),
        F.coalesce(get("$.note"), get("$.evidence"), F.lit("")).alias("note"),
    )


def rejects(texts: DataFrame) -> DataFrame:
    """(vuln_id, package_name, reason): texts without sinks that can be read, and entries that are none."""
    reason = F.when(F.coalesce(F.col("_body"), F.lit("")) == "", "empty").when(F.col("_v").isNull(), "not JSON").when(F.col("_list").isNull(), "no list of sinks")
    whole = _parsed(texts).select("vuln_id", "package_name", reason.alias("reason")).filter("reason IS NOT NULL")
    entries = _items(texts).filter(F.coalesce(_kind(F.col("item")) != "OBJECT", F.lit(True)))
    return whole.unionByName(entries.select("vuln_id", "package_name", F.lit("entry is no object").alias("reason")))


def coverage(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Per project of ``pairs`` (project, vuln_id): vulnerabilities, those that ``known`` (vuln_id) has sinks for, and the rest."""
    met = pairs.select("project", "vuln_id").distinct().join(known.select("vuln_id").distinct().withColumn("_k", F.lit(True)), "vuln_id", "left")
    return met.groupBy("project").agg(F.count("*").alias("vulnerabilities"), F.count("_k").alias("with_sinks"), F.count_if(F.col("_k").isNull()).alias("missing"))
