"""Writes by key as functions from (old, new) to the table that replaces old.

Without a table format that merges, a write is a rewrite: the caller stores the result under a new path (or, where
tables are partitioned, rewrites only the partitions whose keys changed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _whole(keys: list[str]) -> Column:
    """No part of the key is missing."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).isNotNull()
    return out


def last_wins(old: DataFrame, new: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Per key the row with the largest ``seq``; rows with a null in the key are never the same as another."""
    both = old.unionByName(new, allowMissingColumns=True)
    whole = _whole(keys)
    cols = [c for c in both.columns if c not in keys]
    merged = both.filter(whole).groupBy(*keys).agg(F.max_by(F.struct(*cols), seq).alias("_r")).select(*keys, "_r.*")
    return merged.select(*both.columns).unionByName(both.filter(~whole))


def first_wins(old: DataFrame, new: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """``old`` and those rows of ``new`` whose key is not there yet, the first of each key; keys with a null always enter."""
    whole = _whole(keys)
    fresh = new.filter(whole).join(old.select(*keys), keys, "left_anti")
    cols = [c for c in new.columns if c not in keys]
    fresh = fresh.groupBy(*keys).agg(F.min_by(F.struct(*cols), seq).alias("_r")).select(*keys, "_r.*").select(*new.columns)
    return old.unionByName(fresh, allowMissingColumns=True).unionByName(new.filter(~whole), allowMissingColumns=True)


def not_imported(batch: DataFrame, ledger: DataFrame, key: str = "repo_key") -> DataFrame:
    """The rows of a batch that the import ledger does not name."""
    return batch.join(ledger.select(key).distinct(), key, "left_anti")


def repo_key(metadata_key: Column, full_name: Column, url: Column, name: Column) -> Column:
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(blank(metadata_key), blank(full_name), blank(url), blank(name))


def merge_fields(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both, new fields over old ones where they are given."""
    fields = list(dict.fromkeys([c for c in (*old.columns, *new.columns) if c not in keys]))
    b = new.select(*keys, *[F.col(c).alias(f"new_{c}") for c in new.columns if c not in keys])
    met = old.join(b, keys, "full_outer")
    pick = lambda c: F.coalesce(*[F.col(x) for x in (f"new_{c}", c) if x in met.columns])
    return met.select(*keys, *[pick(c).alias(c) for c in fields])


def unique_items(items: DataFrame, group: list[str], text: str, seq: str) -> DataFrame:
    """The first of each text in its group, whatever its case, in order."""
    first = Window.partitionBy(*group, F.lower(F.trim(text))).orderBy(seq)
    return items.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n").orderBy(*group, seq)


def replace_runs(old: DataFrame, new: DataFrame, key: str = "run_id") -> DataFrame:
    """Rows of runs, those of a run that is recorded again replaced as a whole.

    Stored partitioned by the run, only the new runs' partitions are written; here the whole table is returned.
    """
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new, allowMissingColumns=True)


def scan_totals(scans: DataFrame, components: DataFrame, affected: DataFrame) -> DataFrame:
    """Per scan of ``scans`` (project, scan_id): listed components, those with a vulnerability, and vulnerability links.

    ``components`` (scan_id, component_id), ``affected`` (component_id, vuln).
    """
    links = affected.groupBy("component_id").agg(F.count("*").alias("n"))
    met = scans.select("project", "scan_id").join(components.select("scan_id", "component_id").distinct(), "scan_id").join(links, "component_id", "left")
    return met.groupBy("project", "scan_id").agg(F.count("*").alias("total_components"), F.count("n").alias("vulnerable_components"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_vulnerabilities"))


def summary_totals(summaries: DataFrame) -> DataFrame:
    """One row over merged summaries: projects, those with vulnerabilities, and sums."""
    return summaries.agg(
        F.count("*").alias("projects"), F.count_if(F.col("vulnerable_components") > 0).alias("with_vulnerabilities"),
        F.coalesce(F.sum("vulnerable_components"), F.lit(0)).alias("vulnerable_components"), F.coalesce(F.sum("total_vulnerabilities"), F.lit(0)).alias("vulnerabilities"),
    )


def edges_upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Edges of both without repeats: an edge that is there stays as it is."""
    return old.select(*keys).unionByName(new.select(*keys)).distinct()
