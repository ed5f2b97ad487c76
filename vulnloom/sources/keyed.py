"""Tables that are merged by key, where an upsert reads and rewrites only what its keys touch.

A table is partitioned into slices (a hash of the key) and bucketed by the key within them.  An upsert tells the slices of its
rows, at most ``slices`` numbers; the old side of the merge is a scan of those slices alone that comes bucketed by the key, so
it is neither shuffled nor sorted by anything else, and only the new rows move.  The result overwrites these slices dynamically:
Spark writes to a staging folder and moves partitions in when all tasks have succeeded, other slices keep their files.

Defined cases: rows of either side with a null in the key are equal to none, so they stay and are added; of new rows with the
same key the one with the largest ``seq`` counts (without ``seq`` a key must be unique); columns that the table does not have
are left out, those that new rows do not have count as not given; an upsert without rows writes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnloom.sources.shared import drop_stored, shared_path

SLICE = "slice"


@dataclass(frozen=True)
class KeyedTable:
    name: str
    path: str
    keys: tuple[str, ...]
    slices: int

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.name).drop(SLICE)

    def slice_of(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k) for k in self.keys]), F.lit(self.slices)).cast("int")


def create(rows: DataFrame, keys: list[str], slices: int = 64, buckets: int = 8, name: str | None = None, path: str | None = None) -> KeyedTable:
    """A keyed table of ``rows`` (one a key), by default in the shared folder."""
    spark = rows.sparkSession
    name = name or f"keyed_{uuid.uuid4().hex}"
    table = KeyedTable(name, path or shared_path(spark, name), tuple(keys), slices)
    cut = rows.withColumn(SLICE, table.slice_of()).repartition(buckets, *keys)
    cut.write.format("parquet").partitionBy(SLICE).bucketBy(buckets, *keys).sortBy(*keys).option("path", table.path).saveAsTable(name)
    return table


def attach(spark: SparkSession, path: str, schema: str, keys: list[str], slices: int = 64, buckets: int = 8, name: str | None = None) -> KeyedTable:
    """The table that ``create`` wrote to ``path``, for a session that does not know it; the numbers must be the same."""
    name = name or f"keyed_{uuid.uuid4().hex}"
    by = ", ".join(keys)
    spark.sql(f"CREATE TABLE {name} ({schema}, {SLICE} INT) USING parquet PARTITIONED BY ({SLICE}) CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'")
    spark.catalog.recoverPartitions(name)
    return KeyedTable(name, path, tuple(keys), slices)


Field = Callable[[str, Column, Column, Column], Column]


def replacing(field: str, old: Column, new: Column, there: Column) -> Column:
    """New rows replace old ones whole."""
    return F.when(there, new).otherwise(old)


def keeping(field: str, old: Column, new: Column, there: Column) -> Column:
    """Given fields replace, others keep what is stored."""
    return F.coalesce(new, old)


def first_stays(field: str, old: Column, new: Column, there: Column) -> Column:
    """An old row stays as it is."""
    return F.when(F.col("_was"), old).otherwise(new)


def merged(table: KeyedTable, new: DataFrame, field: Field, touched: list[int]) -> DataFrame:
    """The rows of the touched slices after the merge."""
    spark = new.sparkSession
    keys = list(table.keys)
    old = spark.table(table.name).filter(F.col(SLICE).isin(touched))
    fields = [c for c in old.columns if c not in (*keys, SLICE)]
    given = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in fields if c in new.columns], F.lit(True).alias("_there"))
    met = old.drop(SLICE).withColumn("_was", F.lit(True)).join(given, keys, "full_outer").withColumns({"_was": F.coalesce("_was", F.lit(False)), "_there": F.coalesce("_there", F.lit(False))})
    pick = lambda c: field(c, F.col(c), F.col(f"_new_{c}") if f"_new_{c}" in met.columns else F.lit(None), F.col("_there"))
    types = dict(old.dtypes)
    return met.select(*keys, *[pick(c).cast(types[c]).alias(c) for c in fields], table.slice_of().alias(SLICE)).select(*old.columns)


def upsert(table: KeyedTable, new: DataFrame, field: Field = replacing, seq: str | None = None) -> list[int]:
    """Merges ``new`` into the table; returns the slices that were written."""
    spark, keys = new.sparkSession, list(table.keys)
    if seq is not None:
        rest = [c for c in new.columns if c not in keys]
        whole = F.lit(True)
        for k in keys:
            whole = whole & F.col(k).isNotNull()
        last = new.filter(whole).groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_r")).select(*keys, "_r.*")
        new = last.select(*new.columns).unionByName(new.filter(~whole))
    path = shared_path(spark, "upsert")
    new.write.parquet(path)
    # Overwriting partitions that are read is a setting of a session for tables, so the write has a session of its own.
    apart = spark.newSession()
    apart.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    new = apart.read.schema(new.schema).parquet(path)
    touched = sorted(r[0] for r in new.select(table.slice_of()).distinct().collect())
    if touched:
        merged(table, new, field, touched).write.insertInto(table.name, overwrite=True)
        spark.catalog.refreshTable(table.name)
    drop_stored(new)
    return touched
