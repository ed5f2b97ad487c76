"""What the corpus operators share: word patterns, array expressions, and tables in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnloom.sources.shared import drop_stored, shared_dir, shared_path, stored

__all__ = ["SPACES", "SPACE_RUN", "aside", "batches_of", "crc_mod", "drop_stored", "let", "passing", "running", "shared_dir", "shared_path", "stored", "table", "word_count", "words"]

#: The six characters that separate words, and a run of them.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[ \t\n\x0B\f\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is executed inside sends Python batches of at most ``rows`` rows: a batch is held whole on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def words(text: Column) -> Column:
    """Array of the words of a text (null: none).  Words are runs of anything but SPACES."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value evaluated once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def running(values: Column, op: Callable[[Column, Column], Column] | None = None, chunk: int = 256) -> Column:
    """Running sums of an array of longs (or what ``op`` makes of two).  An array that grows by one is copied each time, so
    chunks are run by themselves and then shifted by what came before them."""
    op = op or (lambda a, b: a + b)
    last = lambda a: F.element_at(a, -1)

    def plain(a: Column) -> Column:
        begun = F.slice(a, 1, 1)
        return F.aggregate(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), begun, lambda s, x: F.concat(s, F.array(op(last(s), x))))

    cut = lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / chunk).cast("int")), lambda i: plain(F.slice(a, i * chunk + 1, chunk)))
    before = lambda parts: F.concat(F.array(F.lit(None).cast("long")), let(F.transform(parts, last), plain))
    shifted = lambda parts: F.zip_with(parts, F.slice(before(parts), 1, F.size(parts)), lambda p, o: F.when(o.isNull(), p).otherwise(F.transform(p, lambda x: op(o, x))))
    return let(values, lambda a: F.when(F.size(a) <= chunk, plain(a)).otherwise(F.flatten(let(cut(a), shifted))))


def passing(df: DataFrame, condition: Column) -> DataFrame:
    """``df.filter(condition)``, evaluated above the columns it names instead of with copies of their expressions."""
    return df.withColumn("_row", F.monotonically_increasing_id()).filter(condition & (F.col("_row") >= 0)).drop("_row")


def aside(df: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns of these names renamed, and the names to rename back, for operators that use them inside."""
    taken = {f"_aside_{c}": c for c in df.columns if c.lower() in names}
    return df.withColumnsRenamed({c: k for k, c in taken.items()}), taken


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n (null id: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n
