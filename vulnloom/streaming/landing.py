"""Documents that land in a folder, imported once each as a stream.

``foreachBatch`` turns each micro-batch into rows of the graph tables.  The checkpoint makes a repeated batch have the same
files, and rows lie under the batch's number, so a batch that runs again overwrites its own partition instead of adding to it.

Guarded by the ledger (``once``), a project that an earlier batch imported is passed over, as is a second document of a project
within a batch (the first by time, then by scan, counts).  The ledger is a table that the sink itself writes, last of all and
under the batch's number: a batch that is repeated looks at the numbers before its own only, so it decides as it did before,
after a restart too.

Each batch also leaves the totals of its scans.  They are states that merge: totals over everything are those of each scan's
last batch, so a scan that lands again takes its old part back, and nothing is counted anew.

Defined cases: documents without a project or without components are imported by nobody and not named in the ledger; an empty
batch writes nothing; clearing makes earlier batches, and the ledger of them, count no more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vulnloom.sources import sbom

LEDGER, TOTALS, CLEARED = "ledger", "totals", "cleared"
_SCHEMAS = {LEDGER: "repo_key string", CLEARED: "by string", TOTALS: "scan_id string, project string, generated_at string, components long, direct long, deepest long, dependencies long, places long"}


def _read(spark: SparkSession, target: str, name: str) -> DataFrame | None:
    """A table under ``target`` with its batch numbers; None if nothing was written to it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{name}")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    reader = spark.read.schema(f"{_SCHEMAS[name]}, batch long") if name in _SCHEMAS else spark.read
    return reader.parquet(f"{target}/{name}")


def _cleared(spark: SparkSession, target: str) -> int:
    marks = _read(spark, target, CLEARED)
    last = marks.agg(F.max("batch")).first()[0] if marks is not None else None
    return -1 if last is None else last


def unseen(docs: DataFrame, ledger: DataFrame | None, number: int, cleared: int = -1) -> DataFrame:
    """Of the documents (with ``project``), the first of each project that no batch before ``number`` imported."""
    sound = docs.filter(F.col("project").isNotNull() & (F.size("components") > 0))
    if ledger is not None:
        before = ledger.filter((F.col("batch") < number) & (F.col("batch") > cleared)).select(F.col("repo_key").alias("project"))
        sound = sound.join(before, "project", "left_anti")
    # Whole documents are sorted here, so those of projects that are passed over are left out before.
    order = F.struct(F.col("metadata.timestamp").alias("t"), F.col("serialNumber").alias("s"))
    rest = [c for c in docs.columns if c != "project"]
    return sound.groupBy("project").agg(F.min_by(F.struct(*rest), order).alias("d")).select("project", "d.*").select(*docs.columns)


def scan_states(tables: dict[str, DataFrame]) -> DataFrame:
    """Totals of each scan, in a form that adds up over scans."""
    parts = tables["has_component"].groupBy("scan_id").agg(F.count("*").alias("components"), F.count_if("is_direct").alias("direct"), F.max("depth").cast("long").alias("deepest"))
    links = tables["depends_on"].groupBy("scan_id").agg(F.count("*").alias("dependencies"))
    places = tables["declared_in"].groupBy("scan_id").agg(F.count("*").alias("places"))
    met = tables["sboms"].select("scan_id", "project", "generated_at").join(parts, "scan_id", "left").join(links, "scan_id", "left").join(places, "scan_id", "left")
    return met.na.fill(0, ["components", "direct", "dependencies", "places"])


def write_batch(batch: DataFrame, number: int, target: str, once: bool = False) -> None:
    """Writes one micro-batch; doing it again changes nothing."""
    spark = batch.sparkSession
    if once:
        batch = unseen(batch, _read(spark, target, LEDGER), number, _cleared(spark, target))
    batch = batch.persist()
    try:
        if batch.isEmpty():
            return
        tables = sbom.graph_tables(batch)
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{target}/{name}/batch={number}")
        written = {name: spark.read.schema(df.schema).parquet(f"{target}/{name}/batch={number}") for name, df in tables.items()}
        scan_states(written).write.mode("overwrite").parquet(f"{target}/{TOTALS}/batch={number}")
        batch.select(F.col("project").alias("repo_key")).filter("repo_key IS NOT NULL").distinct().write.mode("overwrite").parquet(f"{target}/{LEDGER}/batch={number}")
    finally:
        batch.unpersist()


def land(spark: SparkSession, folder: str, target: str, checkpoint: str, files_per_batch: int = 1000, once: bool = False) -> StreamingQuery:
    """Imports what is new in ``folder`` (sub-folders named project=NAME) into the graph tables under ``target``, then ends."""
    docs = spark.readStream.schema(f"{sbom.SCHEMA}, project string").option("multiLine", True).option("maxFilesPerTrigger", files_per_batch).json(folder)
    return docs.writeStream.foreachBatch(lambda batch, number: write_batch(batch, number, target, once)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _last(spark: SparkSession, target: str, name: str) -> DataFrame:
    rows = _read(spark, target, name)
    rows = rows.filter(F.col("batch") > _cleared(spark, target))
    last = rows.groupBy("scan_id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["scan_id", "batch"], "left_semi").drop("batch")


def imported(spark: SparkSession, target: str, name: str) -> DataFrame:
    """All rows imported so far; a scan that landed again counts by its last batch."""
    return _last(spark, target, name)


def ledger(spark: SparkSession, target: str) -> DataFrame:
    """(repo_key) of all projects imported since the last clearing."""
    rows = _read(spark, target, LEDGER)
    if rows is None:
        return spark.createDataFrame([], _SCHEMAS[LEDGER])
    return rows.filter(F.col("batch") > _cleared(spark, target)).select("repo_key").distinct()


def totals(spark: SparkSession, target: str) -> DataFrame:
    """Per project: scans, components, direct ones, dependencies, places, and the deepest component, from states alone."""
    states = _last(spark, target, TOTALS)
    sums = [F.sum(c).alias(c) for c in ("components", "direct", "dependencies", "places")]
    return states.groupBy("project").agg(F.count("*").alias("scans"), *sums, F.max("deepest").alias("deepest"))


def clear(spark: SparkSession, target: str) -> None:
    """Nothing imported so far counts any more, and every project may be imported again."""
    rows = _read(spark, target, LEDGER)
    last = rows.agg(F.max("batch")).first()[0] if rows is not None else None
    if last is not None:
        spark.createDataFrame([("clear",)], _SCHEMAS[CLEARED]).write.mode("overwrite").parquet(f"{target}/{CLEARED}/batch={last}")


def listed_files(summaries: DataFrame) -> DataFrame:
    """(vulnerability_file) of import summaries (``results`` with a vulnerability_file each): the files an import reads."""
    named = summaries.select(F.explode("results").alias("r")).select(F.trim("r.vulnerability_file").alias("vulnerability_file"))
    return named.filter("vulnerability_file <> ''").distinct()


def import_list(files: DataFrame, done: DataFrame) -> DataFrame:
    """Of the files' contents (``repo`` with its names, ``sbom_file``), those whose repository the ledger does not name.

    ``files`` (file, repo, sbom_file) as read from ``listed_files``; repositories are known by their metadata key, else by
    full name, address or name.  Of several files of one repository the first by name counts.
    """
    from vulnloom.operators.upserts import not_imported, repo_key

    r = lambda c: F.col(f"repo.{c}")
    keyed = files.withColumn("repo_key", repo_key(r("metadata_key"), r("full_name"), r("url"), r("name"))).filter("repo_key IS NOT NULL")
    first = keyed.groupBy("repo_key").agg(F.min_by(F.struct("file", "sbom_file"), "file").alias("f")).select("repo_key", "f.*")
    return not_imported(first, done)
