"""CycloneDX documents as typed frames, and the graph tables they fill.

One document is one row: files are read whole (``multiLine``) under an explicit schema, so nothing is inferred, and
every list is exploded in the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnloom.functions import exprs as X
from vulnloom.operators import paths

PROPERTY = "array<struct<name:string,value:string>>"
COMPONENT = "struct<`bom-ref`:string,name:string,version:string,purl:string,type:string,`group`:string,description:string,scope:string,evidence:struct<occurrences:array<struct<location:string>>>>"
SCHEMA = f"serialNumber string, metadata struct<timestamp:string,component:{COMPONENT},properties:{PROPERTY}>, components array<{COMPONENT}>, dependencies array<struct<ref:string,dependsOn:array<string>>>"

#: Properties that may hold the branch, in no order of preference.
BRANCHES = ("git.branch", "org.cyclonedx.git.branch", "repo.branch")


def read_sboms(spark: SparkSession, path: str) -> DataFrame:
    """Documents under ``path`` with their file name."""
    return spark.read.schema(SCHEMA).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_path"))


def metadata(docs: DataFrame, project: str = "project") -> DataFrame:
    """(scan_id, project, generated_at, branch, root): the scan is the serial number, else project and time."""
    branch = F.get(F.filter("metadata.properties", lambda p: p["name"].isin(*BRANCHES)), F.lit(0))["value"]
    scan = F.coalesce(F.nullif("serialNumber", F.lit("")), F.concat_ws("::", F.col(project), F.col("metadata.timestamp")))
    return docs.select(scan.alias("scan_id"), F.col(project).alias("project"), F.col("metadata.timestamp").alias("generated_at"), branch.alias("branch"), F.col("metadata.component.bom-ref").alias("root"))


def _scanned(docs: DataFrame) -> DataFrame:
    return docs.withColumn("scan_id", F.coalesce(F.nullif("serialNumber", F.lit("")), F.concat_ws("::", F.col("project"), F.col("metadata.timestamp"))))


def components(docs: DataFrame) -> DataFrame:
    """One row per listed component, with its identity and package ids."""
    rows = _scanned(docs).select("scan_id", F.explode("components").alias("c"))
    c = lambda n: F.col(f"c.{n}")
    identity = X.component_identity(c("purl"), F.col("c.bom-ref"), c("name"), c("version"))
    package = X.component_identity(c("purl"), F.lit(None).cast("string"), c("name"), c("version"))
    return rows.select(
        "scan_id", F.col("c.bom-ref").alias("bom_ref"), identity.alias("component_id"), package.alias("package_id"), c("name").alias("name"), c("version").alias("version"), c("purl").alias("purl"),
        X.ecosystem(c("purl")).alias("ecosystem"), X.package_manager(c("purl")).alias("package_manager"), c("type").alias("type"), c("group").alias("group"), c("scope").alias("scope"),
    )


def dependencies(docs: DataFrame) -> DataFrame:
    """(scan_id, src, dst) by bom-ref; entries without a ref are skipped, of repeated refs the last counts."""
    entries = _scanned(docs).select("scan_id", F.posexplode("dependencies").alias("pos", "d")).filter("d.ref IS NOT NULL AND d.ref <> ''")
    last = entries.groupBy("scan_id", F.col("d.ref").alias("src")).agg(F.max_by("d.dependsOn", "pos").alias("to"))
    return last.select("scan_id", "src", F.explode("to").alias("dst")).distinct()


def occurrences(docs: DataFrame) -> DataFrame:
    """(scan_id, bom_ref, path, line): where components are declared, from ``path#line``; empty paths are dropped."""
    rows = _scanned(docs).select("scan_id", F.explode("components").alias("c")).select("scan_id", F.col("c.bom-ref").alias("bom_ref"), F.explode("c.evidence.occurrences.location").alias("at"))
    parts = F.split("at", "#")
    return rows.select("scan_id", "bom_ref", F.get(parts, F.lit(0)).alias("path"), F.get(parts, F.lit(1)).try_cast("int").alias("line")).filter("path <> ''")


def graph_tables(docs: DataFrame) -> dict[str, DataFrame]:
    """The node and edge tables of ``docs`` (with a ``project`` column)."""
    scans, comps, links = metadata(docs), components(docs), dependencies(docs)
    roots = scans.filter("root IS NOT NULL").select("scan_id", "root")
    depth = paths.depths(links, roots)
    direct = paths.direct_dependencies(links, roots).withColumn("is_direct", F.lit(True))
    ids = comps.select("scan_id", F.col("bom_ref").alias("node"), "component_id").distinct()
    has = ids.join(depth, ["scan_id", "node"], "left").join(direct, ["scan_id", "node"], "left")
    resolved = links.join(ids.select("scan_id", F.col("node").alias("src"), F.col("component_id").alias("src_id")), ["scan_id", "src"]).join(ids.select("scan_id", F.col("node").alias("dst"), F.col("component_id").alias("dst_id")), ["scan_id", "dst"])
    return {
        "sboms": scans.drop("root"),
        "components": comps,
        "has_component": has.groupBy("scan_id", "component_id").agg(F.min("depth").alias("depth"), F.coalesce(F.bool_or("is_direct"), F.lit(False)).alias("is_direct")),
        "depends_on": resolved.select("scan_id", F.col("src_id").alias("src"), F.col("dst_id").alias("dst")).distinct(),
        "declared_in": occurrences(docs).join(ids.withColumnRenamed("node", "bom_ref"), ["scan_id", "bom_ref"]).select("scan_id", "component_id", "path", "line").distinct(),
    }
