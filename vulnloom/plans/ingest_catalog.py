"""Queries over ingestion: documents and advisory records made from the test tables as JSON texts, and what is read back.

The records go through text under the same explicit schemas as landed files do, so each query shows that the graph tables
that documents fill are those that the documents were made from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnloom.functions import exprs as X
from vulnloom.operators import alerts
from vulnloom.plans import oracle as O
from vulnloom.plans.catalog import flat, register
from vulnloom.sources import advisories, sbom
from vulnloom.sources.testbed import Graph

# --- documents ----------------------------------------------------------------------------------------------------


def _documents(g: Graph) -> DataFrame:
    """One document per latest scan, through JSON text."""
    scans = alerts.latest_sboms(g.sboms)
    wanted = scans.select("scan_id")
    places = g.declared_in.groupBy("scan_id", "component_id").agg(F.collect_set(F.struct(F.concat_ws("#", "path", F.col("line").cast("string")).alias("location"))).alias("occurrences"))
    listed = g.has_component.join(wanted, "scan_id", "left_semi").join(g.components, "component_id").join(places, ["scan_id", "component_id"], "left")
    component = F.struct(F.col("component_id").alias("bom-ref"), "name", "version", F.col("component_id").alias("purl"), F.lit("library").alias("type"), "scope", F.struct("occurrences").alias("evidence"))
    components = listed.groupBy("scan_id").agg(F.collect_list(component).alias("components"), F.min(F.when(F.col("is_direct"), F.col("component_id"))).alias("root"))
    links = g.depends_on.join(wanted, "scan_id", "left_semi").groupBy("scan_id", "src").agg(F.collect_set("dst").alias("dst"))
    # A repeated entry, of which the last counts, and one without a reference are put in.
    entries = F.concat(F.array(F.struct(F.lit("").alias("ref"), F.array(F.lit("nowhere")).alias("dependsOn"))), F.collect_list(F.struct(F.col("src").alias("ref"), F.array(F.lit("stale")).alias("dependsOn"))), F.collect_list(F.struct(F.col("src").alias("ref"), F.col("dst").alias("dependsOn"))))
    dependencies = links.groupBy("scan_id").agg(entries.alias("dependencies"))
    met = scans.join(components, "scan_id", "left").join(dependencies, "scan_id", "left")
    properties = F.array(F.struct(F.lit("tool").alias("name"), F.lit("x").alias("value")), F.struct(F.lit("repo.branch").alias("name"), F.col("branch").alias("value")))
    # Every third document has no serial number: its scan is named by project and time.
    serial = F.when(F.expr("CAST(scan_id AS BIGINT) % 3 <> 0"), F.col("scan_id"))
    metadata = F.struct(F.col("generated_at").alias("timestamp"), F.struct(F.col("root").alias("bom-ref")).alias("component"), properties.alias("properties"))
    text = met.select("project", F.to_json(F.struct(serial.alias("serialNumber"), metadata.alias("metadata"), "components", "dependencies")).alias("text"))
    return text.select("project", F.from_json("text", sbom.SCHEMA).alias("d")).select("project", "d.*")


def _table(name: str):  # noqa: ANN202
    return lambda g: sbom.graph_tables(_documents(g))[name]


SCAN = "CASE WHEN CAST({0}.scan_id AS BIGINT) % 3 <> 0 THEN {0}.scan_id ELSE l.project || '::' || l.generated_at END"
KIND = "split_part(substr(c.component_id, 5), '/', 1)"
register("ingest_scans", lambda g: sbom.metadata(_documents(g)).drop("root"), O.over(f"SELECT {SCAN.format('l')} AS scan_id, project, generated_at, branch FROM latest l"))
register(
    "ingest_components",
    lambda g: sbom.components(_documents(g)).select("scan_id", "component_id", "package_id", "name", "version", "ecosystem", "package_manager", "scope", "type"),
    O.over(f"""SELECT {SCAN.format('l')} AS scan_id, c.component_id, c.component_id AS package_id, name, version, CASE {KIND} WHEN 'golang' THEN 'go' ELSE {KIND} END AS ecosystem,
  CASE {KIND} WHEN 'pypi' THEN 'pip' WHEN 'golang' THEN 'go' ELSE {KIND} END AS package_manager, scope, 'library' AS type FROM latest l JOIN has_component h USING (scan_id) JOIN components c USING (component_id)"""),
)
register("ingest_dependencies", _table("depends_on"), O.over(f"SELECT DISTINCT {SCAN.format('l')} AS scan_id, src, dst FROM latest l JOIN depends_on d USING (scan_id)"))
register("ingest_places", _table("declared_in"), O.over(f"SELECT DISTINCT {SCAN.format('l')} AS scan_id, component_id, path, CAST(line AS INT) AS line FROM latest l JOIN declared_in d USING (scan_id)"))
register(
    "ingest_depths",
    _table("has_component"),
    O.over(
        f"""SELECT {SCAN.format('l')} AS scan_id, h.component_id, d.depth, x.node IS NOT NULL AS is_direct FROM latest l JOIN has_component h USING (scan_id)
LEFT JOIN depths d ON d.scan_id = h.scan_id AND d.node = h.component_id LEFT JOIN direct x ON x.scan_id = h.scan_id AND x.node = h.component_id""",
        O.BASE + "," + O.DEPTHS_SQL,
        True,
    ),
)

# --- advisories ---------------------------------------------------------------------------------------------------


def _through_json(df: DataFrame, schema: str) -> DataFrame:
    return df.select(F.from_json(F.to_json(F.struct("*")), schema).alias("r")).select("r.*")


def _records(g: Graph) -> DataFrame:
    """Advisory records with their ranges, through JSON text; of two fixed versions the second is only known as affected."""
    event = lambda v, k: F.struct(F.when(k % 2 == 0, v).alias("fixed"), F.when(k % 2 == 1, v).alias("last_affected"))
    events = F.transform("fix_versions", event)
    ranges = F.array(F.struct(F.lit("GIT").alias("type"), F.concat(F.lit("https://h/o/"), "id", F.lit(".git")).alias("repo"), events.alias("events")))
    key = F.expr("CAST(substr(id, 6) AS BIGINT)")
    package = F.when(key % 4 != 0, F.struct(F.concat(F.lit("lib-"), key.cast("string")).alias("name"), F.when(key % 4 == 1, "PyPI").when(key % 4 == 2, "crates.io").otherwise("Go:1.2").alias("ecosystem")))
    specific = F.struct(F.array(F.concat(F.lit("mod.sub:run_"), key.cast("string")), F.lit("plain")).alias("affected_functions"))
    kinds = [("FIX", 5), ("WEB", 1), ("REPORT", 3)]
    references = F.array(*[F.struct(F.lit(kind).alias("type"), F.concat(F.lit("http://h/" if (kind, k) == ("FIX", 1) else "https://h/"), "id", F.lit(f"/{kind}/{k}")).alias("url")) for kind, n in kinds for k in range(n)])
    made = g.vulns.select(
        "id", F.when(key % 3 != 0, F.col("summary")).alias("summary"), F.lit("details").alias("details"), "published", "modified", F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.array(F.lit("X-1"))).alias("aliases"),
        F.array(F.struct(F.col("cvss").cast("string").alias("score"))).alias("severity"), F.array(F.struct(package.alias("package"), ranges.alias("ranges"), specific.alias("ecosystem_specific"))).alias("affected"), references.alias("references"),
    )
    return _through_json(made, advisories.ADVISORY)


KEY = "CAST(substr(id, 6) AS BIGINT)"
register(
    "ingest_advisories",
    lambda g: flat(advisories.details(_records(g)), ("severity_vectors",)),
    O.over(f"""SELECT id, CASE WHEN {KEY} % 3 <> 0 THEN summary ELSE 'details' END AS detail_summary, published, modified, CAST(NULL AS VARCHAR) AS withdrawn,
  array_to_string(list_sort(list_concat(coalesce(aliases, CAST([] AS VARCHAR[])), ['X-1'])), '|') AS aliases, coalesce(CAST(cvss AS VARCHAR), '') AS severity_vectors,
  array_to_string(list_sort(list_distinct(fix_versions)), '|') AS fix_versions, coalesce(array_to_string(aliases, '|'), '') AS cve_ids FROM vulns"""),
)
register(
    "ingest_packages",
    lambda g: advisories.package_name(_records(g)),
    O.over(f"SELECT id, CASE WHEN {KEY} % 4 <> 0 THEN 'lib-' || {KEY} ELSE id END AS package_name FROM vulns"),
)
register(
    "ingest_functions",
    lambda g: advisories.listed_functions(_records(g)).filter("package_name IS NOT NULL"),
    O.over(f"""SELECT id AS vuln_id, 'lib-' || {KEY} AS package_name, CASE {KEY} % 4 WHEN 1 THEN 'pypi' WHEN 2 THEN 'cargo' ELSE 'go' END AS ecosystem, name AS function_name, CAST(seq AS BIGINT) AS seq
FROM (SELECT *, unnest(['run_' || {KEY}, 'plain']) AS name, unnest([0, 1]) AS seq FROM vulns) WHERE {KEY} % 4 <> 0"""),
)
register(
    "ingest_references",
    lambda g: advisories.followed_references(_records(g)).select("id", "type", "url", "host"),
    O.over("""SELECT id, type, 'https://h/' || id || '/' || type || '/' || k AS url, 'h' AS host FROM vulns, (VALUES ('FIX', 0), ('FIX', 2), ('REPORT', 0), ('REPORT', 1)) AS t(type, k)"""),
)


def _by_cve(g: Graph) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scores, exploit probabilities and known exploitation of every CVE id of the test tables."""
    cves = g.vulns.select(F.explode("aliases").alias("cve_id")).distinct().withColumn("k", F.expr("CAST(substr(cve_id, 10) AS BIGINT)"))
    metric = lambda when, score: F.when(when, F.array(F.struct(F.struct(score.alias("baseScore"), F.lit("HIGH").alias("baseSeverity")).alias("cvssData"))))
    score = F.col("k") % 100 / F.lit(10.0)
    metrics = F.struct(metric(F.col("k") % 3 == 0, score).alias("cvssMetricV31"), metric(F.col("k") % 3 != 2, F.lit(1.5)).alias("cvssMetricV2"))
    weak = F.array(F.struct(F.array(F.struct(F.concat(F.lit("CWE-"), (F.col("k") % 50).cast("string")).alias("value")), F.struct(F.lit("noinfo").alias("value"))).alias("description")))
    nvd = _through_json(cves.select("cve_id", metrics.alias("metrics"), weak.alias("weaknesses")), advisories.NVD)
    epss = cves.filter("k % 4 <> 0").select("cve_id", (F.col("k") % 7 / F.lit(8.0)).alias("epss"), (F.col("k") % 9 / F.lit(16.0)).alias("percentile"))
    return nvd, epss, cves.filter("k % 5 = 0").select("cve_id")


def _enriched(g: Graph) -> DataFrame:
    rows = advisories.enrich(advisories.details(_records(g)).select("id", "cve_ids"), *_by_cve(g))
    return rows.select("id", "epss", "epss_percentile", "kev", "cvss_score", "cvss_severity", X.joined(F.col("cwe")).alias("cwe"))


register(
    "ingest_enriched",
    _enriched,
    O.over("""SELECT id, CASE WHEN k % 4 <> 0 THEN k % 7 / 8.0::DOUBLE END AS epss, CASE WHEN k % 4 <> 0 THEN k % 9 / 16.0::DOUBLE END AS epss_percentile, coalesce(k % 5 = 0, false) AS kev,
  CASE k % 3 WHEN 0 THEN k % 100 / 10.0::DOUBLE WHEN 1 THEN 1.5::DOUBLE END AS cvss_score, CASE WHEN k % 3 <> 2 THEN 'HIGH' END AS cvss_severity, coalesce('CWE-' || (k % 50), '') AS cwe
FROM (SELECT id, CAST(substr(aliases[1], 10) AS BIGINT) AS k FROM vulns)"""),
)
register(
    "ingest_affected",
    lambda g: advisories.attach(sbom.components(_documents(g)), g.affected_by.select(F.col("component_id").alias("purl"), F.col("vuln").alias("vuln_id"))),
    O.over("SELECT DISTINCT a.component_id, a.vuln FROM affected_by a WHERE component_id IN (SELECT component_id FROM has_component JOIN latest USING (scan_id))"),
)


def _sink_files(g: Graph) -> DataFrame:
    """Files of generated sinks, one per vulnerability, with fields left out."""
    given = lambda c, n: F.when(F.col("seq") % n != 0, F.col(c)).alias(c)
    sinks = F.array(F.struct("function_name", "class_name", "call_pattern", given("sink_type", 2), given("vuln_type", 3), given("confidence", 5)))
    return _through_json(g.sinks.select("vuln_id", F.col("package_name").alias("package"), F.when(F.col("ecosystem") == "pypi", "PyPI").otherwise(F.col("ecosystem")).alias("ecosystem"), sinks.alias("sinks")), advisories.SINK_FILE)


def _rounded(c: str) -> Column:
    return F.round(F.col(c), 4).alias(c)


register(
    "ingest_sinks",
    lambda g: advisories.sink_rows(_sink_files(g)).select("vuln_id", "package_name", "ecosystem", "function_name", "call_pattern", "sink_type", "vuln_type", _rounded("confidence")),
    O.over("""SELECT vuln_id, package_name, ecosystem, function_name, call_pattern, sink_type, vuln_type, CASE WHEN seq % 5 <> 0 THEN round(confidence, 4) ELSE 0.7::DOUBLE END AS confidence FROM sinks"""),
)
