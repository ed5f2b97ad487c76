"""Advisory records (vulnerability database, scores, known exploitation) landed as JSON, joined to packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnloom.functions import exprs as X

EVENTS = "array<struct<fixed:string,last_affected:string>>"
AFFECTED = f"array<struct<package:struct<name:string,ecosystem:string>,ranges:array<struct<type:string,repo:string,events:{EVENTS}>>,ecosystem_specific:struct<affected_functions:array<string>>>>"
ADVISORY = f"id string, summary string, details string, published string, modified string, withdrawn string, aliases array<string>, severity array<struct<score:string>>, affected {AFFECTED}, references array<struct<type:string,url:string>>"
SCORE = "struct<cvssData:struct<baseScore:double,baseSeverity:string>>"
METRICS = ", ".join(f"{v}:array<{SCORE}>" for v in ("cvssMetricV31", "cvssMetricV30", "cvssMetricV2", "cvssMetricV40"))
NVD = f"cve_id string, metrics struct<{METRICS}>, weaknesses array<struct<description:array<struct<value:string>>>>"
SINK_FILE = "vuln_id string, package string, ecosystem string, sinks array<struct<function_name:string,class_name:string,call_pattern:string,sink_type:string,vuln_type:string,confidence:double>>"

# Ecosystem names of the vulnerability database, and how many references of a type are followed.
ECOSYSTEMS = {"crates.io": "cargo", "packagist": "composer", "go": "go", "npm": "npm", "pypi": "pypi", "maven": "maven", "nuget": "nuget", "rubygems": "rubygems"}
REFERENCES = {"FIX": 3, "ADVISORY": 2, "REPORT": 2}


def read(spark: SparkSession, path: str, schema: str = ADVISORY) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def fix_versions(affected: Column) -> Column:
    """Every fixed or last affected version, distinct and sorted as text."""
    events = F.flatten(F.flatten(F.transform(affected, lambda a: F.transform(a["ranges"], lambda r: r["events"]))))
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(events, lambda e: F.coalesce(e["fixed"], e["last_affected"])))))


def details(records: DataFrame) -> DataFrame:
    """Vulnerability rows: texts, times, severity vectors, fix versions and CVE ids."""
    cves = F.filter(X.strings(F.col("aliases")), lambda x: F.startswith(x, F.lit("CVE-")))
    return records.select(
        "id", F.coalesce("summary", "details").alias("detail_summary"), "published", "modified", "withdrawn", X.strings(F.col("aliases")).alias("aliases"),
        F.transform("severity", lambda s: s["score"]).alias("severity_vectors"), fix_versions(F.col("affected")).alias("fix_versions"), cves.alias("cve_ids"),
    )


def scores(nvd: DataFrame) -> DataFrame:
    """(cve_id, cvss_score, cvss_severity, cwes): the first metric of v3.1, v3.0, v2, v4.0 in that order."""
    first = F.coalesce(*[F.get(f"metrics.{v}", F.lit(0))["cvssData"] for v in ("cvssMetricV31", "cvssMetricV30", "cvssMetricV2", "cvssMetricV40")])
    cwes = F.array_distinct(F.flatten(F.transform("weaknesses", lambda w: F.transform(w["description"], lambda d: d["value"]))))
    return nvd.select("cve_id", first["baseScore"].alias("cvss_score"), first["baseSeverity"].alias("cvss_severity"), F.filter(cwes, lambda x: F.startswith(x, F.lit("CWE-"))).alias("cwes"))


def enrich(vulns: DataFrame, nvd: DataFrame, epss: DataFrame, kev: DataFrame) -> DataFrame:
    """``vulns`` (id, cve_ids, ...) with scores folded over their CVE ids in order.

    EPSS is the first known, CVSS the last known, known exploitation any, weaknesses all.  ``epss`` (cve_id, epss, percentile),
    ``kev`` (cve_id).
    """
    ids = vulns.select("id", F.posexplode("cve_ids").alias("pos", "cve_id"))
    met = ids.join(scores(nvd), "cve_id", "left").join(epss, "cve_id", "left").join(kev.select("cve_id", F.lit(True).alias("kev")).distinct(), "cve_id", "left")
    when = lambda c: F.when(F.col(c).isNotNull(), F.col("pos"))
    one = met.groupBy("id").agg(
        F.min_by("epss", when("epss")).alias("epss"), F.min_by("percentile", when("epss")).alias("epss_percentile"), F.coalesce(F.bool_or("kev"), F.lit(False)).alias("kev"),
        F.max_by("cvss_score", when("cvss_score")).alias("cvss_score"), F.max_by("cvss_severity", when("cvss_score")).alias("cvss_severity"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("cwes")))).alias("cwe"),
    )
    return vulns.join(one, "id", "left").withColumn("kev", F.coalesce("kev", F.lit(False))).withColumn("cwe", X.strings(F.col("cwe")))


def attach(components: DataFrame, refs: DataFrame) -> DataFrame:
    """(component_id, vuln): components by purl with the advisories that the lookup table (purl, vuln_id) names."""
    return components.select("component_id", "purl").distinct().join(refs, "purl").select("component_id", F.col("vuln_id").alias("vuln")).distinct()


def ecosystem(name: Column) -> Column:
    low = F.lower(F.split(name, ":")[0])
    return X.lookup(low, ECOSYSTEMS, low)


def sink_rows(files: DataFrame) -> DataFrame:
    """Sinks of generated files, defaults filled in."""
    rows = files.select("vuln_id", F.col("package").alias("package_name"), "ecosystem", F.posexplode("sinks").alias("seq", "s"))
    return rows.select(
        "vuln_id", "package_name", ecosystem(F.col("ecosystem")).alias("ecosystem"), "s.function_name", "s.class_name", "s.call_pattern", F.coalesce("s.sink_type", F.lit("function_call")).alias("sink_type"),
        F.coalesce("s.vuln_type", F.lit("Unknown")).alias("vuln_type"), F.coalesce("s.confidence", F.lit(0.7)).alias("confidence"), F.col("seq").cast("long").alias("seq"),
    )


def listed_functions(records: DataFrame) -> DataFrame:
    """Sinks that an advisory lists itself."""
    rows = records.select("id", F.explode("affected").alias("a")).select("id", "a.package", F.posexplode("a.ecosystem_specific.affected_functions").alias("seq", "fn"))
    name = F.element_at(F.split("fn", r"[.:]+"), -1)
    return rows.select(F.col("id").alias("vuln_id"), F.col("package.name").alias("package_name"), ecosystem(F.col("package.ecosystem")).alias("ecosystem"), name.alias("function_name"), F.col("seq").cast("long").alias("seq"))


def followed_references(records: DataFrame) -> DataFrame:
    """(id, type, url): the first references of each type, https hosts only."""
    of = lambda kind: F.filter("references", lambda r: r["type"] == kind)
    picked = [F.slice(of(kind), 1, n) for kind, n in REFERENCES.items()]
    rows = records.select("id", F.explode(F.concat(*picked)).alias("r")).select("id", "r.type", "r.url")
    return rows.filter(F.startswith("url", F.lit("https://"))).withColumn("host", F.parse_url("url", F.lit("HOST")))


def package_name(records: DataFrame) -> DataFrame:
    """(id, package_name): the first affected package, else the tail of its repository address."""
    repo = F.regexp_extract(F.get(F.get("affected", F.lit(0))["ranges"], F.lit(0))["repo"], r"([^/]+?)(?:\.git)?/?$", 1)
    return records.select("id", F.coalesce(F.get("affected", F.lit(0))["package"]["name"], F.nullif(repo, F.lit(""))).alias("package_name"))


def patch_lines(patches: DataFrame, most: int = 8000) -> DataFrame:
    """(id, changed): of each patch (id, text) the file heads, the places and the lines that change, ``most`` characters at most."""
    changed = F.filter(F.split("text", "\r?\n"), lambda x: F.startswith(x, F.lit("diff --git")) | F.startswith(x, F.lit("@@")) | (x.rlike("^[+-]") & ~x.rlike(r"^(\+\+\+|---)")))
    whole = F.array_join(changed, "\n")
    return patches.select("id", F.when(F.length(whole) > most, F.concat(F.substring(whole, 1, most), F.lit("\n... [cut]"))).otherwise(whole).alias("changed"))


def allowed(url: Column, hosts: list[str]) -> Column:
    """Whether an address is one of the web, at one of ``hosts``."""
    return F.coalesce(F.lower(F.parse_url(url, F.lit("PROTOCOL"))).isin("http", "https") & F.lower(F.parse_url(url, F.lit("HOST"))).isin(hosts), F.lit(False))
