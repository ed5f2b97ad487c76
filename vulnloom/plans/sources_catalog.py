"""Queries over generated texts, patches, coverage, chosen scans, lists of repositories, orders and cleaned texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vulnloom.functions import exprs as X
from vulnloom.functions import texts
from vulnloom.operators import alerts, reports, upserts
from vulnloom.plans import oracle as O
from vulnloom.plans.catalog import ALERT_COLUMNS, CASES, REPOS_SQL, _cases, _repos, flat, register
from vulnloom.sources import advisories, generated, repositories
from vulnloom.sources.testbed import Graph
from vulnloom.streaming import landing

# --- generated texts ----------------------------------------------------------------------------------------------


def _texts(g: Graph) -> DataFrame:
    """A text of each sink, in shapes that take turns: a list of batches, an object, a bare list, an empty one, damaged, a number."""
    k = F.col("seq") % 7
    given = F.struct("function_name", "call_pattern", F.when(F.col("seq") % 2 == 0, F.lit("constructor")).alias("sink_type"), F.when(F.col("seq") % 4 == 0, F.lit("high").cast("string")).alias("note"))
    plain = F.to_json(given)
    rated = F.concat(F.lit('{"confidence": '), F.when(F.col("seq") % 3 == 0, F.lit('"sure"')).when(F.col("seq") % 3 == 1, F.lit("1.5")).otherwise(F.lit("0.25")), F.lit(", "), F.substring(plain, F.lit(2), F.length(plain)))
    rated = F.when(plain == "{}", F.lit('{"confidence": 0.25}')).otherwise(rated)
    batch = F.concat(F.lit('Here:\n```json\n[{"package": "own", "ecosystem": "npm", "sinks": ['), rated, F.lit(', 7]}]\n```\nDone.'))
    text = F.when(k == 0, batch).when(k == 1, F.concat(F.lit('{"sinks": ['), rated, F.lit("]}"))).when(k == 2, F.concat(F.lit("```\n["), rated, F.lit(', "x"]\n```'))).when(k == 3, F.lit(" ")).when(k == 4, F.concat(F.lit('{"sinks": ['), rated)).when(k == 5, F.lit("12"))
    return g.sinks.select("vuln_id", "package_name", text.alias("text"))


register(
    "generated_sinks",
    lambda g: generated.sinks(_texts(g)).drop("seq", "class_name"),
    O.over("""SELECT vuln_id, CASE WHEN k = 0 THEN 'own' ELSE package_name END AS package_name, CASE WHEN k = 0 THEN 'npm' ELSE '' END AS ecosystem, function_name, call_pattern,
  CASE WHEN seq % 2 = 0 THEN 'constructor' ELSE 'function_call' END AS sink_type, '' AS vuln_type,
  CASE WHEN function_name IS NULL AND call_pattern IS NULL AND seq % 2 = 1 THEN 0.25::DOUBLE ELSE CASE seq % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END END AS confidence,
  CASE WHEN seq % 4 = 0 THEN 'high' ELSE '' END AS note FROM (SELECT *, seq % 7 AS k FROM sinks) WHERE k < 3"""),
)
register(
    "generated_rejects",
    lambda g: generated.rejects(_texts(g)).groupBy("reason").agg(F.count("*").alias("n")),
    O.over("""SELECT CASE WHEN k IN (0, 2) THEN 'entry is no object' WHEN k IN (3, 6) THEN 'empty' WHEN k = 4 THEN 'not JSON' ELSE 'no list of sinks' END AS reason, count(*) AS n
FROM (SELECT seq % 7 AS k FROM sinks) WHERE k <> 1 GROUP BY 1"""),
)
register(
    "sink_coverage",
    lambda g: generated.coverage(alerts.exposures(g).select("project", F.col("vuln").alias("vuln_id")), g.sinks.filter("confidence >= 0.3")),
    O.over("""SELECT project, count(*) AS vulnerabilities, count(s.vuln_id) AS with_sinks, count(*) - count(s.vuln_id) AS missing
FROM (SELECT DISTINCT project, vuln FROM exposures) e LEFT JOIN (SELECT vuln_id FROM sinks WHERE confidence >= 0.3) s ON e.vuln = s.vuln_id GROUP BY project"""),
)

# --- patches and addresses ----------------------------------------------------------------------------------------


def _patches(g: Graph) -> DataFrame:
    """A patch per part: heads, a place, context, and changed lines, more of them than fit for some."""
    k = F.split("component_id", "/")[1].cast("long")
    many = F.when(k % 97 == 0, F.repeat(F.concat(F.lit("+"), "name", F.lit("\n")), 900)).otherwise(F.lit(""))
    text = F.concat(F.lit("From: x\r\ndiff --git a/"), "name", F.lit(" b/f\n--- a/f\n+++ b/f\n@@ -1,2 +1,3 @@\n kept\n-"), "version", F.lit("\n+new "), "version", F.lit("\n"), many, F.lit("--\n-- \n2.0"))
    return g.components.select(F.col("component_id").alias("id"), text.alias("text"))


register(
    "patch_changes",
    lambda g: advisories.patch_lines(_patches(g)),
    O.over("""SELECT component_id AS id, CASE WHEN length(t) > 8000 THEN t[1:8000] || chr(10) || '... [cut]' ELSE t END AS changed FROM (
  SELECT component_id, 'diff --git a/' || name || ' b/f' || chr(10) || '@@ -1,2 +1,3 @@' || chr(10) || '-' || version || chr(10) || '+new ' || version
    || CASE WHEN CAST(split_part(component_id, '/', 2) AS BIGINT) % 97 = 0 THEN repeat(chr(10) || '+' || name, 900) ELSE '' END || chr(10) || '--' || chr(10) || '-- ' AS t FROM components)"""),
)
register(
    "reference_hosts",
    lambda g: g.vulns.select("id", advisories.allowed(F.concat(F.when(F.col("kev"), "ftp").when(F.col("cvss") > 5, "HTTPS").otherwise("http"), F.lit("://"), F.when(F.length("id") % 2 == 0, "GitHub.com").otherwise("evil.org"), F.lit("/x?y=github.com")), ["github.com"]).alias("allowed")),
    O.over("SELECT id, NOT kev AND length(id) % 2 = 0 AS allowed FROM vulns"),
)

# --- alerts of chosen scans ---------------------------------------------------------------------------------------

CHOSEN = "CAST(scan_id AS BIGINT) % 10 = 3"
PICKED = O.BASE + f""",
picked AS (
  SELECT s.*, h.component_id, h.depth, c.name, c.version, c.scope, v.* EXCLUDE (id), v.id AS vuln,
    coalesce(list_filter(coalesce(v.aliases, CAST([] AS VARCHAR[])), lambda x: starts_with(x, 'CVE-'))[1], v.id, v.aliases[1]) AS vuln_id
  FROM (SELECT * FROM sboms WHERE {CHOSEN}) s JOIN projects p USING (project) JOIN has_component h USING (scan_id) JOIN components c USING (component_id)
  JOIN affected_by a USING (component_id) JOIN vulns v ON v.id = a.vuln),""" + O.VERDICTS + "," + O.alerts_cte("alerts", "project, scan_id, generated_at, source_commit, vuln_id", "picked")  # fmt: skip
register("alerts_of_scans", lambda g: flat(alerts.alerts(g, scans=g.sboms.filter(CHOSEN))).select(*ALERT_COLUMNS), O.over(f"SELECT {O.ALERT_OUT} FROM alerts", PICKED))

# --- repositories -------------------------------------------------------------------------------------------------

K = "CAST(substr(full_name, -9) AS BIGINT)"


def _truth(g: Graph) -> DataFrame:
    return _repos(g).select(F.col("full_name").alias("repo_full_name"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("vulnerable_commit"))


register(
    "ground_truth_pending",
    lambda g: repositories.pending(_truth(g), _truth(g).filter(f"vulnerable_commit = 'a' AND {K.replace('full_name', 'repo_full_name')} % 3 = 0")),
    O.over(f"SELECT full_name AS repo_full_name, c AS vulnerable_commit FROM ({REPOS_SQL}), (VALUES ('a'), ('b')) AS t(c) WHERE NOT (c = 'a' AND {K} % 3 = 0)"),
)


def _cloned(g: Graph) -> DataFrame:
    k = F.expr(K)
    return _repos(g).select(F.when(k % 11 != 0, F.col("full_name")).alias("full_name"), F.when(k % 4 == 0, " Python").when(k % 4 == 1, "ts").when(k % 4 == 2, "Go").alias("language"), F.when(k % 3 == 0, "success").when(k % 3 == 1, "updated").otherwise("failed").alias("clone_status"))


register(
    "repositories_ready",
    lambda g: repositories.ready(_cloned(g), _repos(g).filter(f"{K} % 5 = 0"), "nodejs", repositories.CLONED).unionByName(repositories.ready(_cloned(g), _repos(g).limit(0), "python")),
    O.over(f"""SELECT full_name, 'ts' AS language, CASE k % 3 WHEN 0 THEN 'success' ELSE 'updated' END AS clone_status FROM (SELECT full_name, {K} AS k FROM ({REPOS_SQL})) WHERE k % 11 <> 0 AND k % 4 = 1 AND k % 3 < 2 AND k % 5 <> 0
UNION ALL SELECT full_name, ' Python', 'success' FROM (SELECT full_name, {K} AS k FROM ({REPOS_SQL})) WHERE k % 11 <> 0 AND k % 4 = 0 AND k % 3 = 0"""),
)
register(
    "canonical_projects",
    lambda g: g.sboms.select(repositories.canonical_project(F.concat(F.lit(" "), "project", F.lit(" @"), "source_commit")).alias("project"), "scan_id"),
    O.over("SELECT project, scan_id FROM sboms"),
)
register(
    "metadata_merged",
    lambda g: upserts.merge_fields(g.projects.filter("project_key % 2 = 0").select("project", "language", "package_manager"), g.projects.filter("project_key % 3 = 0").select("project", F.when(F.col("project_key") % 5 != 0, "new").alias("language"), "project_key"), ["project"]),
    O.over("""SELECT project, coalesce(CASE WHEN project_key % 3 = 0 AND project_key % 5 <> 0 THEN 'new' END, CASE WHEN project_key % 2 = 0 THEN language END) AS language,
  CASE WHEN project_key % 2 = 0 THEN package_manager END AS package_manager, CASE WHEN project_key % 3 = 0 THEN project_key END AS project_key FROM projects WHERE project_key % 2 = 0 OR project_key % 3 = 0"""),
)
register(
    "unique_places",
    lambda g: upserts.unique_items(g.declared_in.select("component_id", F.concat(F.when(F.col("line") % 2 == 0, F.upper("path")).otherwise(F.col("path")), F.lit(" ")).alias("path"), F.concat_ws("-", F.lpad("scan_id", 12, "0"), F.lpad(F.col("line").cast("string"), 3, "0"), "path").alias("seq")), ["component_id"], "path", "seq").select("component_id", "path"),
    O.over("""SELECT component_id, path FROM (SELECT component_id, p AS path, row_number() OVER (PARTITION BY component_id, lower(trim(p)) ORDER BY lpad(scan_id, 12, '0') || '-' || lpad(CAST(line AS VARCHAR), 3, '0') || '-' || path) AS n
FROM (SELECT *, CASE WHEN line % 2 = 0 THEN upper(path) ELSE path END || ' ' AS p FROM declared_in)) WHERE n = 1"""),
)

# --- orders and texts ---------------------------------------------------------------------------------------------

register(
    "case_order",
    lambda g: _cases(g).select("project", "vuln_id", "component_id", F.row_number().over(Window.partitionBy("project").orderBy(*reports.case_order())).alias("place"), F.row_number().over(Window.partitionBy("project").orderBy(*reports.case_order(True))).alias("queue_place")),
    O.over(
        f"""SELECT project, vuln_id, component_id, CAST(row_number() OVER (PARTITION BY project ORDER BY status IN ('resolved_pending_verify', 'verified_closed'), {O.TIER_RANK.format("decision_tier")}, kev DESC, risk_score DESC NULLS LAST, cvss DESC NULLS LAST, vuln_id, component_id) AS INT) AS place,
  CAST(row_number() OVER (PARTITION BY project ORDER BY {O.TIER_RANK.format("decision_tier")}, kev DESC, reachability_verdict = 'confirmed_reachable' DESC, risk_score DESC NULLS LAST, cvss DESC NULLS LAST, vuln_id, component_id) AS INT) AS queue_place FROM cases""",
        CASES,
    ),
)
register(
    "evidence_order",
    lambda g: reports.evidence_order("place", 7)(_cases(g)).select("project", "vuln_id", "component_id", "place"),
    O.over(
        """SELECT project, vuln_id, component_id, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY reachability_verdict = 'confirmed_reachable' DESC, evidence_scope = 'production' DESC, vuln_id, component_id) AS place FROM cases) WHERE place <= 7""",
        CASES,
    ),
)
register(
    "cleaned_texts",
    lambda g: g.vulns.select(
        "id", texts.without_label(F.concat(F.lit("Impact:  impact - "), "summary")).alias("unlabelled"), texts.plain(F.concat(F.lit("## **"), "summary", F.lit("**\n- see [`here`](http://x)  \n1. end"))).alias("plain"),
        texts.compact(F.concat("summary", F.lit(". "), F.repeat(F.lit("word "), 40)), 60).alias("short"), texts.version_path(F.when(F.col("kev"), F.lit("1.0")), X.preferred_version(F.col("fix_versions"))).alias("path"),
    ),
    O.over(f"""SELECT id, summary AS unlabelled, summary || ' see here end' AS plain, CASE WHEN length(summary) + 1 >= 20 THEN summary || '.' END AS short,
  CASE WHEN len(fix_versions) = 0 THEN 'no fixed version' WHEN kev THEN '1.0 to ' || target ELSE 'to ' || target END AS path FROM (SELECT *, {O.PREFERRED} AS target FROM vulns)"""),
)


# --- import lists -------------------------------------------------------------------------------------------------


def _summaries(g: Graph) -> DataFrame:
    """A summary of results per day, as JSON text that is read back; every fifth result names no file."""
    named = F.when(F.expr("CAST(scan_id AS BIGINT) % 5 <> 0"), F.concat(F.lit("data/"), "scan_id", F.lit(".json"))).otherwise(" ")
    text = g.sboms.groupBy("generated_at").agg(F.to_json(F.struct(F.collect_list(F.struct(named.alias("vulnerability_file"))).alias("results"))).alias("text"))
    return text.select(F.from_json("text", "results array<struct<vulnerability_file:string>>").alias("d")).select("d.results")


def _import_list(g: Graph) -> DataFrame:
    """Contents of the listed files: a repository by its key, name, address or not at all; every third is imported already."""
    k = F.regexp_extract("vulnerability_file", r"(\d+)", 1).cast("long")
    name = F.concat(F.lit("o/r"), (k % 50).cast("string"))
    repo = F.struct(F.when(k % 4 == 0, F.concat(F.lit("key-"), name)).alias("metadata_key"), F.when(k % 4 == 1, name).alias("full_name"), F.when(k % 4 == 2, F.concat(F.lit("https://h/"), name)).alias("url"), F.lit(None).cast("string").alias("name"))
    files = landing.listed_files(_summaries(g)).select(F.col("vulnerability_file").alias("file"), repo.alias("repo"), F.concat(F.lit("sbom-"), k.cast("string")).alias("sbom_file"))
    done = g.sboms.filter("CAST(scan_id AS BIGINT) % 3 = 0").select(F.concat(F.lit("o/r"), (F.col("scan_id").cast("long") % 50).cast("string")).alias("repo_key")).distinct().filter("length(repo_key) = 4")
    return landing.import_list(files, done)


register(
    "import_list",
    _import_list,
    O.over("""SELECT repo_key, min(file) AS file, arg_min('sbom-' || k, file) AS sbom_file FROM (
  SELECT k, 'data/' || k || '.json' AS file, CASE k % 4 WHEN 0 THEN 'key-o/r' || (k % 50) WHEN 1 THEN 'o/r' || (k % 50) WHEN 2 THEN 'https://h/o/r' || (k % 50) END AS repo_key FROM (SELECT CAST(scan_id AS BIGINT) AS k FROM sboms) WHERE k % 5 <> 0)
WHERE repo_key IS NOT NULL AND repo_key NOT IN (SELECT DISTINCT 'o/r' || (CAST(scan_id AS BIGINT) % 50) FROM sboms WHERE CAST(scan_id AS BIGINT) % 3 = 0 AND CAST(scan_id AS BIGINT) % 50 < 10) GROUP BY repo_key"""),
)
