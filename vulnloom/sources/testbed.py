"""The star-schema test tables read as a dependency graph.

Each graph table is one SQL projection that Spark and DuckDB can both run (placeholders cover their list literals), so the
operators are compared on equal inputs while they themselves are written twice: as DataFrames here, as SQL for the oracle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession


def purl(key: str) -> str:
    return f"('pkg:' || CASE {key} % 4 WHEN 0 THEN 'npm' WHEN 1 THEN 'pypi' WHEN 2 THEN 'cargo' ELSE 'golang' END || '/' || CAST({key} AS STRING))"


HALF = "CAST((s_suppkey - s_suppkey % 2) / 2 AS BIGINT)"

TABLES = {
    "projects": """
SELECT c_name AS project, c_custkey AS project_key, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_mktsegment END AS language,
  CASE c_nationkey % 3 WHEN 0 THEN 'npm' WHEN 1 THEN 'pip' ELSE 'maven' END AS package_manager
FROM {customer}""",
    "sboms": """
SELECT CAST(o_orderkey AS STRING) AS scan_id, c_name AS project, CAST(CAST(o_orderdate AS DATE) AS STRING) AS generated_at,
  o_orderstatus AS branch, 'c' || CAST(o_orderkey % 9973 AS STRING) AS source_commit
FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "components": f"""
SELECT {purl("p_partkey")} AS component_id, p_name AS name, p_brand AS version,
  CASE p_size % 6 WHEN 0 THEN 'required' WHEN 1 THEN 'runtime' WHEN 2 THEN 'optional' WHEN 3 THEN 'dev' WHEN 4 THEN 'test' ELSE NULL END AS scope
FROM {{part}}""",
    "has_component": f"""
SELECT CAST(l_orderkey AS STRING) AS scan_id, {purl("l_partkey")} AS component_id, min(l_linenumber) AS depth, min(l_linenumber) = 1 AS is_direct
FROM {{lineitem}} GROUP BY l_orderkey, l_partkey""",
    "depends_on": f"""
SELECT CAST(a.k AS STRING) AS scan_id, {purl("a.p")} AS src, {purl("b.p")} AS dst
FROM (SELECT l_orderkey AS k, l_partkey AS p, min(l_linenumber) AS d FROM {{lineitem}} GROUP BY l_orderkey, l_partkey) a
JOIN (SELECT l_orderkey AS k, l_partkey AS p, min(l_linenumber) AS d FROM {{lineitem}} GROUP BY l_orderkey, l_partkey) b
  ON a.k = b.k AND a.d < b.d AND (a.p + b.p) % 3 = 0""",
    "vulns": f"""
SELECT 'GHSA-' || CAST(s_suppkey AS STRING) AS id,
  CASE WHEN s_suppkey % 9 = 0 THEN NULL WHEN s_suppkey % 3 = 0 THEN {{empty}} ELSE {{list}}('CVE-2024-' || CAST({HALF} AS STRING)) END AS aliases,
  CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE ((s_suppkey * 37) % 101) / CAST(10 AS DOUBLE) END AS cvss,
  CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE ((s_suppkey * 7919) % 10007) / CAST(10007 AS DOUBLE) END AS epss,
  s_suppkey % 11 = 0 AS kev,
  CASE WHEN s_suppkey % 4 = 0 THEN {{empty}} WHEN s_suppkey % 4 = 1 THEN {{list}}('1.' || CAST(s_suppkey % 12 AS STRING) || '.0')
    ELSE {{list}}('1.' || CAST(s_suppkey % 12 AS STRING) || '.0', '2.0.0-rc' || CAST(s_suppkey % 3 AS STRING)) END AS fix_versions,
  CASE WHEN s_suppkey % 6 = 0 THEN {{empty}} ELSE {{list}}('CWE-' || CAST(20 + s_suppkey % 80 AS STRING)) END AS cwe,
  'Advisory for ' || s_name AS summary,
  CAST(DATE '2023-01-01' + CAST(s_suppkey % 700 AS INT) AS STRING) AS published,
  CAST(DATE '2024-01-01' + CAST((s_suppkey * 13) % 700 AS INT) AS STRING) AS modified
FROM {{supplier}}""",
    "affected_by": f"""
SELECT DISTINCT {purl("l_partkey")} AS component_id, 'GHSA-' || CAST(l_suppkey AS STRING) AS vuln FROM {{lineitem}}""",
    "declared_in": f"""
SELECT DISTINCT CAST(l_orderkey AS STRING) AS scan_id, {purl("l_partkey")} AS component_id,
  CASE l_returnflag WHEN 'R' THEN 'tests/' WHEN 'A' THEN 'src/api/' ELSE 'lib/' END || 'm' || CAST(l_linenumber AS STRING) || '.lock' AS path, l_linenumber AS line
FROM {{lineitem}}""",
    "reachability": """
SELECT c_name AS project, CASE WHEN event_id % 2 = 0 THEN 'GHSA-' || CAST(k AS STRING) ELSE 'CVE-2024-' || CAST(CAST((k - k % 2) / 2 AS BIGINT) AS STRING) END AS vuln_id,
  CASE event_id % 5 WHEN 0 THEN 'confirmed_reachable' WHEN 1 THEN 'likely_reachable' WHEN 2 THEN 'uncertain' WHEN 3 THEN 'likely_unreachable' ELSE 'no_sink_data' END AS verdict,
  CASE event_id % 4 WHEN 0 THEN {empty} WHEN 1 THEN {list}('src/app' || CAST(event_id % 7 AS STRING) || '.py:' || CAST(event_id % 50 AS STRING))
    ELSE {list}('tests/t' || CAST(event_id % 5 AS STRING) || '.py:3', 'src/core' || CAST(event_id % 3 AS STRING) || '.js:9') END AS call_locations,
  'fn' || CAST(event_id % 17 AS STRING) AS sink_function, event_id AS seq
FROM (SELECT *, event_id % (SELECT count(*) FROM {supplier}) + 1 AS k FROM {events}) e JOIN {customer} ON user_id = c_custkey""",
    "sinks": """
SELECT 'GHSA-' || CAST(s_suppkey AS STRING) AS vuln_id, CASE s_suppkey % 3 WHEN 0 THEN '@scope/pkg-' WHEN 1 THEN 'py-pkg-' ELSE 'org:art-' END || CAST(s_suppkey % 40 AS STRING) AS package_name,
  CASE s_suppkey % 3 WHEN 0 THEN 'npm' WHEN 1 THEN 'pypi' ELSE 'maven' END AS ecosystem,
  CASE s_suppkey % 5 WHEN 0 THEN 'parse' WHEN 1 THEN 'unsafeMerge' WHEN 2 THEN 'render_tpl' WHEN 3 THEN NULL ELSE 'load_all' END AS function_name, CAST(NULL AS STRING) AS class_name,
  CASE s_suppkey % 6 WHEN 0 THEN 'new Runner(...)' WHEN 1 THEN '$OBJ.fetch(...)' WHEN 2 THEN 'evalAll(...)' WHEN 3 THEN 'GET /admin' WHEN 4 THEN '.$ANY(...)' ELSE NULL END AS call_pattern,
  'function_call' AS sink_type, 'Unknown' AS vuln_type, (s_suppkey % 10) / CAST(10 AS DOUBLE) AS confidence, s_suppkey AS seq
FROM {supplier} WHERE s_suppkey % 13 <> 0""",
    "findings": """
SELECT 'cfg.rules.sbom-reach-ghsa_' || CAST(k AS STRING) || '-' || CASE k % 5 WHEN 0 THEN 'parse' WHEN 1 THEN 'unsafeMerge' WHEN 2 THEN 'render_tpl' ELSE 'load_all' END
    || CASE WHEN event_id % 3 = 0 THEN '-direct' ELSE '-import' END AS check_id,
  'repo/src/f' || CAST(event_id % 9 AS STRING) || '.js' AS path, CAST(event_id % 100 AS INT) AS line
FROM (SELECT event_id, event_id % ((SELECT count(*) FROM {supplier}) * 3) + 1 AS k FROM {events}) e""",
}

TABLES["source_lines"] = """
SELECT 'src/m' || CAST(f AS STRING) || CASE supp % 3 WHEN 0 THEN '.js' WHEN 1 THEN '.py' ELSE '.java' END AS path, number, form, supp, fn, replace(replace(CASE supp % 3
  WHEN 0 THEN CASE form WHEN 0 THEN 'const m = require(''PKG'');' WHEN 1 THEN 'import {{ FN }} from ''PKG'';' WHEN 2 THEN 'import {{ FN as q, other }} from "PKG";' WHEN 3 THEN 'm.FN(x);' WHEN 4 THEN '  FN (x)'
    WHEN 5 THEN 'y = q(x, y)' WHEN 6 THEN 'run(new Runner(z))' WHEN 7 THEN 'other.fetch(u)' WHEN 8 THEN 'evalAll(s)' WHEN 9 THEN 'require(''PKG'').FN(1)' WHEN 10 THEN 'xFN(3); function FN(a) {{' ELSE '// nothing' END
  WHEN 1 THEN CASE form WHEN 0 THEN 'import PKG' WHEN 1 THEN 'from PKG import FN' WHEN 2 THEN 'from PKG.sub import (FN, b)' WHEN 3 THEN '  PKG.FN(x)' WHEN 4 THEN 'z = FN(x)'
    WHEN 5 THEN 'import PKG as z' WHEN 6 THEN 'run(Runner(z))' WHEN 7 THEN 'other.fetch(u)' WHEN 8 THEN 'evalAll(s)' WHEN 9 THEN 'import os, PKG' WHEN 10 THEN 'def FN(a):' ELSE 'pass' END
  ELSE CASE form WHEN 0 THEN 'import org.art.Thing;' WHEN 4 THEN 'FN(x);' WHEN 6 THEN 'run(new Runner(z));' WHEN 7 THEN 'a.fetch(u);' WHEN 8 THEN 'evalAll(s);' ELSE 'int x;' END END,
  'PKG', CASE supp % 3 WHEN 0 THEN '@scope/pkg-' ELSE 'py_pkg_' END || CAST(supp % 40 AS STRING)), 'FN', fn) AS text
FROM (SELECT f, number, (ordinal * (f % 5 + 1) + f) % 12 AS form, supp, CASE supp % 5 WHEN 0 THEN 'parse' WHEN 1 THEN 'unsafeMerge' WHEN 2 THEN 'render_tpl' WHEN 3 THEN 'helper' ELSE 'load_all' END AS fn
  FROM (SELECT f, event_id AS number, CAST((event_id - f) / (2 * n) AS BIGINT) AS ordinal, CAST((f - f % 2) / 2 AS BIGINT) + 1 AS supp
    FROM (SELECT event_id, n, event_id % (2 * n) AS f FROM (SELECT event_id, (SELECT count(*) FROM {supplier}) AS n FROM {events}) e) g) h) k"""

SOURCES = ("customer", "orders", "part", "lineitem", "supplier", "events")


#: Projects whose rows go to one task, where rows are dealt by project: a task's share stays the same as tables grow.
PROJECTS_A_TASK = 4096


@dataclass(frozen=True)
class Graph:
    """The node, edge and store tables that the operators work on."""

    projects: DataFrame
    sboms: DataFrame
    components: DataFrame
    has_component: DataFrame
    depends_on: DataFrame
    vulns: DataFrame
    affected_by: DataFrame
    declared_in: DataFrame
    reachability: DataFrame
    sinks: DataFrame
    findings: DataFrame
    source_lines: DataFrame

    @cached_property
    def partitions(self) -> int:
        """Tasks to deal rows to by project; more than Spark's own number, at or below which it may join tasks together or deal rows again."""
        own = int(self.projects.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return max(own + 1, self.projects.count() // PROJECTS_A_TASK + 1)

    @cached_property
    def advisories(self) -> int:
        return self.vulns.count()


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in SOURCES}
    made = {}
    for name, sql in TABLES.items():
        sql = sql.replace("{list}", "array").replace("{empty}", "CAST(array() AS ARRAY<STRING>)")
        made[name] = spark.sql(sql, **{t: f for t, f in frames.items() if "{" + t + "}" in sql})
    return Graph(**made)


def ctes() -> str:
    """The same tables as DuckDB common table expressions."""
    words = {t: t for t in SOURCES} | {"list": "list_value", "empty": "CAST([] AS VARCHAR[])"}
    return ",\n".join(f"{name} AS ({sql.format(**words)})" for name, sql in TABLES.items())
