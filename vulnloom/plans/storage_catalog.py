"""Queries over what is written and read back: tables merged by key, committed runs, landed documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnloom.operators import rules
from vulnloom.plans import oracle as O
from vulnloom.plans.catalog import register
from vulnloom.plans.ingest_catalog import _documents
from vulnloom.sources import keyed, runs
from vulnloom.sources.shared import shared_path
from vulnloom.sources.testbed import Graph
from vulnloom.streaming import landing

# --- merged by key ------------------------------------------------------------------------------------------------

KEYS = ["project", "vuln_id", "sink_function"]
LAST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project, vuln_id, sink_function ORDER BY seq DESC) AS k FROM reachability WHERE {}) WHERE k = 1"


def _last(g: Graph, where: str) -> DataFrame:
    rows = g.reachability.filter(where)
    return rows.groupBy(*KEYS).agg(F.max_by(F.struct("verdict", "seq"), "seq").alias("r")).select(*KEYS, "r.*")


def _keyed(g: Graph, field: keyed.Field, new: DataFrame, seq: str | None) -> DataFrame:
    table = keyed.create(_last(g, "seq % 2 = 0"), KEYS, slices=16, buckets=4)
    keyed.upsert(table, new, field, seq)
    return table.read(new.sparkSession).select(*KEYS, "verdict", "seq")


register(
    "keyed_upsert",
    lambda g: _keyed(g, keyed.replacing, g.reachability.filter("seq % 3 = 0").select(*KEYS, "verdict", "seq"), "seq"),
    O.over(f"""SELECT project, vuln_id, sink_function, verdict, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY project, vuln_id, sink_function ORDER BY new DESC) AS n FROM (
    SELECT *, false AS new FROM ({LAST.format("seq % 2 = 0")}) UNION ALL SELECT *, true FROM ({LAST.format("seq % 3 = 0")}))) WHERE n = 1"""),
)
register(
    "keyed_fields",
    lambda g: _keyed(g, keyed.keeping, _last(g, "seq % 3 = 0").select(*KEYS, F.when(F.col("seq") % 2 == 1, F.col("verdict")).alias("verdict")), None),
    O.over(f"""SELECT project, vuln_id, sink_function, coalesce(CASE WHEN b.seq % 2 = 1 THEN b.verdict END, a.verdict) AS verdict, a.seq
FROM ({LAST.format("seq % 2 = 0")}) a FULL JOIN ({LAST.format("seq % 3 = 0")}) b USING (project, vuln_id, sink_function)"""),
)
register(
    "keyed_first_stays",
    lambda g: _keyed(g, keyed.first_stays, _last(g, "seq % 3 = 0"), None),
    O.over(f"""SELECT project, vuln_id, sink_function, CASE WHEN a.seq IS NOT NULL THEN a.verdict ELSE b.verdict END AS verdict, coalesce(a.seq, b.seq) AS seq
FROM ({LAST.format("seq % 2 = 0")}) a FULL JOIN ({LAST.format("seq % 3 = 0")}) b USING (project, vuln_id, sink_function)"""),
)

# --- committed runs -----------------------------------------------------------------------------------------------


def _store(g: Graph) -> runs.RunStore:
    spark = g.reachability.sparkSession
    return runs.RunStore(spark, shared_path(spark, "runs"), "project string, vuln_id string, verdict string, seq long")


def _run_rows(g: Graph, where: str) -> DataFrame:
    return g.reachability.filter(where).join(g.projects.select("project", F.col("package_manager").alias("run_id")), "project").select("run_id", "project", "vuln_id", "verdict", "seq")


def _replaced(g: Graph) -> DataFrame:
    store = _store(g)
    store.replace(_run_rows(g, "seq % 7 = 1"))
    store.clear()
    store.replace(_run_rows(g, "seq % 2 = 0"))
    store.replace(_run_rows(g, "seq % 3 = 0").filter("run_id <> 'npm'"))
    return store.read()


register(
    "runs_replaced",
    _replaced,
    O.over("""SELECT package_manager AS run_id, project, vuln_id, verdict, seq FROM reachability JOIN projects USING (project)
WHERE CASE WHEN package_manager = 'npm' THEN seq % 2 = 0 ELSE seq % 3 = 0 END"""),
)


def _cleared(g: Graph) -> DataFrame:
    store = _store(g)
    store.replace(_run_rows(g, "seq % 2 = 0"))
    store.clear()
    store.replace(_run_rows(g, "seq % 5 = 0").filter("run_id = 'pip'"))
    return rules.verdict_counts(store.read())


register("runs_after_clear", _cleared, O.over("SELECT verdict, count(*) AS n FROM reachability JOIN projects USING (project) WHERE package_manager = 'pip' AND seq % 5 = 0 GROUP BY verdict"))
register(
    "verdict_export",
    lambda g: runs.export_verdicts(g.reachability.withColumn("project", F.concat(F.lit("group-"), F.length("vuln_id").cast("string"))).select("project", "vuln_id", "verdict", "sink_function"), shared_path(g.reachability.sparkSession, "verdicts")),
    O.over("SELECT 'group-' || length(vuln_id) AS project, verdict, count(*) AS n FROM reachability GROUP BY ALL"),
)

# --- landed documents ---------------------------------------------------------------------------------------------


def _landed(g: Graph) -> tuple:
    """Two batches of documents, the second with all of the first again."""
    spark = g.sboms.sparkSession
    target, docs = shared_path(spark, "landed"), _documents(g)
    landing.write_batch(docs.filter(F.length("project") % 2 == F.substring("project", -1, 1).cast("int") % 2), 0, target, once=True)
    landing.write_batch(docs, 1, target, once=True)
    return spark, target


register(
    "landed_totals",
    lambda g: landing.totals(*_landed(g)),
    O.over(
        """SELECT l.project, 1 AS scans, count(*) AS components, count_if(x.node IS NOT NULL) AS direct, any_value(coalesce(e.n, 0)) AS dependencies, any_value(coalesce(p.n, 0)) AS places, CAST(max(d.depth) AS BIGINT) AS deepest
FROM latest l JOIN has_component h USING (scan_id) LEFT JOIN depths d ON d.scan_id = h.scan_id AND d.node = h.component_id LEFT JOIN direct x ON x.scan_id = h.scan_id AND x.node = h.component_id
LEFT JOIN (SELECT scan_id, count(*) AS n FROM (SELECT DISTINCT scan_id, src, dst FROM depends_on) GROUP BY scan_id) e ON e.scan_id = h.scan_id
LEFT JOIN (SELECT scan_id, count(*) AS n FROM (SELECT DISTINCT scan_id, component_id, path, line FROM declared_in) GROUP BY scan_id) p ON p.scan_id = h.scan_id GROUP BY l.project""",
        O.BASE + "," + O.DEPTHS_SQL,
        True,
    ),
)
register("landed_ledger", lambda g: landing.ledger(*_landed(g)), O.over("SELECT DISTINCT project AS repo_key FROM latest JOIN has_component USING (scan_id)"))
