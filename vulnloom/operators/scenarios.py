"""The fixed catalogue of analyst questions, q1 to q14 (there is no q5), and the named bundles of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vulnloom.functions import exprs as X
from vulnloom.operators.alerts import exposures, latest_sboms, latest_scan_metadata
from vulnloom.operators.paths import dependency_chains
from vulnloom.sources.testbed import Graph


def _different(name: str) -> Column:
    """Distinct values of a project, counted where its rows lie: two distinct counts at once would copy and deal all rows anew."""
    return F.size(F.collect_set(name)).cast("long")


def top_risky_projects(g: Graph, n: int = 20) -> DataFrame:
    """q1: projects by summed CVSS of their (component, vulnerability) pairs, known exploitation and mean EPSS."""
    one = exposures(g).groupBy("project").agg(
        _different("component_id").alias("components"),
        _different("vuln").alias("vulns"),
        F.round(F.sum("cvss"), 4).alias("cvss_sum"),
        F.count_if("kev").alias("kev_hits"),
        F.round(F.avg("epss"), 6).alias("avg_epss"),
    )
    score = F.coalesce("cvss_sum", F.lit(0.0)) + 10 * F.col("kev_hits") + 100 * F.coalesce("avg_epss", F.lit(0.0))
    return one.withColumn("score", F.round(score, 4)).orderBy(F.desc("score"), "project").limit(n)


def impact(g: Graph, project: str, vuln: str) -> DataFrame:
    """q2: affected components of one project with every place that ever declared them (not only in this scan)."""
    rows = exposures(g).filter((F.col("project") == project) & X.matches_vuln(F.col("vuln"), F.col("aliases"), vuln))
    places = g.declared_in.groupBy("component_id").agg(F.collect_set("path").alias("paths"))
    met = rows.select("project", "vuln_id", "component_id", "name", "version", "depth", "is_direct", "scope").distinct()
    return met.join(places, "component_id", "left")


def _pairs(g: Graph) -> DataFrame:
    return exposures(g).select("project", "vuln", "vuln_id", "component_id", "name", "version", "cvss", "epss", "kev", "fix_versions", "published", "modified", "depth").distinct()


def quick_wins(g: Graph, n: int = 50) -> DataFrame:
    """q3: CVSS of 7 or more with a fix."""
    order = [F.desc("kev"), F.desc_nulls_first("cvss"), "project", "component_id", "vuln"]
    return _pairs(g).filter((F.coalesce("cvss", F.lit(0.0)) >= 7) & (F.size(X.strings(F.col("fix_versions"))) > 0)).orderBy(*order).limit(n)


def no_fix(g: Graph, n: int = 50) -> DataFrame:
    """q4: CVSS of 7 or more without a fix."""
    order = [F.desc("kev"), F.desc_nulls_first("cvss"), "project", "component_id", "vuln"]
    return _pairs(g).filter((F.coalesce("cvss", F.lit(0.0)) >= 7) & (F.size(X.strings(F.col("fix_versions"))) == 0)).orderBy(*order).limit(n)


def kev_queue(g: Graph, n: int = 100) -> DataFrame:
    """q7: known exploited, by CVSS, then EPSS."""
    order = [F.desc(F.coalesce("cvss", F.lit(0.0))), F.desc_nulls_first("epss"), "project", "component_id", "vuln"]
    return _pairs(g).filter("kev").orderBy(*order).limit(n)


def recent(g: Graph, since: str, n: int = 100) -> DataFrame:
    """q8: changed since an ISO time (compared as text)."""
    return _pairs(g).filter(F.col("modified") >= since).orderBy(F.desc_nulls_first("modified"), "project", "component_id", "vuln").limit(n)


def project_summary(g: Graph) -> DataFrame:
    """q9: per project the ten worst pairs, distinct counts and the number of pairs of CVSS 7 or more."""
    rows = _pairs(g)
    worst = Window.partitionBy("project").orderBy(F.desc("kev"), F.desc_nulls_last("cvss"), "vuln", "component_id")
    ranked = rows.withColumn("n", F.row_number().over(worst))
    top = F.array_sort(F.collect_list(F.when(F.col("n") <= 10, F.struct("n", "vuln", "component_id"))))
    return ranked.groupBy("project").agg(
        F.array_join(F.transform(top, lambda x: F.concat_ws("@", x["vuln"], x["component_id"])), "|").alias("top_pairs"),
        _different("component_id").alias("components"),
        _different("vuln").alias("vulns"),
        F.count_if(F.col("cvss") >= 7).alias("severe_pairs"),
    )


def alert_inventory(g: Graph, project: str) -> DataFrame:
    """q10: all pairs of one project."""
    return _pairs(g).filter(F.col("project") == project).orderBy(F.desc("kev"), F.desc_nulls_first("cvss"), "name", "component_id", "vuln")


def top_components(g: Graph, n: int = 20) -> DataFrame:
    """q11: component names by distinct vulnerabilities."""
    one = _pairs(g).groupBy("project", "name").agg(F.count_distinct("vuln").alias("vulns"), F.max("cvss").alias("max_cvss"), F.count_if("kev").alias("kev_hits"))
    return one.orderBy(F.desc("vulns"), F.desc_nulls_last("max_cvss"), "project", "name").limit(n)


def dep_chain(g: Graph, component_id: str, n: int = 5, scans: DataFrame | None = None) -> DataFrame:
    """q6: shortest chains from roots to a component, per scan the ``n`` with the fewest hops."""
    scans = latest_sboms(g.sboms) if scans is None else scans
    targets = g.has_component.filter(F.col("component_id") == component_id).join(scans.select("scan_id"), "scan_id", "left_semi").select("scan_id", "component_id")
    chains = dependency_chains(g, targets)
    first = Window.partitionBy("scan_id", "target").orderBy("hops", "chain")
    return chains.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= n).drop("n")


def vuln_chains(g: Graph, vuln: str, closest: int = 3, n: int = 8) -> DataFrame:
    """q13: chains to the ``closest`` affected components of each scan, at most ``n`` a scan."""
    rows = exposures(g).filter(X.matches_vuln(F.col("vuln"), F.col("aliases"), vuln)).select("scan_id", "component_id", "depth").distinct()
    near = Window.partitionBy("scan_id").orderBy(F.col("depth").asc_nulls_last(), "component_id")
    targets = rows.withColumn("k", F.row_number().over(near)).filter(F.col("k") <= closest).select("scan_id", "component_id", "depth")
    chains = dependency_chains(g, targets.drop("depth")).join(targets.withColumnsRenamed({"component_id": "target", "depth": "target_depth"}), ["scan_id", "target"])
    first = Window.partitionBy("scan_id").orderBy("target_depth", "hops", "target", "chain")
    return chains.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= n).drop("n")


def components_for_vuln(g: Graph, vuln: str) -> DataFrame:
    """q14: distinct affected components, nearest first."""
    rows = exposures(g).filter(X.matches_vuln(F.col("vuln"), F.col("aliases"), vuln))
    return rows.select("project", "component_id", "name", "version", "depth").distinct().orderBy("depth", "name", "project", "component_id")


BUNDLES = {
    "dev_explain": ("q2", "q6"),
    "explainability_mode": ("q2", "q6"),
    "arch_impact": ("q2", "q6"),
    "manager_brief": ("q1", "q7", "q8"),
    "triage_queue": ("q3", "q4"),
    "multi_audience": ("q9", "q2", "q6"),
    "project_overview": ("q9",),
    "stakeholder": ("q9", "q10", "q11", "q12"),
    "developer": ("q10", "q2", "q14", "q13", "q6"),
}


def bundle(g: Graph, name: str, project: str, vuln: str, component_id: str, since: str) -> dict[str, DataFrame]:
    """The frames of a named bundle; each is built only if the bundle has it."""
    builders = {
        "q1": lambda: top_risky_projects(g),
        "q2": lambda: impact(g, project, vuln),
        "q3": lambda: quick_wins(g),
        "q4": lambda: no_fix(g),
        "q6": lambda: dep_chain(g, component_id),
        "q7": lambda: kev_queue(g),
        "q8": lambda: recent(g, since),
        "q9": lambda: project_summary(g),
        "q10": lambda: alert_inventory(g, project),
        "q11": lambda: top_components(g),
        "q12": lambda: latest_scan_metadata(g),
        "q13": lambda: vuln_chains(g, vuln, 5, 15),
        "q14": lambda: components_for_vuln(g, vuln),
    }
    return {q: builders[q]() for q in BUNDLES[name]}


def labelled_union(frames: dict[str, DataFrame]) -> DataFrame:
    """All rows of a bundle under one schema, with the query they come from."""
    out = None
    for name, df in frames.items():
        one = df.withColumn("_query", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out
