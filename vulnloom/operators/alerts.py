"""Alerts: what the latest scan of each project is exposed to, one row per project and canonical vulnerability.

The join order follows sizes: the latest scan per project first (a window over scans), then its components, then
advisories.  A component has many advisories, so what is dealt out is one row per component with the ids of its advisories; they
are expanded where the project's rows lie, and everything that is asked per project or alert stays there.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vulnloom.functions import exprs as X
from vulnloom.sources.testbed import Graph


def latest_sboms(sboms: DataFrame) -> DataFrame:
    """The newest scan of each project; a null time counts as newest, ties go to the larger scan id."""
    newest = Window.partitionBy("project").orderBy(F.col("generated_at").desc_nulls_first(), F.col("scan_id").desc())
    return sboms.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


#: Advisories up to which their table is sent to every task; more are joined by a shuffle, with the same rows.
MOST_ADVISORIES = 1 << 19


def _advisories(g: Graph, most: int = MOST_ADVISORIES) -> DataFrame:
    found = g.vulns.withColumnRenamed("id", "vuln").withColumn("vuln_id", X.canonical_vuln_id(F.col("vuln"), F.col("aliases")))
    return F.broadcast(found) if g.advisories <= most else found


def exposures(g: Graph, scans: DataFrame | None = None, most_advisories: int = MOST_ADVISORIES) -> DataFrame:
    """(project, scan, component, vulnerability) rows of ``scans`` (by default the latest ones), dealt by project."""
    scans = latest_sboms(g.sboms) if scans is None else scans
    known = g.affected_by.groupBy("component_id").agg(F.collect_list("vuln").alias("_vulns"))
    parts = scans.join(g.projects, "project").join(g.has_component, "scan_id").join(g.components, "component_id").join(known, "component_id")
    rows = parts.repartition(g.partitions, "project").withColumn("vuln", F.explode("_vulns")).drop("_vulns")
    return rows.join(_advisories(g, most_advisories), "vuln")


def _alert_columns() -> list[Column]:
    return [
        F.min("vuln").alias("internal_id"),
        F.collect_list(F.when(F.col("vuln").isNotNull(), F.struct("component_id", "name", "version", "scope", "fix_versions"))).alias("_parts"),
        F.max("cvss").alias("cvss"),
        F.max("epss").alias("epss"),
        F.max("kev").alias("kev"),
        F.min("cwe").alias("cwe"),
        F.min("published").alias("published"),
        F.max("modified").alias("modified"),
        F.min("depth").alias("closest_depth"),
    ]


ALERT_KEYS = ("project", "scan_id", "generated_at", "source_commit", "vuln_id")


def group_alerts(rows: DataFrame, keys: tuple[str, ...] = ALERT_KEYS, *more: Column) -> DataFrame:
    """One row per alert, in one aggregate: an alert's few components are gathered once, and every set is taken from them."""
    one = rows.groupBy(*keys).agg(*_alert_columns(), *more)
    found = lambda c: F.array_distinct(F.array_compact(F.transform("_parts", lambda x: x[c])))
    sets = {
        "all_components": found("name"),
        "all_component_ids": found("component_id"),
        "all_versions": found("version"),
        "component_count": F.size(found("component_id")).cast("long"),
        "fix_versions": F.array_sort(F.flatten(found("fix_versions"))),
        "all_scopes": found("scope"),
    }
    return one.withColumns(sets).drop("_parts")


def merged_verdicts(reach: DataFrame, ranks: dict[str, int] = X.VERDICT_RANK) -> DataFrame:
    """(project, vuln_id, reachability_verdict, call_locations): the strongest verdict; locations in order of first sight."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "call_locations")))
    places = F.array_distinct(F.flatten(F.transform(ordered, lambda x: X.strings(x["call_locations"]))))
    strongest = F.max(F.struct(X.verdict_rank(F.col("verdict"), ranks), "verdict"))["verdict"]
    return reach.groupBy("project", "vuln_id").agg(strongest.alias("reachability_verdict"), places.alias("call_locations"))


def with_reachability(alerts: DataFrame, reach: DataFrame, weights: X.RiskWeights = X.RiskWeights()) -> DataFrame:
    """Adds verdict, call locations, factor, risk score and severity; the canonical id is looked up before the internal one."""
    verdicts = merged_verdicts(reach)
    named = lambda n: verdicts.select(F.col("project").alias(f"{n}_p"), F.col("vuln_id").alias(f"{n}_v"), F.col("reachability_verdict").alias(f"{n}_verdict"), F.col("call_locations").alias(f"{n}_calls"))
    met = alerts.join(named("a"), (F.col("project") == F.col("a_p")) & (F.col("vuln_id") == F.col("a_v")), "left")
    met = met.join(named("b"), (F.col("project") == F.col("b_p")) & (F.col("internal_id") == F.col("b_v")), "left")
    verdict = F.coalesce("a_verdict", "b_verdict")
    calls = F.when(F.col("a_verdict").isNotNull(), F.col("a_calls")).otherwise(F.col("b_calls"))
    met = met.withColumn("reachability_verdict", F.coalesce(verdict, F.lit("no_sink_data"))).withColumn("call_locations", X.strings(calls))
    met = met.drop("a_p", "a_v", "a_verdict", "a_calls", "b_p", "b_v", "b_verdict", "b_calls")
    return scored(met, weights)


def _said(g: Graph, reach: DataFrame) -> DataFrame:
    """(project, vuln_id, _said): merged verdicts under the canonical ids of the alerts that may look them up.

    A verdict on an advisory's own id also goes under the canonical one, with ``raw``: it counts where it is the internal id.
    """
    merged = merged_verdicts(reach.repartition(g.partitions, "project"))
    known = _advisories(g).select(F.col("vuln").alias("vuln_id"), F.col("vuln_id").alias("_canonical"))
    said = lambda raw: F.struct(raw.cast("string").alias("raw"), F.col("reachability_verdict").alias("verdict"), F.col("call_locations").alias("calls")).alias("s")
    at = F.array_compact(F.array(F.struct(F.col("vuln_id").alias("v"), said(F.lit(None))), F.when(F.col("_canonical") != F.col("vuln_id"), F.struct(F.col("_canonical").alias("v"), said(F.col("vuln_id"))))))
    return merged.join(known, "vuln_id", "left").select("project", F.explode(at).alias("a")).select("project", F.col("a.v").alias("vuln_id"), F.col("a.s").alias("_said"))


def found_alerts(g: Graph, group: Callable[..., DataFrame], keys: tuple[str, ...] = ALERT_KEYS, scans: DataFrame | None = None, reach: DataFrame | None = None, states: DataFrame | None = None) -> DataFrame:
    """Alerts of ``scans`` with their verdict and call locations, and their ``states`` if any are given.

    Everything is dealt by project once, the exposures as one row per component: what is looked up for an alert joins the rows
    it is made of, in the same aggregate (``group``), so that alerts, of which there are many, are moved nowhere.
    """
    scans = latest_sboms(g.sboms) if scans is None else scans
    rows = exposures(g, scans)
    asked = _said(g, g.reachability if reach is None else reach)
    gathered = [F.collect_list("_said").alias("_said")]
    if states is not None:
        kept = F.struct(F.coalesce("component_id", F.lit("")).alias("component_id"), "status", "owner", "note")
        asked = asked.unionByName(states.repartition(g.partitions, "project").select("project", "vuln_id", kept.alias("_state")), allowMissingColumns=True)
        gathered.append(F.collect_list("_state").alias("states"))
    of_scans = scans.join(g.projects, "project").select(*[k for k in keys if k != "vuln_id"]).repartition(g.partitions, "project")
    rows = rows.unionByName(asked.join(of_scans, "project"), allowMissingColumns=True)
    one = group(rows, keys, *gathered).filter("internal_id IS NOT NULL")
    a, b = [F.get(F.filter("_said", f), F.lit(0)) for f in (lambda x: x["raw"].isNull(), lambda x: x["raw"] == F.col("internal_id"))]
    verdict = F.coalesce(a["verdict"], b["verdict"], F.lit("no_sink_data"))
    calls = F.when(a["verdict"].isNotNull(), a["calls"]).otherwise(b["calls"])
    return one.withColumns({"reachability_verdict": verdict, "call_locations": X.strings(calls)}).drop("_said")


def scored(alerts: DataFrame, weights: X.RiskWeights = X.RiskWeights()) -> DataFrame:
    factor = X.reach_factor(F.col("reachability_verdict"))
    risk = X.risk_score(F.col("cvss"), F.col("epss"), F.col("kev"), F.col("all_scopes"), factor, weights)
    return alerts.withColumns({"reachability_factor": factor, "risk_score": risk, "severity": X.severity(F.col("cvss"), F.col("kev"))})


def alerts(g: Graph, weights: X.RiskWeights = X.RiskWeights(), scans: DataFrame | None = None, states: DataFrame | None = None) -> DataFrame:
    return scored(found_alerts(g, group_alerts, ALERT_KEYS, scans, states=states), weights)


def by_risk(df: DataFrame) -> list[Column]:
    return [F.col("risk_score").desc_nulls_last(), F.col("closest_depth").asc_nulls_last(), F.col("published").desc_nulls_last(), F.col("project"), F.col("vuln_id")]


def _few_fields(g: Graph, weights: X.RiskWeights) -> DataFrame:
    """Alerts in the fields that a score needs alone."""
    few = lambda rows, keys, *more: rows.groupBy(*keys).agg(
        F.min("vuln").alias("internal_id"), F.max("cvss").alias("cvss"), F.max("epss").alias("epss"), F.max("kev").alias("kev"),
        F.min("published").alias("published"), F.min("depth").alias("closest_depth"), F.max(X.scope_class(F.col("scope"))).alias("_scope"), *more,
    )
    reach = g.reachability.select("project", "vuln_id", "verdict", "seq", F.array().cast("array<string>").alias("call_locations"))
    narrow = found_alerts(g, few, ("project", "scan_id", "vuln_id"), reach=reach)
    return scored(narrow.withColumn("all_scopes", X.scopes_of(F.col("_scope"))).drop("_scope"), weights)


def _unscored(g: Graph) -> DataFrame:
    """Alerts in the numbers of their exposures, which no verdict is needed for."""
    return exposures(g).groupBy("project", "scan_id", "vuln_id").agg(F.max("cvss").alias("cvss"), F.min("depth").alias("closest_depth"))


def _within(g: Graph, projects: list[str], scans: list[str]) -> Graph:
    """The graph's edges and verdicts that a few scans of a few projects need."""
    edges = g.has_component.filter(F.col("scan_id").isin(scans))
    affected = g.affected_by.join(F.broadcast(edges.select("component_id").distinct()), "component_id", "left_semi")
    return replace(g, has_component=edges, affected_by=affected, reachability=g.reachability.filter(F.col("project").isin(projects)))


def top_alerts(g: Graph, n: int = 20, weights: X.RiskWeights = X.RiskWeights(), order: Callable[[DataFrame], list[Column]] = by_risk, by_score: bool = True) -> DataFrame:
    """The ``n`` alerts first in ``order`` (a total one): ranked on what it needs alone, then made in full for their scans.

    An order that needs neither verdicts nor scores (``by_score``), but cvss or depth, is told from the exposures.
    """
    keys = ("project", "scan_id", "vuln_id")
    ranked = _few_fields(g, weights) if by_score else _unscored(g)
    first = [tuple(r) for r in ranked.orderBy(*order(ranked)).select(*keys).limit(n).collect()]
    wanted = g.sboms.sparkSession.createDataFrame(first, "project string, scan_id string, vuln_id string")
    scans = latest_sboms(g.sboms).filter(F.col("scan_id").isin([r[1] for r in first]))
    full = alerts(_within(g, [r[0] for r in first], [r[1] for r in first]), weights, scans).join(wanted, list(keys), "left_semi")
    return full.orderBy(*order(full)).limit(n)


def two_sources(stored_rows: DataFrame, landed: DataFrame) -> DataFrame:
    """Reachability rows of the store with landed ones on top: their order continues the store's, so merges see them later.

    Landed verdicts and locations may be missing; a missing verdict is no_sink_data.
    """
    columns = ["project", "vuln_id", F.coalesce("verdict", F.lit("no_sink_data")).alias("verdict"), X.strings(F.col("call_locations")).alias("call_locations"), "seq", "source"]
    both = stored_rows.withColumn("source", F.lit(0)).select(*columns).unionByName(landed.withColumn("source", F.lit(1)).select(*columns))
    return both.filter("vuln_id IS NOT NULL AND vuln_id <> ''").withColumn("seq", F.struct("source", "seq")).drop("source")


def with_findings(rows: DataFrame) -> DataFrame:
    """Enterprise rows without the ones that only say a scan has no finding."""
    return rows.filter("NOT (vuln_id IS NULL AND internal_id IS NULL AND coalesce(component_count, 0) = 0)")


def enterprise_alerts(g: Graph, projects: list[str] | None = None) -> DataFrame:
    """Alerts of several projects; a latest scan without findings is kept as one row without a vulnerability."""
    scans = latest_sboms(g.sboms)
    if projects is not None:
        scans = scans.filter(F.col("project").isin(projects))
    found = group_alerts(exposures(g, scans)).drop("scan_id", "generated_at", "source_commit")
    # A project has one latest scan, and its alerts lie where its other rows do.
    latest = scans.select("project", "scan_id", "generated_at", "source_commit").repartition(g.partitions, "project")
    return latest.hint("shuffle_hash").join(found, "project", "left")


def workbench_rows(g: Graph, now: Column) -> DataFrame:
    """Alerts in the fields of the query language, defaults filled in."""
    keys = ("project", "language", "package_manager", "scan_id", "generated_at", "source_commit", "vuln_id")
    rows = scored(found_alerts(g, group_alerts, keys))
    clean = lambda c: F.filter(X.strings(F.col(c)), lambda x: x.isNotNull() & (x != ""))
    fixes = clean("fix_versions")
    return rows.select(
        "project",
        F.coalesce("language", F.lit("Unknown")).alias("language"),
        F.coalesce("package_manager", F.lit("Unknown")).alias("package_manager"),
        "vuln_id",
        "internal_id",
        "severity",
        "cvss",
        "epss",
        F.coalesce("kev", F.lit(False)).alias("kev"),
        "risk_score",
        "reachability_verdict",
        X.is_reachable(F.col("reachability_verdict")).alias("is_reachable"),
        F.arrays_overlap(clean("all_scopes"), F.array(F.lit("required"), F.lit("runtime"))).alias("is_runtime"),
        (F.size(fixes) > 0).alias("fix_available"),
        F.size(fixes).alias("fix_versions_count"),
        fixes.alias("fix_versions"),
        clean("all_components").alias("all_components"),
        clean("all_component_ids").alias("all_component_ids"),
        F.col("component_count").cast("int").alias("component_count"),
        clean("all_scopes").alias("all_scopes"),
        "closest_depth",
        clean("cwe").alias("cwe"),
        "published",
        "modified",
        X.days_ago(F.col("published"), now).alias("published_days_ago"),
        X.days_ago(F.col("modified"), now).alias("modified_days_ago"),
        clean("call_locations").alias("call_locations"),
        F.size(clean("call_locations")).alias("call_locations_count"),
    )


def project_stats(g: Graph) -> DataFrame:
    """Counts per project over vulnerabilities: per vulnerability the maximum, then conditional counts (no CVSS is low)."""
    per_vuln = exposures(g).groupBy("project", "vuln_id").agg(F.max("cvss").alias("cvss"), F.max("kev").alias("kev"), F.max(F.size("fix_versions")).alias("fixes"))
    c = F.col("cvss")
    return per_vuln.groupBy("project").agg(
        F.count("*").alias("total"),
        F.count_if(c >= 9).alias("critical"),
        F.count_if((c >= 7) & (c < 9)).alias("high"),
        F.count_if((c >= 4) & (c < 7)).alias("medium"),
        F.count_if(c.isNull() | (c < 4)).alias("low"),
        F.count_if("kev").alias("kev"),
        F.count_if(F.col("fixes") > 0).alias("with_fix"),
    )


def vuln_detail(g: Graph, vuln: str) -> DataFrame:
    """Every affected component of a vulnerability's latest scans, with the places that declare it in that scan."""
    rows = exposures(g).filter(X.matches_vuln(F.col("vuln"), F.col("aliases"), vuln))
    places = g.declared_in.groupBy("scan_id", "component_id").agg(F.collect_set("path").alias("paths"), F.count("*").alias("places"))
    met = rows.join(places, ["scan_id", "component_id"], "left")
    keys = ["project", "scan_id", "name", "version", "component_id", "vuln_id", "cwe", "fix_versions", "summary", "aliases", "paths", "places", "depth", "is_direct", "scope"]
    return met.groupBy(*keys).agg(F.max("cvss").alias("cvss"), F.max("epss").alias("epss"), F.max("kev").alias("kev"), F.min("published").alias("published"), F.max("modified").alias("modified"))


def fingerprint(g: Graph) -> DataFrame:
    """One row that changes when data do: counts and newest times, with a token of them."""
    scans = g.sboms.agg(F.count_distinct("project").alias("projects"), F.count_distinct("scan_id").alias("scans"), F.max("generated_at").alias("newest_scan"))
    vulns = g.vulns.agg(F.count_distinct("id").alias("vulns"), F.max("modified").alias("newest_vuln"))
    comps = g.components.agg(F.count_distinct("component_id").alias("components"))
    one = scans.join(vulns, F.lit(True)).join(comps, F.lit(True))
    return one.withColumn("token", F.concat_ws("|", *[F.col(c).cast("string") for c in ("projects", "scans", "vulns", "components", "newest_scan", "newest_vuln")]))


def statistics(g: Graph) -> DataFrame:
    named = {"projects": g.projects, "sboms": g.sboms, "components": g.components, "vulnerabilities": g.vulns, "affected_by": g.affected_by, "reachability": g.reachability}
    out = None
    for name, df in named.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n")
        out = one if out is None else out.union(one)
    return out


def latest_scan_metadata(g: Graph) -> DataFrame:
    """The latest scan of every project with its vulnerability count and newest change; scans without findings stay."""
    found = exposures(g).groupBy("project", "scan_id").agg(F.count_distinct("vuln_id").alias("vuln_count"), F.max("modified").alias("last_modified"))
    latest = latest_sboms(g.sboms).join(found.drop("project"), "scan_id", "left")
    return latest.select("project", "scan_id", "generated_at", "source_commit", "branch", F.coalesce("vuln_count", F.lit(0)).cast("long").alias("vuln_count"), "last_modified")
