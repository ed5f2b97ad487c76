"""Report content as frames: areas, clusters, posture, counts and the nested report rows.

Texts are composed from aggregates at the end; nothing is collected.  Where order matters (first five vulnerabilities, the
last reason that applies) the order is part of the aggregate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vulnloom.functions import exprs as X
from vulnloom.operators.cases import CLOSED

TIER_ORDER = {"fix_now": 0, "plan_remediation": 1, "mitigate": 2, "monitor": 3, "accept": 4}
AREA_ALL = "Repository-Wide Exposure"


def active(cases: DataFrame) -> DataFrame:
    return cases.filter(~F.col("status").isin(*CLOSED))


def case_order(confirmed_first: bool = False) -> list[Column]:
    """Order of cases in a report: closed last, then by tier, exploitation, (confirmed evidence,) risk and severity."""
    order = [F.col("status").isin(*CLOSED).asc()] if not confirmed_first else []
    order += [X.lookup(F.col("decision_tier"), TIER_ORDER, F.lit(9)).asc(), F.coalesce("kev", F.lit(False)).desc()]
    order += [(F.col("reachability_verdict") == "confirmed_reachable").desc()] if confirmed_first else []
    return [*order, F.col("risk_score").desc_nulls_last(), F.col("cvss").desc_nulls_last(), F.col("vuln_id").asc(), F.col("component_id").asc()]


def evidence_order(rank: str = "rank", most: int | None = None, by: tuple[str, ...] = ("project",)) -> Callable[[DataFrame], DataFrame]:
    """Numbers call evidence per ``by``: confirmed calls first, of these production code, then by vulnerability."""
    order = [(F.col("reachability_verdict") == "confirmed_reachable").desc_nulls_last(), (F.col("evidence_scope") == "production").desc_nulls_last(), "vuln_id", "component_id"]

    def numbered(cases: DataFrame) -> DataFrame:
        out = cases.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
        return out if most is None else out.filter(F.col(rank) <= most)

    return numbered


def action_counts(cases: DataFrame) -> DataFrame:
    """Per project: cases by tier, with a fix, reachable, open."""
    tier = lambda *t: F.count_if(F.col("decision_tier").isin(*t))
    return cases.groupBy("project").agg(
        F.count("*").alias("total"), tier("fix_now").alias("fix_now"), tier("plan_remediation").alias("plan"), tier("mitigate").alias("mitigate"), tier("monitor", "accept").alias("monitor"),
        F.count_if("has_fix").alias("with_fix"), F.count_if(X.is_reachable(F.col("reachability_verdict"))).alias("reachable"), F.count_if(~F.col("status").isin(*CLOSED)).alias("open"),
    )


def posture_level() -> Column:
    """Elevated, moderate or low, by the counts of open cases."""
    return F.when((F.col("kev") > 0) | (F.col("confirmed") > 0) | (F.col("fix_now") > 0), "elevated").when((F.col("critical_high") > 0) | (F.col("likely") > 0), "moderate").otherwise("low")


def posture(cases: DataFrame) -> DataFrame:
    """Per project over open cases: counts and elevated, moderate or low."""
    one = active(cases).groupBy("project").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("severity").isin("critical", "high")).alias("critical_high"),
        F.count_if("kev").alias("kev"),
        F.count_if(F.col("reachability_verdict") == "confirmed_reachable").alias("confirmed"),
        F.count_if(F.col("reachability_verdict") == "likely_reachable").alias("likely"),
        F.count_if(F.col("decision_tier") == "fix_now").alias("fix_now"),
    )
    return one.withColumn("posture", posture_level())


def impact(cases: DataFrame) -> DataFrame:
    """Per project: direct (depth to 1, or unknown) and transitive open cases."""
    depth = F.coalesce("closest_depth", F.lit(0))
    return active(cases).groupBy("project").agg(F.count_if(depth <= 1).alias("direct"), F.count_if(depth > 1).alias("transitive"))


def case_area(cases: DataFrame) -> DataFrame:
    """Cases with ``area``: of the first call location that is no test, else general."""
    live = F.get(F.filter(X.strings(F.col("call_locations")), lambda x: ~X.is_test_location(x)), F.lit(0))
    return cases.withColumn("area", F.when(live.isNotNull(), X.functional_area(live)).otherwise("general"))


def affected_areas(cases: DataFrame, most: int = 3) -> DataFrame:
    """Per project the ``most`` busiest areas: cases, first five vulnerabilities, and why to look there.

    A project all of whose cases are general has one area, the whole repository.
    """
    rows = case_area(active(cases))
    ranked = rows.withColumn("k", F.row_number().over(Window.partitionBy("project").orderBy(*case_order())))
    reason = F.when(F.col("decision_tier") == "fix_now", "needs a fix now").when(F.col("has_fix"), "an upgrade is available").when(X.is_reachable(F.col("reachability_verdict")), "reachable code")
    one = ranked.groupBy("project", "area").agg(
        F.count("*").alias("cases"),
        F.array_sort(F.collect_list(F.struct("k", "vuln_id"))).alias("_v"),
        F.max(F.when(reason.isNotNull(), F.struct("k", reason.alias("why")))).alias("_r"),
        F.bool_or(F.col("decision_tier") == "fix_now").alias("urgent"),
        F.min("k").alias("first"),
    )
    one = one.withColumn("vulns", F.array_join(F.slice(F.transform("_v", lambda x: x["vuln_id"]), 1, 5), "|")).withColumn("focus", F.coalesce(F.col("_r.why"), F.lit("keep watching")))
    order = Window.partitionBy("project").orderBy(F.desc("urgent"), F.desc("cases"), "first")
    lone = F.count("*").over(Window.partitionBy("project")) == 1
    named = one.withColumn("rank", F.row_number().over(order)).withColumn("title", F.when(lone & (F.col("area") == "general"), AREA_ALL).otherwise(X.pretty_area(F.col("area"))))
    return named.filter(F.col("rank") <= most).select("project", "rank", "title", "cases", "urgent", "vulns", "focus")


CLUSTER_KEYS = ("component", "version", "area_key", "tier")


def clusters(cases: DataFrame) -> DataFrame:
    """Remediation clusters: open cases that one upgrade in one place answers.

    Keyed by component, version, area and tier without case; represented by the case that comes first in report order.
    """
    return _grouped(active(cases))


def _grouped(cases: DataFrame, by: tuple[str, ...] = (), *more: Column) -> DataFrame:
    """Cases by cluster, and by the columns of ``by``, with ``more`` aggregates."""
    rows = case_area(cases).withColumns({"component": F.lower("component_name"), "version": F.lower(F.coalesce("component_version", F.lit(""))), "area_key": F.lower("area"), "tier": F.lower("decision_tier")})
    ranked = rows.withColumn("k", F.row_number().over(Window.partitionBy("project").orderBy(*case_order(True))))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("k", "vuln_id"))), lambda x: x["vuln_id"])
    places = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", X.strings(F.col("call_locations")).alias("c")))), lambda x: x["c"])))
    fixes = X.preferred_version(F.flatten(F.collect_list(X.strings(F.col("fix_versions")))))
    return ranked.groupBy("project", *CLUSTER_KEYS, *by).agg(
        F.min_by("vuln_id", "k").alias("lead"),
        F.count("*").alias("cases"),
        F.array_join(F.array_distinct(ids), "|").alias("vulns"),
        F.array_join(F.slice(places, 1, 5), "|").alias("places"),
        fixes.alias("target_version"),
        F.bool_or("has_fix").alias("any_fix"),
        F.max("risk_score").alias("max_risk"),
        F.max("cvss").alias("max_cvss"),
        F.bool_or(F.coalesce("kev", F.lit(False))).alias("any_kev"),
        F.max(F.struct(X.verdict_rank(F.col("reachability_verdict"), X.EVIDENCE_RANK), "reachability_verdict"))["reachability_verdict"].alias("verdict"),
        F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(F.col("severity") == "high").alias("high"),
        F.count_if(F.col("evidence_scope") == "production").alias("production"),
        F.count_if(F.col("evidence_scope") == "test").alias("test_only"),
        F.count_if(F.col("evidence_scope") == "mixed").alias("mixed"),
        *more,
    )


def all_groups(cases: DataFrame, *more: Column) -> DataFrame:
    """Clusters of open cases (``open``) and, beside them, groups of closed ones, with ``more`` counts.

    What a report says of clusters, of open and of all cases follows from these rows, which lie where a project's cases do.
    """
    is_open = F.coalesce(~F.col("status").isin(*CLOSED), F.lit(False))
    return _grouped(cases.withColumn("open", is_open), ("open",), *more)


def cluster_order() -> list[Column]:
    """Order of clusters in a report: by tier, evidence, a fix, risk and severity, then by identity."""
    return [X.lookup(F.col("tier"), TIER_ORDER, F.lit(9)), X.verdict_rank(F.col("verdict"), X.EVIDENCE_RANK).desc(), F.desc("any_fix"), F.desc_nulls_last("max_risk"), F.desc_nulls_last("max_cvss"), F.col("component"), F.col("version"), F.col("area_key")]


def top_clusters(grouped: DataFrame, most: int = 4) -> DataFrame:
    """Per project the first clusters, with how many cases they cover of all."""
    w = Window.partitionBy("project")
    ranked = grouped.withColumn("rank", F.row_number().over(w.orderBy(*cluster_order()))).withColumn("all_cases", F.sum("cases").over(w))
    covered = F.sum(F.when(F.col("rank") <= most, F.col("cases"))).over(w)
    return ranked.withColumn("covered", covered).withColumn("uncovered", F.col("all_cases") - F.col("covered")).filter(F.col("rank") <= most)


def actions_of(counts: str = "") -> Column:
    """Up to four actions, in order of urgency, by the counts of a project."""
    text = lambda c, f: F.when(F.col(f"{counts}{c}") > 0, F.format_string(f, F.col(f"{counts}{c}")))
    actions = F.array_compact(F.array(text("fix_now", "Fix %d reachable findings now"), text("plan", "Schedule %d upgrades"), text("mitigate", "Put %d temporary controls in place"), text("open", "Review %d open findings")))
    return F.array_join(F.slice(actions, 1, 4), "; ")


def management_actions(counts: DataFrame) -> DataFrame:
    """Per project up to four actions, in order of urgency."""
    return counts.select("project", actions_of().alias("actions"))


def evidence_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("total"), F.count_if("kev").alias("kev"), F.count_if(F.size("fix_versions") > 0).alias("with_fix"), F.count_if(F.size("fix_versions") == 0).alias("without_fix"),
        F.max("cvss").alias("max_cvss"), F.count_if(F.size("call_locations") == 0).alias("without_location"),
    )


REPORT_COLUMNS = (
    "project", "vuln_id", "component_id", "component_name", "component_version", "status", "decision_tier", "kev", "severity", "reachability_verdict", "risk_score", "cvss", "closest_depth",
    "has_fix", "fix_versions", "call_locations", "evidence_scope",
)


def stakeholder_report(cases: DataFrame, areas: int = 3, first: int = 4) -> DataFrame:
    """(project, report): posture, counts, impact, areas, first clusters and actions as one JSON text a project.

    All are made of one aggregate of the cases, where they lie: groups of cases are gathered by area, and areas by project.
    """
    tier, verdict, depth = F.col("decision_tier"), F.col("reachability_verdict"), F.coalesce("closest_depth", F.lit(0))
    counted = {
        "fix_now": tier == "fix_now", "plan": tier == "plan_remediation", "mitigate": tier == "mitigate", "monitor": tier.isin("monitor", "accept"), "with_fix": F.col("has_fix"), "reachable": X.is_reachable(verdict),
        "critical_high": F.col("severity").isin("critical", "high"), "kev": F.col("kev"), "confirmed": verdict == "confirmed_reachable", "likely": verdict == "likely_reachable", "direct": depth <= 1, "transitive": depth > 1,
    }
    reason = F.when(tier == "fix_now", "needs a fix now").when(F.col("has_fix"), "an upgrade is available").when(X.is_reachable(verdict), "reachable code")
    by_project = Window.partitionBy("project")
    placed = cases.select(*REPORT_COLUMNS).withColumn("place", F.row_number().over(by_project.orderBy(*case_order())))
    of_area = [
        F.slice(F.array_sort(F.collect_list(F.struct("place", "vuln_id"))), 1, 5).alias("_v"), F.max(F.when(reason.isNotNull(), F.struct("place", reason.alias("why")))).alias("_r"),
        F.bool_or(tier == "fix_now").alias("urgent"), F.min("place").alias("first"),
    ]
    grouped = all_groups(placed, *[F.count_if(c).alias(name) for name, c in counted.items()], *of_area)
    ranked = grouped.withColumn("rank", F.row_number().over(Window.partitionBy("project", "open").orderBy(*cluster_order())))
    listed = F.when(F.col("open") & (F.col("rank") <= first), F.struct("rank", "component", "version", "tier", "cases", "target_version", "vulns"))
    one = ranked.groupBy("project", "open", "area_key").agg(
        F.collect_list(listed).alias("priorities"), F.sum("cases").alias("cases"), *[F.sum(c).alias(c) for c in counted],
        F.slice(F.array_sort(F.flatten(F.collect_list("_v"))), 1, 5).alias("_v"), F.max("_r").alias("_r"), F.bool_or("urgent").alias("urgent"), F.min("first").alias("first"),
    )
    of_open = Window.partitionBy("project", "open")
    lone = F.count("*").over(of_open) == 1
    named = one.withColumn("rank", F.row_number().over(of_open.orderBy(F.desc("urgent"), F.desc("cases"), "first"))).withColumn("title", F.when(lone & (F.col("area_key") == "general"), AREA_ALL).otherwise(X.pretty_area(F.col("area_key"))))
    named = named.withColumn("vulns", F.array_join(F.transform("_v", lambda x: x["vuln_id"]), "|")).withColumn("focus", F.coalesce(F.col("_r.why"), F.lit("keep watching")))
    busiest = F.when(F.col("open") & (F.col("rank") <= areas), F.struct("rank", "title", "cases", "vulns", "focus"))
    given = lambda rows: F.when(F.size(rows) > 0, rows)
    opened = lambda c: F.sum(F.when(F.col("open"), F.col(c)))
    whole = named.groupBy("project").agg(
        F.struct(F.sum("cases").alias("total"), *[F.sum(c).alias(c) for c in ("fix_now", "plan", "mitigate", "monitor", "with_fix", "reachable")], F.coalesce(opened("cases"), F.lit(0)).alias("open")).alias("counts"),
        opened("cases").alias("total"), *[opened(c).alias(c) for c in ("critical_high", "kev", "confirmed", "likely", "fix_now", "direct", "transitive")],
        given(F.array_sort(F.collect_list(busiest))).alias("areas"), given(F.array_sort(F.flatten(F.collect_list("priorities")))).alias("priorities"),
    )
    some = F.col("total").isNotNull()
    posture_of = F.when(some, F.struct("total", "critical_high", "kev", "confirmed", "likely", "fix_now", posture_level().alias("posture"))).alias("posture")
    parts = [posture_of, "counts", F.when(some, F.struct("direct", "transitive")).alias("impact"), "areas", "priorities", actions_of("counts.").alias("actions")]
    return whole.select("project", F.to_json(F.struct(*parts)).alias("report"))


def developer_report(cases: DataFrame, immediate: int = 4, backlog: int = 8) -> DataFrame:
    """(project, report): clusters to fix now with their places, the backlog of planned upgrades, and evidence counts.

    All three are made of one aggregate of the cases, where they lie.
    """
    kind = F.when(F.col("open") & (F.col("tier") == "fix_now"), "immediate").when(F.col("open") & F.col("tier").isin("plan_remediation", "mitigate"), "backlog")
    grouped = all_groups(cases, F.count_if(F.col("reachability_verdict") == "no_sink_data").alias("no_sink_data")).withColumn("kind", kind)
    ranked = grouped.withColumn("rank", F.row_number().over(Window.partitionBy("project", "kind").orderBy(*cluster_order())))

    def listed(name: str, most: int, *cols: str) -> Column:
        rows = F.array_sort(F.collect_list(F.when((F.col("kind") == name) & (F.col("rank") <= most), F.struct("rank", *cols))))
        return F.when(F.size(rows) > 0, rows).alias(name)

    out = ranked.groupBy("project").agg(
        listed("immediate", immediate, "component", "version", "verdict", "places", "target_version", "vulns"),
        listed("backlog", backlog, "component", "version", "tier", "target_version"),
        F.struct(F.sum("production").alias("production"), F.sum("test_only").alias("test"), F.sum("mixed").alias("mixed"), F.sum("no_sink_data").alias("no_sink_data")).alias("evidence"),
    )
    return out.select("project", F.to_json(F.struct("immediate", "backlog", "evidence")).alias("report"))


def overview(cases: DataFrame) -> DataFrame:
    """Per project counts of all cases, posture and severe ones of the open cases, and the first cluster, in one aggregate of the cases."""
    counted = {
        "with_fix": F.col("has_fix"), "kev": F.col("kev"), "confirmed": F.col("reachability_verdict") == "confirmed_reachable", "likely": F.col("reachability_verdict") == "likely_reachable",
        **{name: F.col("decision_tier") == tier for name, tier in {"fix_now": "fix_now", "plan": "plan_remediation", "mitigate": "mitigate"}.items()},
    }
    grouped = all_groups(cases, *[F.count_if(c).alias(name) for name, c in counted.items()])
    ranked = grouped.withColumn("rank", F.row_number().over(Window.partitionBy("project", "open").orderBy(*cluster_order())))
    of_open = lambda c: F.sum(F.when(F.col("open"), c))
    one = ranked.groupBy("project").agg(
        F.sum("cases").alias("total"), *[F.sum(c).alias(f"all_{c}") for c in ("fix_now", "plan", "mitigate", "with_fix")],
        of_open(F.col("critical") + F.col("high")).alias("critical_high"), *[of_open(F.col(c)).alias(c) for c in ("kev", "confirmed", "likely", "fix_now")],
        F.max(F.when(F.col("open") & (F.col("rank") == 1), F.struct("component", "version"))).alias("first"),
    )
    return one.select("project", "total", *[F.col(f"all_{c}").alias(c) for c in ("fix_now", "plan", "mitigate", "with_fix")], "critical_high", posture_level().alias("posture"), "first.component", "first.version")
