"""Rows of alerts are dealt by project once, before a component's advisories are expanded, and moved no more."""

import json
import re

import pytest
from pyspark.sql import functions as F

from vulnloom.operators import alerts, cases, reports
from vulnloom.plans import catalog

SF = "/root/testdata/sf0.001"


def moved(df) -> list[str]:
    """Shuffles that lie above an expansion of advisories in the plan, outermost first."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda line: len(re.match(r"[\s:+\-*]*(\(\d+\) )?", line)[0])
    out = []
    assert any("Generate explode(_vulns" in line for line in lines)
    for k, line in enumerate(lines):
        if "Generate explode(_vulns" in line:
            at = depth(line)
            for above in reversed(lines[:k]):
                if depth(above) < at:
                    at = depth(above)
                    out += [above.strip()] if " Exchange " in above else []
    return out


@pytest.mark.parametrize("name", ["alerts_all", "alert_cases", "action_counts", "affected_areas", "alerts_enterprise", "predicate_number_in", "portfolio_projects", "remediation_clusters", "top_clusters", "snapshot_delta", "q1_top_risky_projects", "q9_project_summary", "q11_top_components"])
def test_alerts_are_not_moved(spark, name):
    assert not moved(catalog.queries()[name](spark, SF))


def test_verdicts_of_internal_ids(spark):
    """Looked up beside the aggregate as by joins after it."""
    g = catalog.graph(spark, SF)
    joined = alerts.with_reachability(alerts.group_alerts(alerts.exposures(g)), g.reachability)
    columns = ["project", "vuln_id", "internal_id", "reachability_verdict", "call_locations", "risk_score"]
    assert sorted(alerts.alerts(g).select(columns).collect()) == sorted(joined.select(columns).collect())


def test_advisories_beyond_the_bound(spark):
    g = catalog.graph(spark, SF)
    count = lambda df: sorted(df.groupBy("project", "vuln_id").count().collect())
    assert count(alerts.exposures(g, most_advisories=0)) == count(alerts.exposures(g))


def test_repeated_keys_of_snapshots(spark):
    """A key that a side has twice gives each pair, and sides without it give rows of their own."""
    made = lambda rows: spark.createDataFrame([(*r, "likely_reachable", True, "new") for r in rows], "project string, vuln_id string, component_id string, risk_score double, reachability_verdict string, fix_available boolean, status string")
    found = cases.delta(made([("p", "a", None, 1.0), ("p", "a", None, 2.0), ("p", "b", "c", 3.0)]), made([("p", "a", None, 4.0), ("q", "a", None, 5.0)]))
    assert sorted((r.project, r.vuln_id, r.old_risk_score or 0, r.new_risk_score or 0) for r in found.collect()) == [("p", "a", 1, 4), ("p", "a", 2, 4), ("p", "b", 3, 0), ("q", "a", 0, 5)]


@pytest.mark.parametrize(("name", "times"), [("report_developer", 2), ("report_narrative", 2)])
def test_cases_are_made_once(spark, name, times):
    """A report reads its cases once: alerts, and the states of the test tables, expand advisories (once each), and nothing moves or is stored."""
    df = catalog.queries()[name](spark, SF)
    assert not moved(df)
    assert df._jdf.queryExecution().executedPlan().toString().count("Generate explode(_vulns") == times


def test_heatmap_makes_alerts_once(spark):
    plan = catalog.queries()["portfolio_heatmap"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode(_vulns") == 1


def test_kpis_move_sums_not_alerts(spark):
    """What is shuffled is one row per vulnerability and task."""
    found = moved(catalog.queries()["portfolio_kpis"](spark, SF))
    assert found and all("hashpartitioning(vuln_id" in x or "SinglePartition" in x for x in found)


@pytest.mark.parametrize("by", ["risk", "severity", "depth"])
def test_lists_make_their_winners_alone(spark, by):
    """The list is ranked on few fields; what is made in full is joined with the winners of that ranking."""
    plan = catalog.queries()[f"alert_list_by_{by}"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan


def test_stakeholder_report_of_one_aggregate(spark):
    """It reads its cases once, moves and stores nothing, and says what its parts say one by one."""
    df = catalog.queries()["report_stakeholder"](spark, SF)
    assert not moved(df)
    assert df._jdf.queryExecution().executedPlan().toString().count("Generate explode(_vulns") == 2
    found = catalog._cases(catalog.graph(spark, SF)).withColumn("status", F.when(F.col("project") == catalog.PROJECT, "verified_closed").otherwise(F.col("status")))
    rows = {r.project: json.loads(r.report) for r in reports.stakeholder_report(found).collect()}
    one = lambda df: {r.project: {k: v for k, v in r.asDict().items() if k != "project"} for r in df.collect()}
    assert one(reports.posture(found)) == {p: r["posture"] for p, r in rows.items() if "posture" in r}
    assert one(reports.action_counts(found)) == {p: r["counts"] for p, r in rows.items()}
    assert one(reports.impact(found)) == {p: r["impact"] for p, r in rows.items() if "impact" in r}
    listed = lambda df, *cols: sorted((r.project, r["rank"], *[r[c] for c in cols]) for r in df.collect())
    told = lambda name, *cols: sorted((p, x["rank"], *[x[c] for c in cols]) for p, r in rows.items() for x in r.get(name, []))
    assert listed(reports.affected_areas(found), "title", "cases", "vulns", "focus") == told("areas", "title", "cases", "vulns", "focus")
    assert listed(reports.top_clusters(reports.clusters(found)), "component", "tier", "cases", "vulns") == told("priorities", "component", "tier", "cases", "vulns")
    assert set(rows[catalog.PROJECT]) == {"counts", "actions"} and rows[catalog.PROJECT]["counts"]["open"] == 0
