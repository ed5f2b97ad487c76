"""Alerts made of numbers against alerts made in full."""

import pytest
from pyspark.sql import functions as F

from tests.test_dealing import moved
from vulnloom.operators import alerts, cases, numbers, portfolio
from vulnloom.plans import catalog

SF = "/root/testdata/sf0.001"
FIELDS = ["cvss", "epss", "kev", "closest_depth", "reachability_verdict", "risk_score", "severity"]


def test_narrow_alerts(spark):
    """Field by field, with an advisory that comes twice, one without lists, and verdicts on own and canonical ids."""
    g = catalog.graph(spark, SF)
    odd = g.vulns.limit(3).withColumns({"cvss": F.lit(9.9), "fix_versions": F.lit(None).cast("array<string>"), "epss": F.lit(None).cast("double")})
    g = catalog.graph(spark, SF).__class__(**{**{f: getattr(g, f) for f in g.__dataclass_fields__}, "vulns": g.vulns.unionByName(odd)})
    scans = numbers.two_scans(g.sboms)
    got = numbers.narrow_alerts(g, scans, ("old", "new"))
    ids = {r.project: r.ids for r in numbers.components(g, scans).collect()}
    for side in ("old", "new"):
        full = alerts.alerts(g, scans=scans.filter(F.col("side") == side).drop("side"))
        want = full.select("project", "vuln_id", F.array_min("all_component_ids").alias("component"), (F.size("fix_versions") > 0).alias("has_fix"), *FIELDS)
        have = got.filter(F.col(side).isNotNull()).select("project", "vuln_id", f"{side}.component", f"{side}.has_fix", *[f"{side}.{c}" for c in FIELDS])
        assert sorted((r.project, r.vuln_id, ids[r.project][r.component - 1], *r[3:]) for r in have.collect()) == sorted(tuple(r) for r in want.collect())


def test_stakeholder_inputs_of_numbers(spark):
    g = catalog.graph(spark, SF)
    scans = alerts.latest_sboms(g.sboms).withColumn("side", F.lit("new"))
    narrow = portfolio.stakeholder_inputs(numbers.narrow_alerts(g, scans).select("project", "vuln_id", "new.*"), numbers.named_components(g, scans))
    full = portfolio.stakeholder_inputs(alerts.alerts(g))
    assert sorted(narrow.select(full.columns).collect()) == sorted(full.collect())


def test_sides_as_deltas(spark):
    """Both scans compared in one pass as two snapshots are."""
    g = catalog.graph(spark, SF)
    made = lambda scans: cases.snapshot(cases.alert_cases(alerts.alerts(g, scans=scans)))
    plain = lambda df: sorted(map(repr, df.withColumn("changes", F.array_join("changes", "|")).collect()))
    assert plain(cases.compared(numbers.sides(g, numbers.two_scans(g.sboms)))) == plain(cases.delta(made(catalog._previous(g)), made(None)))


@pytest.mark.parametrize(("name", "times"), [("stakeholder_inputs", 1), ("verification_checkpoint", 1), ("snapshot_delta", 1)])
def test_made_once_of_numbers(spark, name, times):
    """Advisories are expanded once, nothing moves after, and what is aggregated alert by alert lies in hash tables."""
    df = catalog.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode(_vulns") == times
    assert len(moved(df)) == (name == "verification_checkpoint")  # which moves one row a project to its baseline
    assert all("HashAggregate" in line for line in plan.split("\n") if "Aggregate(key" in line and "vuln_id" in line)


def test_other_verdicts_have_no_number(spark):
    g = catalog.graph(spark, SF)
    other = g.reachability.withColumn("verdict", F.when(F.col("seq") == 3, "odd").otherwise(F.col("verdict")))
    known = {f: getattr(g, f) for f in g.__dataclass_fields__}
    assert numbers.numbered(g) and not numbers.numbered(g.__class__(**{**known, "reachability": other}))
