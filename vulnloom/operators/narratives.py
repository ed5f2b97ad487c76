"""Accounts of each project in named sections, and the technical finding of each case; texts made of aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnloom.functions import exprs as X
from vulnloom.functions import vocabulary as V
from vulnloom.operators import findings, reports
from vulnloom.sources.shared import stored

NOTHING = "No evidence provided."


def _sections(df: DataFrame, sections: dict[str, list[Column]]) -> DataFrame:
    """(project, position, section, text): each section's sentences, those that are missing left out."""
    text = lambda parts: F.coalesce(F.nullif(F.concat_ws(" ", *parts), F.lit("")), F.lit(NOTHING))
    rows = F.array(*[F.struct(F.lit(k + 1).alias("position"), F.lit(name).alias("section"), text(parts).alias("text")) for k, (name, parts) in enumerate(sections.items())])
    return df.select("project", F.explode(rows).alias("s")).select("project", "s.*")


def _say(form: str, *columns: str) -> Column:
    return F.format_string(form, *[F.coalesce(F.col(c), F.lit(0)) for c in columns])


def stakeholder_sections(cases: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """What needs attention, why it matters, what to decide and what is uncertain, for each project.

    ``notes`` (project, note) is what the next verification says.  Six aggregates read the cases, which are stored once.
    """
    cases = stored(cases.select(*reports.REPORT_COLUMNS), "cases")
    counts = reports.action_counts(cases)
    first = reports.top_clusters(reports.clusters(cases)).filter("rank <= 2")
    lead = F.concat(F.col("component"), F.lit(": "), V.worded(F.col("tier"), "stakeholder", "tier"), F.lit(". "), findings.why_now(F.col("verdict"), F.col("any_fix"), F.col("any_kev")))
    leads = first.groupBy("project").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", lead.alias("t")))), lambda x: x["t"]), " ").alias("leads"))
    place = F.format_string("%s (%d)", F.col("title"), F.col("cases"))
    areas = reports.affected_areas(cases, 2).groupBy("project").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", place.alias("t")))), lambda x: x["t"]), ", ").alias("areas"))
    met = counts.join(reports.posture(cases).select("project", "critical_high", "kev", "confirmed", "likely"), "project", "left").join(reports.impact(cases), "project", "left")
    met = met.join(leads, "project", "left").join(areas, "project", "left").join(reports.management_actions(counts), "project", "left")
    met = met.join(notes.select("project", "note"), "project", "left") if notes is not None else met.withColumn("note", F.lit(None).cast("string"))
    used = lambda verdict: V.text_of("stakeholder", "reachability", verdict, "sentence")
    return _sections(
        met,
        {
            "attention": [_say("%d of %d cases need action in this release.", "fix_now", "total"), _say(f"%d {used('confirmed_reachable')}, %d {used('likely_reachable')}.", "confirmed", "likely"), F.coalesce("leads", F.lit("No cluster is listed."))],
            "importance": [_say("%d open cases are critical or high, %d known to be exploited.", "critical_high", "kev"), F.concat(F.lit("Evidence lies in "), F.coalesce("areas", F.lit("the whole repository")), F.lit(".")), _say("%d direct and %d transitive dependencies are open; %d cases have a fix.", "direct", "transitive", "with_fix")],
            "decision": [F.coalesce(F.nullif("actions", F.lit("")), F.lit("Nothing is to be decided."))],
            "uncertainty": [_say("%d cases stay under observation, which does not prove them safe.", "monitor"), F.col("note")],
        },
    )


def developer_sections(cases: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """The queue, its strongest evidence, the next steps and what remains open, for each project."""
    cases = stored(cases.select(*reports.REPORT_COLUMNS), "cases")
    counts = reports.action_counts(cases)
    verdicts = cases.groupBy("project").agg(*[F.count_if(F.col("reachability_verdict") == v).alias(v) for v in ("confirmed_reachable", "likely_reachable", "likely_unreachable", "no_sink_data")])
    first = reports.top_clusters(reports.clusters(cases).filter("tier = 'fix_now'")).filter("rank = 1").drop("cases", "rank")
    met = counts.join(verdicts, "project", "left").join(first, "project", "left")
    met = met.join(notes.select("project", "note"), "project", "left") if notes is not None else met.withColumn("note", F.lit(None).cast("string"))
    some = F.col("component").isNotNull()
    proof = V.worded(F.col("verdict"), "developer", "reachability", "sentence")
    evidence = F.concat(F.lit("First is "), F.col("lead"), F.lit(" on "), F.col("component"), F.lit(", which "), proof, F.lit(". "), findings.why_fix_now(F.col("verdict"), F.col("production"), F.col("test_only"), F.col("any_fix")))
    step = F.when(F.col("any_fix"), F.concat(F.lit("Upgrade "), F.col("component"), F.lit("."))).otherwise(F.concat(F.lit("Isolate "), F.col("component"), F.lit(".")))
    return _sections(
        met,
        {
            "queue": [_say("%d to fix now, %d to plan, %d to mitigate, %d to watch.", "fix_now", "plan", "mitigate", "monitor"), _say("%d have direct call evidence, %d an import only.", "confirmed_reachable", "likely_reachable")],
            "evidence": [F.when(some, evidence).otherwise("Nothing has to be fixed now.")],
            "next": [F.when(some, step).otherwise("Work on planned upgrades, then scan again.")],
            "uncertainty": [_say("%d cases lack evidence on functions, which leaves them open; %d were not seen in use.", "no_sink_data", "likely_unreachable"), F.col("note")],
        },
    )


def tier_rationale(tier: Column, kev: Column, verdict: Column, risk: Column, fixes: Column, depth: Column, confidence: Column) -> Column:
    """Why a case is in its tier, with the facts that decide it."""
    facts = F.format_string("verdict %s, risk %.2f", F.coalesce(verdict, F.lit("no_sink_data")), F.coalesce(risk, F.lit(0.0)))
    deep = F.coalesce(depth.cast("string"), F.lit("unknown"))
    return (
        F.when((tier == "fix_now") & F.coalesce(kev, F.lit(False)) & X.is_reachable(verdict), "Known to be exploited, and in use.")
        .when(tier == "fix_now", F.concat(F.lit("Urgent: "), facts, F.lit(", depth "), deep, F.lit(".")))
        .when(tier == "plan_remediation", F.concat(F.format_string("%d versions fix it: ", F.size(X.strings(fixes))), facts, F.lit(".")))
        .when(tier == "mitigate", F.concat(F.lit("No ready fix settles it: "), facts, F.lit(".")))
        .when(tier.isin("accept", "accept_risk"), "Accepted by decision; to be reviewed.")
        .otherwise(F.concat(F.lit("Weak evidence or little urgency: "), facts, F.lit(", confidence "), F.coalesce(confidence, F.lit("medium")), F.lit(".")))
    )


def technical_findings(cases: DataFrame, calls: int = 3) -> DataFrame:
    """One row per case with what a developer needs of it; texts that are not known say so."""
    given = lambda c: F.nullif(F.trim(F.col(c)), F.lit("")) if c in cases.columns else F.lit(None).cast("string")
    places = F.filter(F.transform(X.strings(F.col("call_locations")), lambda x: F.trim(x)), lambda x: x != "")
    impact = F.coalesce(given("impact_summary"), given("summary_note"), given("advisory_summary"), given("summary"), F.lit("No impact summary is known."))
    why = tier_rationale(F.col("decision_tier"), F.col("kev"), F.col("reachability_verdict"), F.col("risk_score"), F.col("fix_versions"), F.col("closest_depth"), F.col("evidence_confidence"))
    return cases.select(
        "project", "vuln_id", F.coalesce("component_name", F.lit("")).alias("component"), F.col("component_version").alias("current_version"), F.lower(F.coalesce("severity", F.lit("medium"))).alias("severity"), "decision_tier",
        F.coalesce("reachability_verdict", F.lit("no_sink_data")).alias("reachability_verdict"), F.col("closest_depth").alias("dependency_depth"), "cvss", "risk_score", "fix_versions", places.alias("call_locations"),
        F.slice(places, 1, calls).alias("key_call_evidence"), X.advisory_url(F.col("vuln_id")).alias("nvd_url"), impact.alias("impact_summary"), why.alias("why_this_tier"),
    )
