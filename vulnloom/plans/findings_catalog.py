"""Queries over single findings: list filters, labels, raw rows, texts, lookups and totals, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnloom.functions import exprs as X
from vulnloom.operators import alerts, cases, findings, numbers, paths, portfolio, reports, rules, scenarios, upserts
from vulnloom.plans import oracle as O
from vulnloom.plans.catalog import CASES, CLOSED_SQL, COMPONENT, DELTA, PROJECT, REGISTRY, REPOS_SQL, SINCE, VULN, _alert_keys, _cases, _delta, _repos, _runs, _scan_graph, _share, _states, flat, register
from vulnloom.sources import repositories
from vulnloom.sources.testbed import Graph

# --- the alert list -----------------------------------------------------------------------------------------------

RATIONALE = """CASE WHEN reachability_verdict = 'confirmed_reachable' AND len(fix_versions) > 0 THEN 'prioritized: reachable, and a fix exists'
  WHEN reachability_verdict = 'likely_reachable' AND len(fix_versions) > 0 THEN 'prioritized: likely reachable, and a fix exists' WHEN reachability_verdict = 'no_sink_data' THEN 'not escalated: no sink data'
  WHEN reachability_verdict = 'likely_unreachable' THEN 'monitored: evidence is weak or indirect' ELSE 'monitored: evidence is partial' END"""


def _listed(df: DataFrame) -> DataFrame:
    has_fix = F.size(X.strings(F.col("fix_versions"))) > 0
    return df.select("project", "vuln_id", "severity", "risk_score", "closest_depth", findings.rationale(F.col("reachability_verdict"), has_fix).alias("rationale"))


LISTED = f"SELECT project, vuln_id, severity, risk_score, closest_depth, {RATIONALE} AS rationale FROM alerts"
FOUND = "(contains(lower(array_to_string(all_components, ' ')), '{0}') OR contains(lower(vuln_id), '{0}'))"
register(
    "alert_list_filtered",
    lambda g: _listed(findings.filtered(alerts.alerts(g), ("critical", "high"), ("confirmed_reachable", "likely_reachable", "no_sink_data"), fix=True, text="CVE-2024-1")),
    O.over(f"{LISTED} WHERE severity IN ('critical', 'high') AND reachability_verdict IN ('confirmed_reachable', 'likely_reachable', 'no_sink_data') AND len(fix_versions) > 0 AND {FOUND.format('cve-2024-1')}", O.ALERTS),
)
register("alert_list_exploited", lambda g: _listed(findings.filtered(alerts.alerts(g), kev=True, fix=False, text="Bl")), O.over(f"{LISTED} WHERE kev AND len(fix_versions) = 0 AND {FOUND.format('bl')}", O.ALERTS))
for _by, _sql in {"risk": "coalesce(risk_score, 0) DESC", "severity": "coalesce(cvss, 0) DESC", "depth": "closest_depth ASC NULLS LAST"}.items():
    register(
        f"alert_list_by_{_by}",
        lambda g, by=_by: _listed(alerts.top_alerts(g, 40, order=lambda a: findings.listed(a, by), by_score=by == "risk")),
        O.over(f"{LISTED} ORDER BY {_sql}, project, vuln_id LIMIT 40", O.ALERTS),
    )
register(
    "alert_stats_bar",
    lambda g: findings.stats_bar(alerts.project_stats(g), alerts.alerts(g)),
    O.over("""SELECT project, count(*) AS total, count_if(cvss >= 9) AS critical, count_if(cvss >= 7 AND cvss < 9) AS high, count_if(cvss >= 4 AND cvss < 7) AS medium,
  count_if(cvss IS NULL OR cvss < 4) AS low, count_if(kev) AS kev, count_if(len(fix_versions) > 0) AS with_fix, count_if(reachability_verdict = 'confirmed_reachable') AS confirmed_reachable FROM alerts GROUP BY project""", O.ALERTS),
)
register(
    "compact_findings",
    lambda g: findings.compact(_cases(g)).select("project", "vuln_id", "position"),
    O.over(
        """SELECT project, vuln_id, CAST(k AS INT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY
  CASE decision_tier WHEN 'fix_now' THEN 0 WHEN 'plan_remediation' THEN 1 WHEN 'mitigate' THEN 2 WHEN 'monitor' THEN 3 ELSE 9 END,
  CASE reachability_verdict WHEN 'confirmed_reachable' THEN 0 WHEN 'likely_reachable' THEN 1 WHEN 'no_sink_data' THEN 2 WHEN 'likely_unreachable' THEN 3 ELSE 9 END,
  CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, coalesce(closest_depth, 0) DESC, vuln_id, component_name) AS k FROM cases) WHERE k <= 6""",
        CASES,
    ),
)
register(
    "alerts_with_findings",
    lambda g: alerts.with_findings(alerts.enterprise_alerts(g)).select("project", "scan_id", "vuln_id", "component_count"),
    O.over("SELECT project, scan_id, vuln_id, CAST(count(DISTINCT component_id) AS BIGINT) AS component_count FROM exposures GROUP BY project, scan_id, vuln_id"),
)
register(
    "verdict_two_sources",
    lambda g: flat(alerts.merged_verdicts(alerts.two_sources(g.reachability.filter("seq % 2 = 0"), g.reachability.filter("seq % 2 = 1").withColumn("verdict", F.when(F.col("seq") % 3 != 0, F.col("verdict")))))),
    O.over(
        f"""SELECT v.project, v.vuln_id, v.verdict AS reachability_verdict, coalesce(c.locations, '') AS call_locations
FROM (SELECT project, vuln_id, arg_max(verdict, {O.RANK}) AS verdict FROM both_sources GROUP BY project, vuln_id) v
LEFT JOIN (SELECT project, vuln_id, array_to_string(list(loc ORDER BY o, i), '|') AS locations FROM (
  SELECT project, vuln_id, loc, min(o) AS o, arg_min(i, o) AS i FROM (
    SELECT project, vuln_id, (seq % 2) * 1000000000000 + seq AS o, unnest(call_locations) AS loc, generate_subscripts(call_locations, 1) AS i FROM reachability) GROUP BY project, vuln_id, loc)
  GROUP BY project, vuln_id) c ON v.project = c.project AND v.vuln_id = c.vuln_id""",
        O.BASE + """,
both_sources AS (SELECT project, vuln_id, CASE WHEN seq % 2 = 1 AND seq % 3 = 0 THEN 'no_sink_data' ELSE verdict END AS verdict FROM reachability)""",
    ),
)

# --- raw rows and states ------------------------------------------------------------------------------------------


def _raw(g: Graph) -> DataFrame:
    """Rows as retrieval returns them: fields missing, in nodes, or as text."""
    e = alerts.exposures(g)
    third = F.col("depth") % 3
    return e.select(
        F.when(F.col("depth") % 2 == 0, F.col("project")).alias("project"), F.struct(F.col("project").alias("full_name")).alias("p"), F.struct("name", "version").alias("c"),
        F.struct(F.col("vuln").alias("id"), F.col("cvss").alias("cvss_score"), F.when(F.col("kev"), "YES").otherwise("false").alias("kev"), "epss").alias("v"),
        F.when(third == 0, "n/a").when(third == 1, F.col("cvss").cast("string")).alias("cvss"),
        F.concat("summary", F.when(F.col("kev"), "  \n## Proof of Concept:\t send it ").otherwise("")).alias("detail_summary"), "fix_versions",
        F.array(F.concat(F.lit("src/"), "name")).alias("touched_paths"), F.array(F.when(third == 2, F.lit("top")).otherwise(F.col("depth").cast("string"))).alias("touched_lines"), "depth",
    )


register(
    "raw_evidence",
    lambda g: flat(findings.evidence(_raw(g)).drop("aliases", "dependency_chain", "risk_score", "detail_summary"), ()),
    O.over(f"""SELECT project, name AS component, version, vuln AS vulnerability, CASE WHEN depth % 3 <> 0 THEN round(cvss, 4) END AS cvss, kev, round(epss, 4) AS epss, {O.bar("fix_versions")},
  summary || CASE WHEN kev THEN ' ## Proof of Concept: send it' ELSE '' END AS impact_summary, CASE WHEN kev THEN '## Proof of Concept: send it' END AS poc_summary, kev AS has_public_poc,
  'src/' || name AS location_path, CASE WHEN depth % 3 <> 2 THEN CAST(depth AS INT) END AS location_line, CAST(depth AS INT) AS depth FROM exposures"""),
)


def _wide_states(g: Graph) -> DataFrame:
    """The stored states, and some that name a component in any project, or a vulnerability alone."""
    keys = _alert_keys(g)
    none = F.lit(None).cast("string")
    own = _states(g).select("project", "vuln_id", F.nullif("component_id", F.lit("")).alias("component_id"), "status", "owner")
    parts = keys.filter(_share(F.concat("vuln_id", "component_id")) % 5 == 1).select(none.alias("project"), "vuln_id", "component_id", F.lit("planned").alias("status"), F.lit("team").alias("owner"))
    whole = keys.filter(_share(F.col("vuln_id")) % 7 == 0).select(none.alias("project"), "vuln_id", none.alias("component_id"), F.lit("triaged").alias("status"), F.lit("all").alias("owner"))
    return own.unionByName(parts.distinct()).unionByName(whole.distinct())


KEYS_SQL = "SELECT project, vuln_id, min(component_id) AS component_id FROM exposures GROUP BY project, vuln_id"
register(
    "state_resolution",
    lambda g: findings.resolve_states(_alert_keys(g), _wide_states(g), g.partitions),
    O.over(
        f"""SELECT k.project, k.vuln_id, k.component_id, coalesce(a.status, b.status, CASE WHEN {O.share("k.vuln_id || k.component_id")} % 5 = 1 THEN 'planned' END, CASE WHEN {O.share("k.vuln_id")} % 7 = 0 THEN 'triaged' END) AS status,
  coalesce(a.owner, b.owner, CASE WHEN {O.share("k.vuln_id || k.component_id")} % 5 = 1 THEN 'team' END, CASE WHEN {O.share("k.vuln_id")} % 7 = 0 THEN 'all' END) AS owner
FROM ({KEYS_SQL}) k LEFT JOIN states a ON k.project || '|' || k.vuln_id || '|' || k.component_id = a.own
LEFT JOIN (SELECT * FROM states WHERE component_id = '') b ON k.project || '|' || k.vuln_id || '|' = b.own""",
        O.ALERTS + O.STATES,
    ),
)


def _shaped_states(g: Graph) -> DataFrame:
    """States under keys of all six shapes, several of a key, by the hash of the vulnerability."""
    keys = _alert_keys(g).withColumn("h", _share(F.concat("project", "vuln_id")) % 11)
    none = F.lit(None).cast("string")
    at = lambda n: F.lit(f"2024-01-0{n}").alias("updated_at")
    one = lambda when, project, vuln, component, key, status, n: F.when(F.expr(when), F.struct(project.alias("project"), vuln.alias("vuln_id"), component.alias("component_id"), key.alias("state_key"), F.lit(status).alias("status"), F.lit("x").alias("owner"), at(n)))
    p, v, c = F.col("project"), F.col("vuln_id"), F.col("component_id")
    made = [
        one("h = 0", p, v, c, none, "new", 1), one("h = 0", p, v, c, none, "done", 2), one("h <= 1", p, v, none, none, "planned", 1), one("h = 2 OR h = 0", none, v, c, none, "triaged", 1),
        one("h = 3", none, none, none, F.concat_ws("|", p, v, c), "open", 1), one("h = 3 OR h = 4", none, none, none, F.concat_ws("|", p, v), "closed", 1),
    ]
    whole = keys.filter(_share(F.col("vuln_id")) % 5 == 0).select(none.alias("project"), "vuln_id", none.alias("component_id"), none.alias("state_key"), F.lit("wide").alias("status"), F.lit("y").alias("owner"), at(1)).distinct()
    return keys.select(F.explode(F.array_compact(F.array(*made))).alias("s")).select("s.*").unionByName(whole)


register(
    "state_shapes",
    lambda g: findings.resolve_states(_alert_keys(g), _shaped_states(g), g.partitions),
    O.over(
        f"""SELECT project, vuln_id, component_id, CASE WHEN h = 0 THEN 'done' WHEN h = 1 THEN 'planned' WHEN shared THEN 'triaged' WHEN w THEN 'wide' WHEN h = 3 THEN 'open' WHEN h = 4 THEN 'closed' END AS status,
  CASE WHEN h <= 1 OR shared THEN 'x' WHEN w THEN 'y' WHEN h IN (3, 4) THEN 'x' END AS owner
FROM (SELECT *, count_if(h IN (0, 2)) OVER (PARTITION BY vuln_id, component_id) > 0 AS shared, {O.share("vuln_id")} % 5 = 0 AS w FROM (SELECT *, {O.SHARE} % 11 AS h FROM ({KEYS_SQL})))"""
    ),
)

# --- report texts -------------------------------------------------------------------------------------------------

register(
    "case_texts",
    lambda g: _cases(g).select(
        "project", "vuln_id", findings.evidence_area(F.col("call_locations")).alias("area"), findings.readiness(F.col("has_fix"), F.col("reachability_verdict")).alias("readiness"),
        findings.why_later(F.col("reachability_verdict"), F.col("decision_tier"), F.col("has_fix")).alias("later"), findings.management_owner(F.col("decision_tier")).alias("owner"),
        findings.upgrade_step(F.col("component_name"), F.col("component_version"), F.col("target_version")).alias("step"),
    ),
    O.over(
        f"""SELECT project, vuln_id, CASE WHEN len(call_locations) = 0 THEN 'unknown_area' ELSE lower(split_part(coalesce(list_filter(call_locations, lambda x: NOT {O.TEST})[1], call_locations[1]), '/', 1)) END AS area,
  CASE WHEN has_fix THEN 'fix_available' WHEN reachability_verdict IN ('confirmed_reachable', 'likely_reachable') THEN 'investigate' ELSE 'workaround_only' END AS readiness,
  CASE WHEN reachability_verdict = 'no_sink_data' THEN 'Evidence on its functions is missing; that does not prove it safe.' WHEN reachability_verdict = 'likely_unreachable' THEN 'No direct use was seen; verify as planned.'
    WHEN decision_tier = 'mitigate' THEN 'It needs a mitigation or more investigation first.' WHEN has_fix THEN 'A fix exists, and a later window suits it.' ELSE 'Evidence or a fix is incomplete.' END AS later,
  CASE decision_tier WHEN 'fix_now' THEN 'release_manager/immediate' WHEN 'plan_remediation' THEN 'developer_team/next_window' WHEN 'mitigate' THEN 'platform_team/next_window' ELSE 'platform_team/monitor' END AS owner,
  CASE WHEN target_version IS NOT NULL THEN 'Upgrade ' || component_name || ' from ' || component_version || ' to ' || target_version ELSE 'Find a safe version of ' || component_name END AS step FROM cases""",
        CASES,
    ),
)
register(
    "cluster_texts",
    lambda g: reports.clusters(_cases(g)).select(
        "project", "component", "version", "area_key", "tier", findings.why_now(F.col("verdict"), F.col("any_fix"), F.col("any_kev")).alias("why_now"),
        findings.why_fix_now(F.col("verdict"), F.col("production"), F.col("test_only"), F.col("any_fix")).alias("why_fix_now"),
    ),
    O.over(
        """SELECT project, component, version, area_key, tier, CASE WHEN verdict = 'confirmed_reachable' THEN 'Code evidence shows it in an active path.' WHEN verdict = 'likely_reachable' AND any_fix THEN 'It is likely in use, and a fix exists.'
    WHEN verdict = 'likely_reachable' THEN 'It is likely in use.' WHEN any_kev THEN 'It is known to be exploited.' WHEN any_fix THEN 'A fix exists.' ELSE 'Severity and exposure justify planning.' END AS why_now,
  CASE WHEN verdict = 'confirmed_reachable' THEN 'Project code calls it.' WHEN verdict = 'likely_reachable' AND production > 0 THEN 'Production code uses it.'
    WHEN verdict = 'likely_reachable' AND test_only > 0 THEN 'Tests use it; confirm production use.' WHEN any_fix THEN 'Risk and a fix justify it.' ELSE 'Tier and evidence justify it.' END AS why_fix_now FROM clusters""",
        CASES + O.AREAS + O.CLUSTERS,
    ),
)
register(
    "merged_call_evidence",
    lambda g: flat(findings.merged_evidence(_cases(g), ["vuln_id"], "project")),
    O.over(
        """SELECT c.vuln_id, arg_min(reachability_verdict, CASE reachability_verdict WHEN 'confirmed_reachable' THEN 0 WHEN 'likely_reachable' THEN 1 WHEN 'no_sink_data' THEN 2 WHEN 'likely_unreachable' THEN 3 ELSE 9 END) AS reachability_verdict,
  CASE WHEN bool_or(evidence_scope = 'mixed') OR bool_or(evidence_scope = 'production') AND bool_or(evidence_scope = 'test') THEN 'mixed' WHEN bool_or(evidence_scope = 'production') THEN 'production'
    WHEN bool_or(evidence_scope = 'test') THEN 'test' ELSE 'none' END AS evidence_scope, coalesce(any_value(l.locations), '') AS call_locations
FROM cases c LEFT JOIN (SELECT vuln_id, array_to_string(list(loc ORDER BY o)[1:5], '|') AS locations FROM (
  SELECT vuln_id, loc, min({'p': project, 'i': i}) AS o FROM (SELECT vuln_id, project, unnest(call_locations) AS loc, generate_subscripts(call_locations, 1) AS i FROM cases) GROUP BY vuln_id, loc) GROUP BY vuln_id) l USING (vuln_id)
GROUP BY c.vuln_id""",
        CASES,
    ),
)


def _checkpoint(g: Graph) -> DataFrame:
    baselines = cases.baseline_run(_runs(g), _runs(g).filter(_share(F.col("run_id")) % 4 != 0))
    if not numbers.numbered(g):
        return findings.checkpoint(cases.delta_summary(_delta(g)), baselines, reports.action_counts(_cases(g)))
    tier = F.when(F.col("new_project").isNotNull(), X.decision_tier(F.col("new_kev"), F.col("new_risk_score"), F.col("new_reachability_verdict"), F.col("new_fix_available")))
    rows = cases.compared(numbers.sides(g, numbers.two_scans(g.sboms)), 0.01, tier.alias("tier"))
    changed = [F.count_if(F.array_contains("changes", c)).alias(c) for c in ("resolved", "risk_decreased", "verdict_improved")]
    counts = rows.groupBy("project").agg(*changed, F.count("tier").alias("cases"), F.count_if(F.col("tier") == "fix_now").alias("fix_now"), F.count_if(F.col("tier") == "plan_remediation").alias("plan"))
    return findings.next_check(counts.filter("cases > 0"), baselines)


register(
    "verification_checkpoint",
    _checkpoint,
    O.over(
        """SELECT c.project, b.scan_id IS NOT NULL AND coalesce(moved, 0) > 0 AS meaningful, CASE WHEN fix_now > 0 THEN 'after remediation merges' WHEN plan > 0 THEN 'after the planned release' ELSE 'next scan' END AS trigger,
  CASE WHEN b.scan_id IS NULL THEN 'No baseline yet; the next scan sets it.' WHEN coalesce(moved, 0) > 0 THEN 'Compared with ' || b.scan_id || ': remediation shows.' ELSE 'Compared with ' || b.scan_id || ': no remediation shows yet.' END AS note
FROM (SELECT project, count_if(decision_tier = 'fix_now') AS fix_now, count_if(decision_tier = 'plan_remediation') AS plan FROM cases GROUP BY project) c
LEFT JOIN (SELECT project, scan_id FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY generated_at DESC, run_id DESC) AS k FROM (
  SELECT *, row_number() OVER w AS n, first(scan_id) OVER w AS cur FROM (SELECT project, 'run-' || scan_id AS run_id, generated_at, scan_id FROM sboms)
  WINDOW w AS (PARTITION BY project ORDER BY generated_at DESC, run_id DESC)) WHERE n <= 10 AND scan_id <> cur AND (HASH) % 4 <> 0) WHERE k = 1) b ON b.project = c.project
LEFT JOIN (SELECT project, count_if(contains('|' || changes || '|', '|resolved|') OR contains('|' || changes || '|', '|risk_decreased|') OR contains('|' || changes || '|', '|verdict_improved|')) AS moved
  FROM delta GROUP BY project) d ON d.project = c.project""",
        DELTA,
    ).replace("(HASH)", O.share("run_id")),
)
register(
    "summary_pairs",
    lambda g: findings.two_by_two(g.sinks.select("package_name", F.col("function_name").alias("label"), F.col("call_pattern").alias("value"), "seq"), ["package_name"], "seq"),
    O.over("""SELECT package_name, CAST(k // 2 AS BIGINT) AS pair, coalesce(max(label) FILTER (k % 2 = 0), '') AS left_label, coalesce(max(value) FILTER (k % 2 = 0), '') AS left_value,
  coalesce(max(label) FILTER (k % 2 = 1), '') AS right_label, coalesce(max(value) FILTER (k % 2 = 1), '') AS right_value FROM (
  SELECT package_name, function_name AS label, coalesce(call_pattern, 'None listed') AS value, row_number() OVER (PARTITION BY package_name ORDER BY seq) - 1 AS k FROM sinks WHERE function_name IS NOT NULL) GROUP BY package_name, k // 2"""),
)

register(
    "report_narrative",
    lambda g: findings.narrative(reports.overview(_cases(g))),
    O.over(
        f"""SELECT c.project, concat(total, ' findings, ', coalesce(severe, 0), ' of them severe and open; exposure is ', coalesce(posture, 'low'), '. ', fix_now, ' to fix now, ', plan, ' to plan, ', mitigate, ' to mitigate; ', with_fix, ' have a fix. ',
  CASE WHEN t.component IS NOT NULL THEN 'Begin with ' || t.component || ' ' || t.version || '.' ELSE 'Nothing is open.' END) AS text
FROM (SELECT project, count(*) AS total, count_if(decision_tier = 'fix_now') AS fix_now, count_if(decision_tier = 'plan_remediation') AS plan, count_if(decision_tier = 'mitigate') AS mitigate, count_if(has_fix) AS with_fix FROM cases GROUP BY project) c
LEFT JOIN (SELECT project, severe, CASE WHEN k > 0 OR a > 0 OR f > 0 THEN 'elevated' WHEN severe > 0 OR b > 0 THEN 'moderate' ELSE 'low' END AS posture FROM (
  SELECT project, count_if(severity IN ('critical', 'high')) AS severe, count_if(kev) AS k, count_if(reachability_verdict = 'confirmed_reachable') AS a, count_if(reachability_verdict = 'likely_reachable') AS b,
    count_if(decision_tier = 'fix_now') AS f FROM cases WHERE NOT {CLOSED_SQL} GROUP BY project)) p ON p.project = c.project
LEFT JOIN top_clusters t ON t.project = c.project AND t.rank = 1""",
        CASES + O.AREAS + O.CLUSTERS + O.TOP_CLUSTERS,
    ),
)


def _stakeholder_inputs(g: Graph) -> DataFrame:
    if not numbers.numbered(g):
        return portfolio.stakeholder_inputs(alerts.alerts(g))
    scans = alerts.latest_sboms(g.sboms).withColumn("side", F.lit("new"))
    return portfolio.stakeholder_inputs(numbers.narrow_alerts(g, scans).select("project", "vuln_id", "new.*"), numbers.named_components(g, scans))


register(
    "stakeholder_inputs",
    _stakeholder_inputs,
    O.over("""SELECT c.*, v.vulns, t.components FROM (
  SELECT project, count(*) AS total, count_if(severity IN ('critical', 'high')) AS critical_high, count_if(kev) AS kev, count_if(len(fix_versions) > 0) AS with_fix,
    count_if(reachability_verdict = 'confirmed_reachable') AS confirmed_reachable, count_if(reachability_verdict = 'likely_reachable') AS likely_reachable, count_if(reachability_verdict = 'uncertain') AS uncertain,
    count_if(reachability_verdict = 'likely_unreachable') AS likely_unreachable, count_if(reachability_verdict = 'no_sink_data') AS no_sink_data FROM alerts GROUP BY project) c
LEFT JOIN (SELECT project, array_to_string(list(vuln_id ORDER BY k), '|') AS vulns FROM (
  SELECT *, row_number() OVER (PARTITION BY project ORDER BY risk_score DESC NULLS LAST, closest_depth ASC NULLS LAST, published DESC NULLS LAST, vuln_id) AS k FROM alerts) WHERE k <= 10 GROUP BY project) v ON v.project = c.project
LEFT JOIN (SELECT project, array_to_string(list(component || ':' || n ORDER BY k), '|') AS components FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY n DESC, component) AS k FROM (
  SELECT project, component, count(*) AS n FROM (SELECT project, unnest(all_components) AS component FROM alerts) GROUP BY project, component)) WHERE k <= 20 GROUP BY project) t ON t.project = c.project""", O.ALERTS),
)
register(
    "verdict_counts",
    lambda g: rules.verdict_counts(rules.verdicts(rules.rules(g.sinks), rules.hits(g.findings, "repo"), g.vulns.select(F.col("id").alias("vuln_id")))),
    "SELECT verdict, count(*) AS n FROM (" + REGISTRY["finding_verdicts"][1] + ") GROUP BY verdict",
)
register(
    "normalised_cases",
    lambda g: flat(findings.normalised_cases(
        _raw(g).withColumns({"decision_tier": F.when(F.col("depth") == 1, "Mitigate").when(F.col("depth") == 2, "soon"), "status": F.when(F.col("depth") == 3, "accepted_risk").when(F.col("depth") == 4, "TRIAGED"),
                             "reachability_verdict": F.when(F.col("depth") % 2 == 0, "likely_reachable")}).drop("c")
    ), ()),
    O.over(f"""SELECT *, CASE WHEN kev THEN 'critical' WHEN cvss >= 9 THEN 'critical' WHEN cvss >= 7 THEN 'high' WHEN cvss >= 4 THEN 'medium' ELSE 'low' END AS severity FROM (
  SELECT project, vuln AS vuln_id, 'unknown-component' AS component_name, CAST(NULL AS VARCHAR) AS component_version, CASE WHEN depth % 3 <> 0 THEN round(cvss, 4) END AS cvss, round(epss, 4) AS epss, kev, {O.bar("fix_versions")},
    CAST(depth AS INT) AS dependency_depth, CASE WHEN depth % 2 = 0 THEN 'likely_reachable' ELSE 'no_sink_data' END AS reachability_verdict,
    CASE WHEN depth % 2 = 0 THEN 'medium' WHEN len(fix_versions) > 0 THEN 'medium' ELSE 'low' END AS evidence_confidence,
    CASE WHEN depth = 1 THEN 'mitigate' WHEN depth % 2 = 0 THEN 'fix_now' WHEN kev AND len(fix_versions) > 0 THEN 'plan_remediation' WHEN kev THEN 'mitigate' ELSE 'monitor' END AS decision_tier,
    CASE WHEN depth = 3 THEN 'planned' WHEN depth = 4 THEN 'triaged' ELSE 'new' END AS status,
    summary || CASE WHEN kev THEN ' ## Proof of Concept: send it' ELSE '' END AS advisory_summary, summary || CASE WHEN kev THEN ' ## Proof of Concept: send it' ELSE '' END AS impact_summary FROM exposures)"""),
)


def _virtual(g: Graph) -> DataFrame:
    """Heads of pruned graphs, those at even depths taken as virtual."""
    edges, roots = _scan_graph(g)
    pruned = paths.prune_flat(edges, roots)
    return paths.replace_virtual(paths.sources_only(pruned, roots), pruned, g.has_component.filter("depth % 2 = 1").select("scan_id", F.col("component_id").alias("node")))


register(
    "virtual_heads",
    _virtual,
    O.over("""SELECT h.scan_id, h.node FROM heads h JOIN real r ON r.scan_id = h.scan_id AND r.node = h.node
UNION SELECT h.scan_id, p.dst FROM heads h JOIN pruned p ON p.scan_id = h.scan_id AND p.src = h.node WHERE NOT EXISTS (SELECT 1 FROM real r WHERE r.scan_id = h.scan_id AND r.node = h.node)""",
           O.BASE + "," + O.DIRECT_SQL + ", real AS (SELECT scan_id, component_id AS node FROM has_component WHERE depth % 2 = 1)"),
)

# --- repositories, writes and totals ------------------------------------------------------------------------------

K = "CAST(substr(full_name, -9) AS BIGINT)"
register(
    "repository_lookup",
    lambda g: repositories.looked_up(
        _repos(g).select(F.when(F.expr(f"{K} % 3 = 0"), F.concat(F.lit("key-"), F.expr(K).cast("string"))).when(F.expr(f"{K} % 3 = 1"), F.col("full_name")).otherwise(F.upper("full_name")).alias("name")),
        _repos(g).filter(F.expr(f"{K} % 5 <> 0")).select(F.concat(F.lit("key-"), F.expr(K).cast("string")).alias("metadata_key"), "full_name"),
    ),
    O.over(f"""SELECT CASE {K} % 3 WHEN 0 THEN 'key-' || {K} WHEN 1 THEN full_name ELSE upper(full_name) END AS name, full_name FROM ({REPOS_SQL}) WHERE {K} % 5 <> 0"""),
)
register(
    "repository_links",
    lambda g: _repos(g).select(
        "full_name", repositories.repository_url(F.when(F.col("stars") % 3 == 0, F.concat(F.lit(" https://GitHub.com/"), "full_name", F.lit("//"))).when(F.col("stars") % 3 == 1, F.concat(F.lit("https:\\\\github.com\\"), "full_name")).otherwise("http://x/y")).alias("url"),
        repositories.blacklisted(F.concat("full_name", F.when(F.col("stars") > 900, "-Demo").otherwise(""))).alias("blacklisted"),
    ),
    O.over(f"""SELECT full_name, CASE stars % 3 WHEN 0 THEN 'https://GitHub.com/' || full_name WHEN 1 THEN 'https://github.com/' || full_name ELSE '' END AS url, stars > 900 AS blacklisted FROM ({REPOS_SQL})"""),
)
register("project_catalogue", lambda g: repositories.catalogue(g.projects), O.over("SELECT DISTINCT project, coalesce(language, 'Unknown') AS language, package_manager FROM projects"))
register(
    "coarse_ecosystem",
    lambda g: g.components.select("component_id", X.coarse_ecosystem(F.col("component_id")).alias("ecosystem")),
    O.over("SELECT component_id, CASE split_part(substr(component_id, 5), '/', 1) WHEN 'npm' THEN 'npm' WHEN 'pypi' THEN 'pypi' WHEN 'cargo' THEN 'cargo' ELSE 'other' END AS ecosystem FROM components"),
)
register(
    "run_replace",
    lambda g: upserts.replace_runs(_runs(g).withColumn("state", F.lit("old")), _runs(g).filter(_share(F.col("run_id")) % 3 == 0).withColumn("state", F.lit("new"))).select("project", "run_id", "state"),
    O.over(f"SELECT project, run_id, CASE WHEN {O.share('run_id')} % 3 = 0 THEN 'new' ELSE 'old' END AS state FROM (SELECT project, 'run-' || scan_id AS run_id FROM sboms)"),
)
register(
    "recent_runs",
    lambda g: cases.recent_runs(_runs(g), 3),
    O.over("""SELECT project, run_id, scan_id, CAST(n AS INT) AS n FROM (SELECT project, 'run-' || scan_id AS run_id, scan_id, row_number() OVER (PARTITION BY project ORDER BY generated_at DESC, 'run-' || scan_id DESC) AS n FROM sboms) WHERE n <= 3"""),
)
EDGE = ["scan_id", "src", "dst"]
register(
    "edges_upserted",
    lambda g: upserts.edges_upserted(g.depends_on.filter("crc32(cast(src as binary)) % 2 = 0").unionByName(g.depends_on), g.depends_on, EDGE),
    O.over("SELECT DISTINCT scan_id, src, dst FROM depends_on"),
)
TOTALS_SQL = """SELECT project, h.scan_id, count(*) AS total_components, count(n) AS vulnerable_components, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_vulnerabilities
FROM latest l JOIN has_component h USING (scan_id) LEFT JOIN (SELECT component_id, count(*) AS n FROM affected_by GROUP BY component_id) USING (component_id) GROUP BY project, h.scan_id"""


def _totals(g: Graph) -> DataFrame:
    return upserts.scan_totals(alerts.latest_sboms(g.sboms), g.has_component, g.affected_by)


register("scan_totals", _totals, O.over(TOTALS_SQL))
register(
    "summary_totals",
    lambda g: upserts.summary_totals(_totals(g)),
    O.over(f"""SELECT count(*) AS projects, count_if(vulnerable_components > 0) AS with_vulnerabilities, CAST(sum(vulnerable_components) AS BIGINT) AS vulnerable_components,
  CAST(sum(total_vulnerabilities) AS BIGINT) AS vulnerabilities FROM ({TOTALS_SQL})"""),
)

# --- bundles ------------------------------------------------------------------------------------------------------

ASKED = "GHSA-8"
BUNDLED = {"q1": "q1_top_risky_projects", "q2": "q2_impact", "q3": "q3_quick_wins", "q4": "q4_no_fix", "q6": "q6_dep_chain", "q7": "q7_kev_queue", "q8": "q8_recent", "q9": "q9_project_summary", "q10": "q10_inventory",
           "q11": "q11_top_components", "q12": "q12_latest_scan_metadata", "q13": "q13_vuln_chains", "q14": "q14_components_for_vuln"}


def _bundle_sql(name: str) -> str:
    """Rows of each query of a bundle, by the SQL of the single queries."""
    parts = []
    for q in scenarios.BUNDLES[name]:
        sql = REGISTRY[BUNDLED[q]][1].replace(f"'{VULN}'", f"'{ASKED}'")
        if q == "q13":
            sql = sql.replace("WHERE k <= 3", "WHERE k <= 5").replace("WHERE n <= 8", "WHERE n <= 15")
        parts.append(f"SELECT '{q}' AS _query, count(*) AS n FROM ({sql})")
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE n > 0"


for _name in scenarios.BUNDLES:
    if _name != "triage_queue":
        register(
            f"bundle_{_name}",
            lambda g, n=_name: scenarios.labelled_union(scenarios.bundle(g, n, PROJECT, ASKED, COMPONENT, SINCE)).groupBy("_query").agg(F.count("*").alias("n")),
            _bundle_sql(_name),
        )
