"""SQL of the oracle: the same questions, written a second time against the test tables."""

from __future__ import annotations

from vulnloom.sources.testbed import ctes

BASE = ctes() + """,
latest AS (
  SELECT scan_id, project, generated_at, branch, source_commit FROM (
    SELECT *, row_number() OVER (PARTITION BY project ORDER BY generated_at DESC NULLS FIRST, scan_id DESC) AS n FROM sboms) WHERE n = 1),
exposures AS (
  SELECT s.*, p.language, p.package_manager, h.component_id, h.depth, h.is_direct, c.name, c.version, c.scope, v.* EXCLUDE (id), v.id AS vuln,
    coalesce(list_filter(coalesce(v.aliases, CAST([] AS VARCHAR[])), lambda x: starts_with(x, 'CVE-'))[1], v.id, v.aliases[1]) AS vuln_id
  FROM latest s JOIN projects p USING (project) JOIN has_component h USING (scan_id) JOIN components c USING (component_id)
  JOIN affected_by a USING (component_id) JOIN vulns v ON v.id = a.vuln)"""

AGGREGATES = """min(vuln) AS internal_id,
  list_sort(list(DISTINCT name)) AS all_components, list_sort(list(DISTINCT component_id)) AS all_component_ids, list_sort(list(DISTINCT version)) AS all_versions,
  CAST(count(DISTINCT component_id) AS BIGINT) AS component_count, max(cvss) AS cvss, max(epss) AS epss, bool_or(kev) AS kev, min(cwe) AS cwe,
  min(published) AS published, max(modified) AS modified, list_sort(flatten(list(DISTINCT fix_versions))) AS fix_versions, min(depth) AS closest_depth,
  coalesce(list_sort(list(DISTINCT scope) FILTER (scope IS NOT NULL)), CAST([] AS VARCHAR[])) AS all_scopes"""

RANK = "CASE verdict WHEN 'confirmed_reachable' THEN 4 WHEN 'likely_reachable' THEN 3 WHEN 'uncertain' THEN 2 WHEN 'likely_unreachable' THEN 1 WHEN 'no_sink_data' THEN 0 ELSE -1 END"

VERDICTS = f"""
verdicts AS (
  SELECT project, vuln_id, arg_max(verdict, {RANK}) AS verdict FROM reachability GROUP BY project, vuln_id),
calls AS (
  SELECT project, vuln_id, list(loc ORDER BY seq, i) AS call_locations FROM (
    SELECT project, vuln_id, loc, min(seq) AS seq, min_by(i, seq) AS i FROM (
      SELECT project, vuln_id, seq, unnest(call_locations) AS loc, generate_subscripts(call_locations, 1) AS i FROM reachability) GROUP BY project, vuln_id, loc)
  GROUP BY project, vuln_id)"""

FACTOR = "CASE reachability_verdict WHEN 'confirmed_reachable' THEN 1.0::DOUBLE WHEN 'likely_reachable' THEN 0.7::DOUBLE WHEN 'likely_unreachable' THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END"
SCOPE = """CASE WHEN list_has_any(all_scopes, ['required', 'runtime']) THEN 1.0::DOUBLE WHEN list_has_any(all_scopes, ['optional', 'dev', 'test']) THEN 0.3::DOUBLE ELSE 0.6::DOUBLE END"""
SEVERITY = "CASE WHEN kev THEN 'critical' WHEN cvss >= 9 THEN 'critical' WHEN cvss >= 7 THEN 'high' WHEN cvss >= 4 THEN 'medium' ELSE 'low' END"
RISK = f"""round((0.25::DOUBLE * (coalesce(cvss, 0) / 10) + 0.25::DOUBLE * CASE WHEN kev THEN 1.0::DOUBLE ELSE coalesce(epss, 0) END
  + 0.15::DOUBLE * {SCOPE} + 0.35::DOUBLE * {FACTOR}) * 100, 2)"""


def alerts_cte(name: str, keys: str, source: str = "exposures") -> str:
    return f"""
{name}_grouped AS (SELECT {keys}, {AGGREGATES} FROM {source} GROUP BY {keys}),
{name}_met AS (
  SELECT g.*, coalesce(a.verdict, b.verdict, 'no_sink_data') AS reachability_verdict,
    coalesce(CASE WHEN a.verdict IS NOT NULL THEN ac.call_locations ELSE bc.call_locations END, CAST([] AS VARCHAR[])) AS call_locations
  FROM {name}_grouped g LEFT JOIN verdicts a ON g.project = a.project AND g.vuln_id = a.vuln_id
  LEFT JOIN calls ac ON g.project = ac.project AND g.vuln_id = ac.vuln_id
  LEFT JOIN verdicts b ON g.project = b.project AND g.internal_id = b.vuln_id
  LEFT JOIN calls bc ON g.project = bc.project AND g.internal_id = bc.vuln_id),
{name} AS MATERIALIZED (SELECT *, {FACTOR} AS reachability_factor, {RISK} AS risk_score, {SEVERITY} AS severity FROM {name}_met)"""


ALERTS = BASE + "," + VERDICTS + "," + alerts_cte("alerts", "project, scan_id, generated_at, source_commit, vuln_id")


def bar(c: str) -> str:
    return f"array_to_string(list_sort({c}), '|') AS {c}"


def over(body: str, base: str = BASE, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}{base}\n{body}"


ALERT_OUT = f"""project, scan_id, generated_at, source_commit, vuln_id, internal_id, {bar("all_components")}, component_count, cvss, epss, kev, {bar("cwe")},
  published, modified, {bar("fix_versions")}, closest_depth, {bar("all_scopes")}, reachability_verdict, array_to_string(call_locations, '|') AS call_locations, risk_score, severity"""
PAIRS = "SELECT DISTINCT project, vuln, vuln_id, component_id, name, version, cvss, epss, kev, fix_versions, published, modified, depth FROM exposures"
PAIR_OUT = f"project, vuln, vuln_id, component_id, name, version, cvss, epss, kev, {bar('fix_versions')}, published, modified, depth"


def pairs(where: str, order: str, limit: int | None) -> str:
    return over(f"SELECT {PAIR_OUT} FROM ({PAIRS}) WHERE {where} ORDER BY {order}" + (f" LIMIT {limit}" if limit else ""))


WORKBENCH_CTE = BASE + "," + VERDICTS + "," + alerts_cte("bench_alerts", "project, language, package_manager, scan_id, generated_at, source_commit, vuln_id") + """,
workbench AS (
  SELECT project, coalesce(language, 'Unknown') AS language, coalesce(package_manager, 'Unknown') AS package_manager, vuln_id, internal_id, severity, cvss, epss,
    coalesce(kev, false) AS kev, risk_score, reachability_verdict, coalesce(reachability_verdict IN ('confirmed_reachable', 'likely_reachable'), false) AS is_reachable,
    list_has_any(all_scopes, ['required', 'runtime']) AS is_runtime, len(fix_versions) > 0 AS fix_available, CAST(len(fix_versions) AS INT) AS fix_versions_count,
    fix_versions, all_components, all_component_ids, CAST(component_count AS INT) AS component_count, all_scopes, closest_depth, cwe, published, modified,
    CAST(date_diff('day', CAST(published AS DATE), DATE '2025-06-01') AS INT) AS published_days_ago, CAST(date_diff('day', CAST(modified AS DATE), DATE '2025-06-01') AS INT) AS modified_days_ago,
    call_locations, CAST(len(call_locations) AS INT) AS call_locations_count
  FROM bench_alerts)"""
LISTS = ("fix_versions", "all_components", "all_component_ids", "all_scopes", "cwe", "call_locations")
WORKBENCH_OUT = "* REPLACE (" + ", ".join(f"array_to_string(list_sort({c}), '|') AS {c}" for c in LISTS) + ")"

DIRECT_SQL = """
wanted AS (SELECT DISTINCT scan_id FROM latest),
e AS (SELECT DISTINCT d.scan_id, src, dst FROM depends_on d JOIN wanted USING (scan_id)),
roots AS (SELECT scan_id, min(component_id) AS root FROM has_component JOIN wanted USING (scan_id) WHERE is_direct GROUP BY scan_id),
pruned AS (
  SELECT e.* FROM e LEFT JOIN roots r USING (scan_id)
  WHERE e.src IS DISTINCT FROM r.root OR NOT EXISTS (SELECT 1 FROM e f WHERE f.scan_id = e.scan_id AND f.dst = e.dst AND f.src IS DISTINCT FROM r.root)),
heads AS (
  SELECT DISTINCT scan_id, src AS node FROM pruned p WHERE NOT EXISTS (SELECT 1 FROM pruned q WHERE q.scan_id = p.scan_id AND q.dst = p.src)
    AND NOT EXISTS (SELECT 1 FROM roots r WHERE r.scan_id = p.scan_id AND r.root = p.src)),
led AS (SELECT p.scan_id, p.dst AS node FROM pruned p JOIN roots r ON p.scan_id = r.scan_id AND p.src = r.root),
direct AS (SELECT DISTINCT scan_id, node FROM led UNION SELECT scan_id, node FROM heads WHERE scan_id NOT IN (SELECT scan_id FROM led))"""

DEPTHS_SQL = DIRECT_SQL + """,
walk(scan_id, node, depth) AS (
  SELECT scan_id, node, 1 FROM direct UNION SELECT w.scan_id, p.dst, w.depth + 1 FROM walk w JOIN pruned p ON w.scan_id = p.scan_id AND w.node = p.src),
depths AS (
  SELECT scan_id, node, CAST(min(depth) AS INT) AS depth FROM (
    SELECT scan_id, node, depth FROM walk UNION ALL SELECT scan_id, root, 0 FROM roots WHERE scan_id IN (SELECT scan_id FROM e)) GROUP BY scan_id, node)"""


def chains(targets: str) -> str:
    """Recursive shortest chains from direct dependencies; the least of the shortest in order of its nodes."""
    return f"""
targets AS ({targets}),
edges AS (SELECT DISTINCT d.scan_id, src, dst FROM depends_on d WHERE scan_id IN (SELECT scan_id FROM targets)),
starts AS (SELECT DISTINCT scan_id, component_id AS root, depth AS root_depth FROM has_component WHERE is_direct AND scan_id IN (SELECT scan_id FROM targets)),
walk(scan_id, root, node, chain) AS (
  SELECT scan_id, root, root, [root] FROM starts
  UNION ALL SELECT w.scan_id, w.root, e.dst, list_append(w.chain, e.dst) FROM walk w JOIN edges e ON w.scan_id = e.scan_id AND w.node = e.src WHERE len(w.chain) <= 12),
short AS (
  SELECT w.scan_id, w.root, t.component_id AS target, arg_min(w.chain, (len(w.chain), w.chain)) AS chain
  FROM walk w JOIN targets t ON w.scan_id = t.scan_id AND w.node = t.component_id GROUP BY w.scan_id, w.root, t.component_id),
found AS (
  SELECT s.scan_id, s.root, target, CAST(len(chain) - 1 AS INT) AS hops, array_to_string(chain, '>') AS chain, CAST(root_depth + len(chain) - 1 AS INT) AS reached_depth
  FROM short s JOIN starts USING (scan_id, root))"""


def share(text: str) -> str:
    """A number from 0 to 16,777,215 that depends on a text alone."""
    return f"('0x' || substr(md5({text}), 1, 6))::INT"


SHARE = share("project || vuln_id")

TIER = """CASE WHEN reachability_verdict IN ('confirmed_reachable', 'likely_reachable') THEN 'fix_now' WHEN kev AND len(fix_versions) > 0 THEN 'plan_remediation' WHEN kev THEN 'mitigate'
  WHEN risk_score >= 65 AND len(fix_versions) > 0 THEN 'plan_remediation' WHEN risk_score >= 70 AND len(fix_versions) = 0 THEN 'mitigate' ELSE 'monitor' END"""
TEST = "regexp_matches(lower(x), 'test|spec|fixture')"


def cases_cte(name: str, alerts: str, with_states: bool) -> str:
    status = "coalesce(CASE lower(CASE WHEN o.vuln_id IS NOT NULL THEN o.status ELSE w.status END) WHEN 'fix_planned' THEN 'planned' WHEN 'verified_closed' THEN 'verified_closed' WHEN 'in_progress' THEN 'in_progress' END, 'new')"
    joins = """LEFT JOIN states o ON c.project || '|' || c.vuln_id || '|' || c.component_id = o.own
  LEFT JOIN (SELECT * FROM states WHERE component_id = '') w ON c.project || '|' || c.vuln_id || '|' = w.own"""
    return f""",
{name}_plain AS (
  SELECT *, all_component_ids[1] AS component_id, all_components[1] AS component_name, all_versions[1] AS component_version, len(fix_versions) > 0 AS has_fix, {TIER} AS decision_tier,
    CASE WHEN risk_score >= 85 THEN 'Critical' WHEN risk_score >= 70 THEN 'High' WHEN risk_score >= 40 THEN 'Medium' ELSE 'Low' END AS risk_band,
    CASE WHEN reachability_verdict = 'confirmed_reachable' AND len(call_locations) > 0 THEN 'high' WHEN reachability_verdict IN ('confirmed_reachable', 'likely_reachable') THEN 'medium'
      WHEN len(fix_versions) > 0 THEN 'medium' ELSE 'low' END AS evidence_confidence,
    len(list_filter(call_locations, lambda x: {TEST})) AS in_tests, len(list_filter(call_locations, lambda x: NOT {TEST})) AS in_code FROM {alerts}),
{name} AS (
  SELECT c.*, CASE WHEN in_tests > 0 AND in_code > 0 THEN 'mixed' WHEN in_tests > 0 THEN 'test' WHEN in_code > 0 THEN 'production' ELSE 'none' END AS evidence_scope,
    CASE c.decision_tier WHEN 'fix_now' THEN 'Vulnerable code is reachable.' WHEN 'plan_remediation' THEN 'Risk is high enough to schedule an upgrade.'
      WHEN 'mitigate' THEN 'Risk is high and needs a temporary control.' ELSE 'Risk is low enough to keep watching.' END || CASE WHEN kev THEN ' It is known to be exploited.' ELSE '' END
      || CASE WHEN has_fix THEN ' A fixed version exists.' ELSE ' No fixed version is known.' END AS tier_reason,
    {PREFERRED} AS target_version,
    {status if with_states else "'new'"} AS status, {"CASE WHEN o.vuln_id IS NOT NULL THEN o.owner ELSE w.owner END" if with_states else "NULL"} AS owner
  FROM {name}_plain c {joins if with_states else ""})"""


#: The best of the test tables' versions ('1.n.0', '2.0.0-rcn'): by number, and at equal numbers by suffix.
PREFERRED = """list_transform(list_sort(list_transform(fix_versions, lambda v: {'a': CAST(split_part(v, '.', 1) AS INT), 'b': CAST(split_part(v, '.', 2) AS INT), 'v': v}), 'DESC'), lambda s: s.v)[1]"""

STATES = f""",
states AS MATERIALIZED (
  SELECT *, project || '|' || vuln_id || '|' || component_id AS own FROM (SELECT project, vuln_id, CASE WHEN h = 6 THEN '' ELSE all_component_ids[1] END AS component_id, 'monitor' AS decision_tier,
    CASE h WHEN 0 THEN 'fix_planned' WHEN 3 THEN 'Verified_Closed' ELSE 'in_progress' END AS status, 'me' AS owner FROM (SELECT *, {SHARE} % 9 AS h FROM alerts) WHERE h % 3 = 0))"""
CASES = STATES + cases_cte("cases", "alerts", True)

DELTA = """,
earlier AS (
  SELECT scan_id, project, generated_at, branch, source_commit FROM (
    SELECT *, row_number() OVER (PARTITION BY project ORDER BY generated_at DESC NULLS FIRST, scan_id DESC) AS n FROM sboms) WHERE n = 2),
old_exposures AS (
  SELECT s.*, h.component_id, h.depth, c.name, c.version, c.scope, v.* EXCLUDE (id), v.id AS vuln,
    coalesce(list_filter(coalesce(v.aliases, CAST([] AS VARCHAR[])), lambda x: starts_with(x, 'CVE-'))[1], v.id, v.aliases[1]) AS vuln_id
  FROM earlier s JOIN projects p USING (project) JOIN has_component h USING (scan_id) JOIN components c USING (component_id)
  JOIN affected_by a USING (component_id) JOIN vulns v ON v.id = a.vuln),""" + alerts_cte("old_alerts", "project, scan_id, generated_at, source_commit, vuln_id", "old_exposures") + cases_cte("old_cases", "old_alerts", False) + cases_cte("new_cases", "alerts", False) + f""",
delta AS (
  SELECT project, vuln_id, component_id, old_risk_score, new_risk_score, risk_delta, old_reachability_verdict, new_reachability_verdict,
    array_to_string(list_filter([CASE WHEN added THEN 'added' END, CASE WHEN resolved THEN 'resolved' END, CASE WHEN risk_delta > 0.01 THEN 'risk_increased' END, CASE WHEN risk_delta < -0.01 THEN 'risk_decreased' END,
      CASE WHEN new_rank < old_rank THEN 'verdict_improved' END, CASE WHEN new_rank > old_rank THEN 'verdict_regressed' END, CASE WHEN new_fix AND NOT old_fix THEN 'fix_gained' END,
      CASE WHEN NOT new_fix AND old_fix THEN 'fix_lost' END], lambda x: x IS NOT NULL), '|') AS changes,
    CASE WHEN resolved THEN 'Verify and close: the finding is gone.' WHEN added THEN 'Triage the new finding.' ELSE 'Keep tracking.' END AS advice
  FROM (
    SELECT coalesce(n.project, o.project) AS project, coalesce(n.vuln_id, o.vuln_id) AS vuln_id, coalesce(n.component_id, o.component_id) AS component_id, o.risk_score AS old_risk_score,
      n.risk_score AS new_risk_score, round(n.risk_score - o.risk_score, 4) AS risk_delta, o.reachability_verdict AS old_reachability_verdict, n.reachability_verdict AS new_reachability_verdict,
      o.project IS NULL AS added, n.project IS NULL AS resolved, o.has_fix AS old_fix, n.has_fix AS new_fix,
      CASE o.reachability_verdict WHEN 'confirmed_reachable' THEN 4 WHEN 'likely_reachable' THEN 3 WHEN 'no_sink_data' THEN 2 WHEN 'likely_unreachable' THEN 1 WHEN 'uncertain' THEN -1 END AS old_rank,
      CASE n.reachability_verdict WHEN 'confirmed_reachable' THEN 4 WHEN 'likely_reachable' THEN 3 WHEN 'no_sink_data' THEN 2 WHEN 'likely_unreachable' THEN 1 WHEN 'uncertain' THEN -1 END AS new_rank
    FROM old_cases o FULL JOIN new_cases n ON o.project = n.project AND o.vuln_id = n.vuln_id AND o.component_id = n.component_id))"""

TIER_RANK = "CASE {} WHEN 'fix_now' THEN 0 WHEN 'plan_remediation' THEN 1 WHEN 'mitigate' THEN 2 WHEN 'monitor' THEN 3 WHEN 'accept' THEN 4 ELSE 9 END"
OPEN = "status NOT IN ('resolved_pending_verify', 'verified_closed')"
AREA_OF = """CASE WHEN live IS NULL THEN 'general' WHEN regexp_matches(lower(live), 'test|spec|fixture') THEN 'test' WHEN regexp_matches(lower(live), 'admin') THEN 'admin'
  WHEN regexp_matches(lower(live), 'api|route|controller') THEN 'api' WHEN regexp_matches(lower(live), 'front|ui/|view|component') THEN 'frontend'
  WHEN regexp_matches(lower(live), 'src|server|back|lib') THEN 'backend' ELSE 'general' END"""
AREAS = f""",
placed AS (SELECT *, {AREA_OF} AS area FROM (SELECT *, list_filter(call_locations, lambda x: NOT {TEST})[1] AS live FROM cases WHERE {OPEN})),
in_order AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY {TIER_RANK.format("decision_tier")}, kev DESC, risk_score DESC NULLS LAST, cvss DESC NULLS LAST, vuln_id, component_id) AS k,
  CASE WHEN decision_tier = 'fix_now' THEN 'needs a fix now' WHEN has_fix THEN 'an upgrade is available' WHEN reachability_verdict IN ('confirmed_reachable', 'likely_reachable') THEN 'reachable code' END AS why FROM placed),
by_area AS (
  SELECT project, area, count(*) AS cases, list(vuln_id ORDER BY k) AS v, coalesce(arg_max(why, k) FILTER (why IS NOT NULL), 'keep watching') AS focus, bool_or(decision_tier = 'fix_now') AS urgent, min(k) AS first
  FROM in_order GROUP BY project, area),
areas AS (
  SELECT project, CAST(rank AS INT) AS rank, CASE WHEN n = 1 AND area = 'general' THEN 'Repository-Wide Exposure' ELSE upper(area[1:1]) || area[2:] END AS title, cases, urgent, array_to_string(v[1:5], '|') AS vulns, focus
  FROM (SELECT *, count(*) OVER (PARTITION BY project) AS n, row_number() OVER (PARTITION BY project ORDER BY urgent DESC, cases DESC, first) AS rank FROM by_area) WHERE rank <= 3)"""

EVIDENCE_RANK = "CASE {} WHEN 'confirmed_reachable' THEN 4 WHEN 'likely_reachable' THEN 3 WHEN 'no_sink_data' THEN 2 WHEN 'likely_unreachable' THEN 1 ELSE -1 END"
CLUSTERS = f""",
keyed AS (
  SELECT *, lower(component_name) AS component, lower(coalesce(component_version, '')) AS version_key, lower(area) AS area_key, lower(decision_tier) AS tier,
    row_number() OVER (PARTITION BY project ORDER BY {TIER_RANK.format("decision_tier")}, kev DESC, reachability_verdict = 'confirmed_reachable' DESC, risk_score DESC NULLS LAST, cvss DESC NULLS LAST, vuln_id, component_id) AS j
  FROM placed),
cluster_places AS (
  SELECT project, component, version_key, area_key, tier, array_to_string(list(loc ORDER BY j, i)[1:5], '|') AS places FROM (
    SELECT project, component, version_key, area_key, tier, loc, min(j) AS j, min_by(i, j) AS i FROM (
      SELECT project, component, version_key, area_key, tier, j, unnest(call_locations) AS loc, generate_subscripts(call_locations, 1) AS i FROM keyed) GROUP BY ALL) GROUP BY project, component, version_key, area_key, tier),
clusters AS (
  SELECT k.project, k.component, k.version_key AS version, k.area_key, k.tier, arg_min(vuln_id, j) AS lead, count(*) AS cases, array_to_string(list(vuln_id ORDER BY j), '|') AS vulns, coalesce(any_value(p.places), '') AS places,
    bool_or(has_fix) AS any_fix, max(risk_score) AS max_risk, max(cvss) AS max_cvss, bool_or(kev) AS any_kev,
    arg_max(reachability_verdict, ({EVIDENCE_RANK.format("reachability_verdict")}, reachability_verdict)) AS verdict,
    count_if(severity = 'critical') AS critical, count_if(severity = 'high') AS high, count_if(evidence_scope = 'production') AS production, count_if(evidence_scope = 'test') AS test_only, count_if(evidence_scope = 'mixed') AS mixed
  FROM keyed k LEFT JOIN cluster_places p USING (project, component, version_key, area_key, tier) GROUP BY k.project, k.component, k.version_key, k.area_key, k.tier)"""
TOP_CLUSTERS = f""",
top_clusters AS (
  SELECT project, CAST(rank AS INT) AS rank, component, version, area_key, tier, cases, CAST(all_cases AS BIGINT) AS all_cases, CAST(covered AS BIGINT) AS covered, CAST(all_cases - covered AS BIGINT) AS uncovered FROM (
    SELECT *, sum(cases) OVER (PARTITION BY project) AS all_cases, sum(cases) FILTER (rank <= 4) OVER (PARTITION BY project) AS covered FROM (
      SELECT *, row_number() OVER (PARTITION BY project ORDER BY {TIER_RANK.format("tier")}, {EVIDENCE_RANK.format("verdict")} DESC, any_fix DESC, max_risk DESC NULLS LAST, max_cvss DESC NULLS LAST, component, version, area_key) AS rank
      FROM clusters)) WHERE rank <= 4)"""
