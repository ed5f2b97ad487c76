"""Queries over report texts in sections, technical findings, words by audience, and rows of the scenario bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnloom.functions import vocabulary as V
from vulnloom.operators import narratives, scenarios
from vulnloom.plans import oracle as O
from vulnloom.plans.catalog import CASES, COMPONENT, PROJECT, REGISTRY, SINCE, VULN, _cases, flat, register
from vulnloom.plans.findings_catalog import ASKED, BUNDLED
from vulnloom.sources.testbed import Graph

# --- words --------------------------------------------------------------------------------------------------------

SHOWN = {"verdict_badge": ("verdict", "reachability", "stakeholder", "badge"), "verdict_sentence": ("verdict", "reachability", "developer", "sentence"), "tier_badge": ("tier", "tier", "developer", "badge"),
         "tier_sentence": ("tier", "tier", "stakeholder", "sentence"), "scope_badge": ("scope", "scope", "stakeholder", "badge"), "urgency_label": ("urgency", "urgency", "developer", "badge")}


def _presented(g: Graph) -> DataFrame:
    k = F.col("seq")
    rows = g.reachability.select(
        "seq", F.when(k % 7 == 0, F.concat(F.lit(" "), F.upper("verdict"))).otherwise(F.col("verdict")).alias("verdict"), F.when(k % 6 == 0, "fix_now").when(k % 6 == 1, "Mitigate ").when(k % 6 == 2, "accept_risk").when(k % 6 == 3, "soon").alias("tier"),
        F.when(k % 4 == 0, "production").when(k % 4 == 1, "test-only").when(k % 4 == 2, "").alias("scope"), F.when(k % 3 == 0, "next_window").when(k % 3 == 1, "never").alias("urgency"),
    )
    for name, (key, kind, audience, style) in SHOWN.items():
        rows = V.present(rows, key, kind, audience, style, name)
    return rows.select("seq", *SHOWN)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


WORDS_SQL = "words(audience, kind, key, style, text) AS (VALUES " + ", ".join("(" + ", ".join(map(_quoted, e)) + ")" for e in V.entries()) + ")"


def _word_sql(name: str) -> str:
    key, kind, audience, style = SHOWN[name]
    of = lambda k: f"(SELECT min(text) FROM words w WHERE w.kind = '{kind}' AND w.style = '{style}' AND w.audience IN ('{audience}', 'any') AND w.key = {k})"
    fallback = _quoted(V.FALLBACK[kind])
    return f"coalesce({of(f'lower(trim({key}))')}, {of(fallback)}) AS {name}"


register(
    "vocabulary_present",
    _presented,
    O.over(
        f"""SELECT seq, {", ".join(map(_word_sql, SHOWN))} FROM (SELECT seq, CASE WHEN seq % 7 = 0 THEN ' ' || upper(verdict) ELSE verdict END AS verdict, CASE seq % 6 WHEN 0 THEN 'fix_now' WHEN 1 THEN 'Mitigate ' WHEN 2 THEN 'accept_risk' WHEN 3 THEN 'soon' END AS tier,
  CASE seq % 4 WHEN 0 THEN 'production' WHEN 1 THEN 'test-only' WHEN 2 THEN '' END AS scope, CASE seq % 3 WHEN 0 THEN 'next_window' WHEN 1 THEN 'never' END AS urgency FROM reachability)""",
        O.BASE + ",\n" + WORDS_SQL,
    ),
)

# --- sections and findings ----------------------------------------------------------------------------------------

WHY_NOW = """CASE WHEN verdict = 'confirmed_reachable' THEN 'Code evidence shows it in an active path.' WHEN verdict = 'likely_reachable' AND any_fix THEN 'It is likely in use, and a fix exists.'
    WHEN verdict = 'likely_reachable' THEN 'It is likely in use.' WHEN any_kev THEN 'It is known to be exploited.' WHEN any_fix THEN 'A fix exists.' ELSE 'Severity and exposure justify planning.' END"""
WHY_FIX = """CASE WHEN verdict = 'confirmed_reachable' THEN 'Project code calls it.' WHEN verdict = 'likely_reachable' AND production > 0 THEN 'Production code uses it.'
    WHEN verdict = 'likely_reachable' AND test_only > 0 THEN 'Tests use it; confirm production use.' WHEN any_fix THEN 'Risk and a fix justify it.' ELSE 'Tier and evidence justify it.' END"""


def _cased(column: str, audience: str, kind: str, style: int) -> str:
    words = V.WORDS[audience, kind]
    return f"CASE {column} " + " ".join(f"WHEN {_quoted(k)} THEN {_quoted(t[style])}" for k, t in words.items()) + f" ELSE {_quoted(words[V.FALLBACK[kind]][style])} END"


COUNTED = """, counted AS (
  SELECT project, count(*) AS total, count_if(decision_tier = 'fix_now') AS fix_now, count_if(decision_tier = 'plan_remediation') AS plan, count_if(decision_tier = 'mitigate') AS mitigate, count_if(decision_tier IN ('monitor', 'accept')) AS monitor,
    count_if(has_fix) AS with_fix, count_if(status NOT IN ('resolved_pending_verify', 'verified_closed')) AS open, count_if(reachability_verdict = 'confirmed_reachable') AS confirmed, count_if(reachability_verdict = 'likely_reachable') AS likely,
    count_if(reachability_verdict = 'likely_unreachable') AS unlikely, count_if(reachability_verdict = 'no_sink_data') AS unknown FROM cases GROUP BY project),
opened AS (
  SELECT project, count_if(severity IN ('critical', 'high')) AS severe, count_if(kev) AS kev, count_if(reachability_verdict = 'confirmed_reachable') AS confirmed, count_if(reachability_verdict = 'likely_reachable') AS likely,
    count_if(coalesce(closest_depth, 0) <= 1) AS direct, count_if(coalesce(closest_depth, 0) > 1) AS transitive FROM cases WHERE status NOT IN ('resolved_pending_verify', 'verified_closed') GROUP BY project)"""

_used = lambda v: V.text_of("stakeholder", "reachability", v, "sentence")
register(
    "stakeholder_sections",
    lambda g: narratives.stakeholder_sections(_cases(g)),
    O.over(
        f"""SELECT c.project, position, section, CASE position
  WHEN 1 THEN fix_now || ' of ' || total || ' cases need action in this release. ' || coalesce(o.confirmed, 0) || ' {_used("confirmed_reachable")}, ' || coalesce(o.likely, 0) || ' {_used("likely_reachable")}. ' || coalesce(leads, 'No cluster is listed.')
  WHEN 2 THEN coalesce(severe, 0) || ' open cases are critical or high, ' || coalesce(o.kev, 0) || ' known to be exploited. Evidence lies in ' || coalesce(a.areas, 'the whole repository') || '. '
    || coalesce(direct, 0) || ' direct and ' || coalesce(transitive, 0) || ' transitive dependencies are open; ' || with_fix || ' cases have a fix.'
  WHEN 3 THEN coalesce(nullif(array_to_string(list_filter([CASE WHEN fix_now > 0 THEN 'Fix ' || fix_now || ' reachable findings now' END, CASE WHEN plan > 0 THEN 'Schedule ' || plan || ' upgrades' END,
    CASE WHEN mitigate > 0 THEN 'Put ' || mitigate || ' temporary controls in place' END, CASE WHEN open > 0 THEN 'Review ' || open || ' open findings' END], lambda x: x IS NOT NULL), '; '), ''), 'Nothing is to be decided.')
  ELSE monitor || ' cases stay under observation, which does not prove them safe.' END AS text
FROM counted c LEFT JOIN opened o ON o.project = c.project
LEFT JOIN (SELECT project, array_to_string(list(component || ': ' || {_cased("tier", "stakeholder", "tier", 0)} || '. ' || {WHY_NOW} ORDER BY rank), ' ') AS leads
  FROM top_clusters JOIN (SELECT project, component, version, area_key, tier, verdict, any_fix, any_kev FROM clusters) USING (project, component, version, area_key, tier) WHERE rank <= 2 GROUP BY project) l ON l.project = c.project
LEFT JOIN (SELECT project, array_to_string(list(title || ' (' || cases || ')' ORDER BY rank), ', ') AS areas FROM areas WHERE rank <= 2 GROUP BY project) a ON a.project = c.project
CROSS JOIN (VALUES (1, 'attention'), (2, 'importance'), (3, 'decision'), (4, 'uncertainty')) AS s(position, section)""",
        CASES + O.AREAS + O.CLUSTERS + O.TOP_CLUSTERS + COUNTED,
    ),
)
register(
    "developer_sections",
    lambda g: narratives.developer_sections(_cases(g)),
    O.over(
        f"""SELECT c.project, position, section, CASE position
  WHEN 1 THEN fix_now || ' to fix now, ' || plan || ' to plan, ' || mitigate || ' to mitigate, ' || monitor || ' to watch. ' || confirmed || ' have direct call evidence, ' || likely || ' an import only.'
  WHEN 2 THEN coalesce('First is ' || lead || ' on ' || component || ', which ' || {_cased("verdict", "developer", "reachability", 1)} || '. ' || {WHY_FIX}, 'Nothing has to be fixed now.')
  WHEN 3 THEN coalesce(CASE WHEN any_fix THEN 'Upgrade ' ELSE 'Isolate ' END || component || '.', 'Work on planned upgrades, then scan again.')
  ELSE unknown || ' cases lack evidence on functions, which leaves them open; ' || unlikely || ' were not seen in use.' END AS text
FROM counted c LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY {O.EVIDENCE_RANK.format("verdict")} DESC, any_fix DESC, max_risk DESC NULLS LAST, max_cvss DESC NULLS LAST, component, version, area_key) AS n
  FROM clusters WHERE tier = 'fix_now') WHERE n = 1) f ON f.project = c.project
CROSS JOIN (VALUES (1, 'queue'), (2, 'evidence'), (3, 'next'), (4, 'uncertainty')) AS s(position, section)""",
        CASES + O.AREAS + O.CLUSTERS + COUNTED,
    ),
)
register(
    "technical_findings",
    lambda g: flat(narratives.technical_findings(_cases(g)).drop("impact_summary"), ("call_locations", "key_call_evidence")),
    O.over(
        f"""SELECT project, vuln_id, component_name AS component, component_version AS current_version, severity, decision_tier, reachability_verdict, closest_depth AS dependency_depth, cvss, risk_score, {O.bar("fix_versions")},
  array_to_string(call_locations, '|') AS call_locations, array_to_string(call_locations[1:3], '|') AS key_call_evidence, CASE WHEN starts_with(vuln_id, 'CVE-') THEN 'https://nvd.nist.gov/vuln/detail/' || vuln_id END AS nvd_url,
  CASE WHEN decision_tier = 'fix_now' AND kev AND reachability_verdict IN ('confirmed_reachable', 'likely_reachable') THEN 'Known to be exploited, and in use.' WHEN decision_tier = 'fix_now' THEN 'Urgent: ' || facts || ', depth ' || closest_depth || '.'
    WHEN decision_tier = 'plan_remediation' THEN len(fix_versions) || ' versions fix it: ' || facts || '.' WHEN decision_tier = 'mitigate' THEN 'No ready fix settles it: ' || facts || '.'
    ELSE 'Weak evidence or little urgency: ' || facts || ', confidence ' || evidence_confidence || '.' END AS why_this_tier
FROM (SELECT *, printf('verdict %s, risk %.2f', reachability_verdict, risk_score) AS facts FROM cases)""",
        CASES,
    ),
)

# --- rows of bundles ----------------------------------------------------------------------------------------------


def _bundle_rows(g: Graph, name: str) -> DataFrame:
    frames = scenarios.bundle(g, name, PROJECT, ASKED, COMPONENT, SINCE)
    return scenarios.labelled_union({q: flat(df) for q, df in frames.items()})


def _rows_sql(name: str) -> str:
    """The single queries' rows under all their columns, by the SQL of each."""
    parts = []
    for q in scenarios.BUNDLES[name]:
        sql = REGISTRY[BUNDLED[q]][1].replace(f"'{VULN}'", f"'{ASKED}'")
        if q == "q13":
            sql = sql.replace("WHERE k <= 3", "WHERE k <= 5").replace("WHERE n <= 8", "WHERE n <= 15")
        parts.append(f"SELECT '{q}' AS _query, * FROM ({sql})")
    return " UNION ALL BY NAME ".join(parts)


for _name in scenarios.BUNDLES:
    register(f"bundle_rows_{_name}", lambda g, n=_name: _bundle_rows(g, n), _rows_sql(_name))
