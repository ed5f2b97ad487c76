"""Rules about single findings and clusters: list filters and sorts, labels, coercion of raw rows, texts of reports.

Each rule is a column function, or a projection with one; what looks at several rows is one group-by or one window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vulnloom.functions import exprs as X

# How findings are ordered for display.
TIER_ORDER = {"fix_now": 0, "plan_remediation": 1, "mitigate": 2, "monitor": 3, "accept_risk": 4}
VERDICT_ORDER = {"confirmed_reachable": 0, "likely_reachable": 1, "no_sink_data": 2, "likely_unreachable": 3, "unknown": 4}
SEVERITY_ORDER = {"critical": 0, "high": 1, "medium": 2, "low": 3}
# Words that say an exploit is public.
EXPLOIT_WORDS = ["proof-of-concept", "proof of concept", "poc", "public exploit", "working exploit"]

# --- the alert list -----------------------------------------------------------------------------------------------


def filtered(alerts: DataFrame, severities: Sequence[str] = (), verdicts: Sequence[str] = (), fix: bool | None = None, kev: bool = False, text: str = "") -> DataFrame:
    """Alerts of the chosen severities and verdicts, with (or without) a fix, known as exploited, that name ``text`` in a component or id."""
    out = alerts
    if severities:
        out = out.filter(X.severity(F.col("cvss"), F.col("kev")).isin(*severities))
    if verdicts:
        out = out.filter(F.coalesce("reachability_verdict", F.lit("no_sink_data")).isin(*verdicts))
    if kev:
        out = out.filter(F.coalesce("kev", F.lit(False)))
    if fix is not None:
        out = out.filter((F.size(X.strings(F.col("fix_versions"))) > 0) == F.lit(fix))
    if text:
        names = F.lower(F.array_join(X.strings(F.col("all_components")), " "))
        out = out.filter(F.contains(names, F.lit(text.lower())) | F.contains(F.lower(F.coalesce("vuln_id", F.lit(""))), F.lit(text.lower())))
    return out


def listed(alerts: DataFrame, by: str = "risk") -> list[Column]:
    """Order of the alert list: by risk or severity, the largest first, or by depth, unknown depths last; ties by identity."""
    first = {
        "risk": F.coalesce("risk_score", F.lit(0.0)).desc(),
        "severity": F.coalesce("cvss", F.lit(0.0)).desc(),
        "depth": F.col("closest_depth").asc_nulls_last(),
    }[by]
    return [first, F.col("project"), F.col("vuln_id")]


def rationale(verdict: Column, has_fix: Column) -> Column:
    """Why an alert stands where it does in the list."""
    return (
        F.when((verdict == "confirmed_reachable") & has_fix, "prioritized: reachable, and a fix exists")
        .when((verdict == "likely_reachable") & has_fix, "prioritized: likely reachable, and a fix exists")
        .when(verdict == "no_sink_data", "not escalated: no sink data")
        .when(verdict == "likely_unreachable", "monitored: evidence is weak or indirect")
        .otherwise("monitored: evidence is partial")
    )


def stats_bar(stats: DataFrame, alerts: DataFrame) -> DataFrame:
    """The counters of each project with the number of alerts that are confirmed reachable."""
    confirmed = alerts.groupBy("project").agg(F.count_if(F.col("reachability_verdict") == "confirmed_reachable").alias("confirmed_reachable"))
    return stats.join(confirmed, "project", "left").withColumn("confirmed_reachable", F.coalesce("confirmed_reachable", F.lit(0).cast("long")))


def compact(findings: DataFrame, most: int = 6) -> DataFrame:
    """The first findings of each project: by tier, verdict, severity, the deepest dependency, then identity."""
    rank = lambda c, table, default: X.lookup(F.coalesce(c, F.lit(default)), table, F.lit(9))
    order = Window.partitionBy("project").orderBy(
        rank(F.col("decision_tier"), TIER_ORDER, "monitor"), rank(F.col("reachability_verdict"), VERDICT_ORDER, "unknown"), rank(F.lower("severity"), SEVERITY_ORDER, "low"),
        F.coalesce("closest_depth", F.lit(0)).desc(), F.coalesce("vuln_id", F.lit("")), F.coalesce("component_name", F.lit("")),
    )
    return findings.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= most)


def two_by_two(rows: DataFrame, group: list[str], order: str) -> DataFrame:
    """(label, value) rows in pairs, left and right, in order; labels that are blank are skipped, blank values say so."""
    label, value = F.trim(F.coalesce("label", F.lit(""))), F.trim(F.coalesce("value", F.lit("")))
    kept = rows.withColumns({"label": label, "value": F.when(value == "", "None listed").otherwise(value)}).filter("label <> ''")
    placed = kept.withColumn("_k", F.row_number().over(Window.partitionBy(*group).orderBy(order)) - 1)
    side = lambda k, c: F.coalesce(F.max(F.when(F.col("_k") % 2 == k, F.col(c))), F.lit(""))
    return placed.groupBy(*group, F.floor(F.col("_k") / 2).alias("pair")).agg(side(0, "label").alias("left_label"), side(0, "value").alias("left_value"), side(1, "label").alias("right_label"), side(1, "value").alias("right_value"))


# --- raw rows -----------------------------------------------------------------------------------------------------


def number(c: Column) -> Column:
    """A number to four digits, null where the text is none."""
    return F.round(c.cast("string").try_cast("double"), 4)


def truth(c: Column) -> Column:
    """true, 1 and yes in any case are true, anything else that is given is not."""
    return F.when(c.isNotNull(), F.lower(c.cast("string")).isin("true", "1", "yes"))


def snippet(text: Column, most: int) -> Column:
    """Text with single spaces, cut to ``most`` characters with an ellipsis; null if nothing is left."""
    clean = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(clean == "", F.lit(None)).when(F.length(clean) <= most, clean).otherwise(F.concat(F.rtrim(F.substring(clean, 1, most - 3)), F.lit("...")))


def section(text: Column, heading: str, most: int) -> Column:
    """A text from a heading on, cut as a snippet; null if it has none."""
    clean = F.trim(F.regexp_replace(text, r"\s+", " "))
    at = F.instr(F.lower(clean), heading.lower())
    return F.when(at > 0, snippet(F.substring(clean, at, F.length(clean)), most))


def public_exploit(text: Column) -> Column:
    """Whether a text says that an exploit is public; null for no text."""
    low = F.lower(text)
    said = F.lit(False)
    for word in EXPLOIT_WORDS:
        said = said | F.contains(low, F.lit(word))
    return F.when(F.trim(low) != "", said)


def first_given(df: DataFrame, *names: str) -> Column:
    """The first of the columns (or fields, as ``v.id``) that there is and that is given, as text; blank texts are not."""
    known = {f"{c}.{f.name}" if f else c for c in df.columns for f in [None, *(getattr(df.schema[c].dataType, "fields", None) or [])]}
    found = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in known]
    return F.coalesce(*found, F.lit(None).cast("string"))


def evidence(rows: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """Raw retrieval rows, whatever columns they have, as evidence records of one shape (and the columns of ``also``).

    Flat columns are preferred over fields of the nodes p (project), c (component), v (vulnerability) and l (location).
    """
    pick = lambda *names: first_given(rows, *names)
    lists = lambda *names: F.coalesce(*[F.filter(X.strings(F.col(n)), lambda x: x.isNotNull()) for n in names if n in rows.columns and rows.schema[n].dataType.simpleString() == "array<string>"], F.array().cast("array<string>"))
    summary = pick("detail_summary", "v.detail_summary")
    return rows.select(
        pick("project", "full_name", "p.full_name", "p.name").alias("project"),
        pick("component", "c.name").alias("component"),
        pick("current_version", "version", "component_version", "c.version").alias("version"),
        pick("vulnerability", "v.id").alias("vulnerability"),
        number(pick("cvss", "cvss_score", "v.cvss_score")).alias("cvss"),
        truth(pick("kev", "v.kev")).alias("kev"),
        number(pick("epss", "v.epss")).alias("epss"),
        lists("suggested_fix_versions", "fix_versions").alias("fix_versions"),
        lists("aliases").alias("aliases"),
        snippet(summary, 1200).alias("detail_summary"),
        snippet(summary, 700).alias("impact_summary"),
        F.coalesce(section(summary, "## Proof of Concept", 500), section(summary, "Proof of Concept", 500)).alias("poc_summary"),
        public_exploit(summary).alias("has_public_poc"),
        F.coalesce(F.get(lists("touched_paths"), F.lit(0)), pick("l.path")).alias("location_path"),
        F.coalesce(F.get(lists("touched_lines"), F.lit(0)), pick("l.line")).try_cast("int").alias("location_line"),
        lists("dependency_chain", "chain").alias("dependency_chain"),
        pick("depth", "dependency_depth", "target_depth").try_cast("int").alias("depth"),
        number(pick("risk_score")).alias("risk_score"),
        *also,
    )


def _of_text(text: Column) -> Column:
    """What project|vulnerability|component (place 5) and project|vulnerability (place 6) a text may name, whatever bars the parts hold."""
    parts = F.split(text, r"\|")
    n = F.size(parts)
    cut = lambda i, j: F.array_join(F.slice(parts, i + 1, j - i), "|")
    named = lambda i, j: F.struct(cut(F.lit(0), i).alias("project"), cut(i, j).alias("vuln_id"), F.when(j < n, cut(j, n)).alias("component_id"), F.when(j < n, 5).otherwise(6).alias("place"))
    ways = F.transform(F.filter(F.sequence(F.lit(1), n), lambda i: i < n), lambda i: F.transform(F.sequence(i + 1, n), lambda j: named(i, j)))
    return F.filter(F.flatten(ways), lambda x: (x["project"] != "") & (x["vuln_id"] != ""))


def resolve_states(cases: DataFrame, states: DataFrame, partitions: int | None = None) -> DataFrame:
    """``cases`` with the stored ``status`` and ``owner`` that fit best, null if none does.

    ``states`` (vuln_id, status, owner; project, component_id, state_key and updated_at may be left out or null) are known by
    six shapes of key, the most telling first: project, vulnerability and component; project and vulnerability; vulnerability
    and component; the vulnerability; the text project|vulnerability|component in ``state_key``; the text project|vulnerability.
    Of states of one key the newest counts, of equally new ones the largest by status and owner.  Cases without a vulnerability
    keep no state.

    States are put beside the cases, and windows tell each case the newest of its keys: first those that name a project, where
    the cases lie if these are dealt by project to ``partitions`` tasks, then the others, for which cases are moved once, to
    their vulnerability.
    """
    given = lambda c: F.col(c) if c in states.columns else F.lit(None).cast("string")
    part = lambda c: F.nullif(given(c), F.lit(""))
    newest = F.struct(F.coalesce(given("updated_at").cast("string"), F.lit("")).alias("at"), F.struct("status", "owner").alias("s"))
    known = states.select(part("project").alias("project"), part("vuln_id").alias("vuln_id"), part("component_id").alias("component_id"), part("state_key").alias("_text"), newest.alias("_n"))
    place = F.when(F.col("project").isNull(), F.when(F.col("component_id").isNull(), 4).otherwise(3)).otherwise(F.when(F.col("component_id").isNull(), 2).otherwise(1))
    one = F.struct("project", "vuln_id", "component_id", place.alias("place"))
    keyed = known.withColumn("_k", F.explode(F.when(F.col("vuln_id").isNotNull(), F.array(one)).otherwise(_of_text(F.col("_text"))))).select("_k.*", "_n")
    keyed = keyed.withColumn("_component", F.coalesce("component_id", F.lit(""))).drop("component_id")
    own, shared = keyed.filter("place NOT IN (3, 4)"), keyed.filter("place IN (3, 4)").drop("project")
    own = own.repartition("project") if partitions is None else own.repartition(partitions, "project")
    rows = cases.drop("status", "owner").withColumns({"_component": F.coalesce("component_id", F.lit("")), "_case": F.lit(True)})
    newest_of = lambda n, *by: F.max(F.when(F.col("place") == n, F.col("_n"))).over(Window.partitionBy(*by))
    met = rows.unionByName(own, allowMissingColumns=True)
    whole, part_of = ("project", "vuln_id", "_component"), ("project", "vuln_id")
    met = met.withColumns({"_1": newest_of(1, *whole), "_5": newest_of(5, *whole)}).withColumns({"_2": newest_of(2, *part_of), "_6": newest_of(6, *part_of)})
    met = met.filter("_case").withColumns({"_first": F.coalesce("_1", "_2"), "_last": F.coalesce("_5", "_6")}).drop("_1", "_2", "_5", "_6", "place", "_n")
    met = met.unionByName(shared, allowMissingColumns=True).repartition("vuln_id")
    met = met.withColumn("_3", newest_of(3, "vuln_id", "_component")).withColumn("_4", newest_of(4, "vuln_id")).filter("_case")
    best = F.coalesce("_first", "_3", "_4", "_last")["s"]
    return met.withColumns({"status": best["status"], "owner": best["owner"]}).select(*cases.columns, *[x for x in ("status", "owner") if x not in cases.columns])


# --- report texts -------------------------------------------------------------------------------------------------


def evidence_area(locations: Column) -> Column:
    """First path segment of the first location outside tests (else of the first one), in lower case."""
    held = F.filter(X.strings(locations), lambda x: F.trim(x) != "")
    live = F.get(F.filter(held, lambda x: ~X.is_test_location(x)), F.lit(0))
    path = F.btrim(F.translate(F.coalesce(live, F.get(held, F.lit(0))), "\\", "/"), F.lit("/"))
    return F.coalesce(F.nullif(F.lower(F.split(path, "/")[0]), F.lit("")), F.lit("unknown_area"))


def readiness(has_fix: Column, verdict: Column) -> Column:
    return F.when(has_fix, "fix_available").when(X.is_reachable(verdict), "investigate").otherwise("workaround_only")


def why_later(verdict: Column, tier: Column, has_fix: Column) -> Column:
    """Why a finding is not to be fixed now."""
    return (
        F.when(verdict == "no_sink_data", "Evidence on its functions is missing; that does not prove it safe.")
        .when(verdict == "likely_unreachable", "No direct use was seen; verify as planned.")
        .when(tier == "mitigate", "It needs a mitigation or more investigation first.")
        .when(has_fix, "A fix exists, and a later window suits it.")
        .otherwise("Evidence or a fix is incomplete.")
    )


def why_now(verdict: Column, has_fix: Column, kev: Column) -> Column:
    """Why a cluster is a priority."""
    return (
        F.when(verdict == "confirmed_reachable", "Code evidence shows it in an active path.")
        .when((verdict == "likely_reachable") & has_fix, "It is likely in use, and a fix exists.")
        .when(verdict == "likely_reachable", "It is likely in use.")
        .when(F.coalesce(kev, F.lit(False)), "It is known to be exploited.")
        .when(has_fix, "A fix exists.")
        .otherwise("Severity and exposure justify planning.")
    )


def why_fix_now(verdict: Column, production: Column, tests: Column, has_fix: Column) -> Column:
    """Why a cluster is in the immediate queue."""
    return (
        F.when(verdict == "confirmed_reachable", "Project code calls it.")
        .when((verdict == "likely_reachable") & (production > 0), "Production code uses it.")
        .when((verdict == "likely_reachable") & (tests > 0), "Tests use it; confirm production use.")
        .when(has_fix, "Risk and a fix justify it.")
        .otherwise("Tier and evidence justify it.")
    )


def management_owner(tier: Column) -> Column:
    """Who acts on a cluster, and when."""
    owner = X.lookup(tier, {"fix_now": "release_manager", "plan_remediation": "developer_team"}, F.lit("platform_team"))
    urgency = X.lookup(tier, {"fix_now": "immediate", "plan_remediation": "next_window", "mitigate": "next_window"}, F.lit("monitor"))
    return F.concat_ws("/", owner, urgency)


def upgrade_step(component: Column, version: Column, target: Column) -> Column:
    known = F.coalesce(F.nullif(version, F.lit("")), F.lit("current"))
    return F.when(target.isNotNull(), F.concat(F.lit("Upgrade "), component, F.lit(" from "), known, F.lit(" to "), target)).otherwise(F.concat(F.lit("Find a safe version of "), component))


def merged_scope(scopes: Column) -> Column:
    """One evidence scope of several: mixed wins, and so do production and test together."""
    has = lambda s: F.array_contains(scopes, s)
    return F.when(has("mixed") | (has("production") & has("test")), "mixed").when(has("production"), "production").when(has("test"), "test").otherwise("none")


def merged_evidence(entries: DataFrame, keys: list[str], order: str, places: int = 5) -> DataFrame:
    """Per key the strongest verdict, the merged scope and the first distinct call locations in ``order``."""
    verdict = F.min(F.struct(X.lookup(F.col("reachability_verdict"), VERDICT_ORDER, F.lit(9)).alias("r"), F.col("reachability_verdict").alias("v")))["v"]
    listed_ = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), X.strings(F.col("call_locations")).alias("c"))))
    calls = F.array_distinct(F.filter(F.flatten(F.transform(listed_, lambda x: x["c"])), lambda x: F.trim(x) != ""))
    return entries.groupBy(*keys).agg(verdict.alias("reachability_verdict"), merged_scope(F.collect_set("evidence_scope")).alias("evidence_scope"), F.slice(calls, 1, places).alias("call_locations"))


def checkpoint(deltas: DataFrame, baselines: DataFrame, counts: DataFrame) -> DataFrame:
    """Per project the next verification: whether a comparison with the baseline means something, what to wait for, a note.

    ``deltas``: counters of changes; ``baselines`` (project, scan_id); ``counts``: open cases by tier.
    """
    return next_check(counts.select("project", "fix_now", "plan").join(deltas.select("project", "resolved", "risk_decreased", "verdict_improved"), "project", "left"), baselines)


def next_check(counts: DataFrame, baselines: DataFrame) -> DataFrame:
    """``checkpoint`` of counters of changes and of open cases in one row a project."""
    met = counts.join(baselines.select("project", F.col("scan_id").alias("baseline")), "project", "left")
    moved = F.greatest(*[F.coalesce(F.col(c), F.lit(0)) for c in ("resolved", "risk_decreased", "verdict_improved")]) > 0
    known = F.coalesce(F.trim("baseline") != "", F.lit(False))
    trigger = F.when(F.col("fix_now") > 0, "after remediation merges").when(F.col("plan") > 0, "after the planned release").otherwise("next scan")
    note = F.when(known & moved, F.concat(F.lit("Compared with "), "baseline", F.lit(": remediation shows."))).when(known, F.concat(F.lit("Compared with "), "baseline", F.lit(": no remediation shows yet."))).otherwise("No baseline yet; the next scan sets it.")
    return met.select("project", (known & moved).alias("meaningful"), trigger.alias("trigger"), note.alias("note"))


def narrative(overview: DataFrame) -> DataFrame:
    """(project, text): a short account of each project, made of its counts and its first cluster (``reports.overview``)."""
    lead = F.format_string("%d findings, %d of them severe and open; exposure is %s.", F.col("total"), F.coalesce("critical_high", F.lit(0)), F.coalesce("posture", F.lit("low")))
    work = F.format_string("%d to fix now, %d to plan, %d to mitigate; %d have a fix.", F.col("fix_now"), F.col("plan"), F.col("mitigate"), F.col("with_fix"))
    start = F.when(F.col("component").isNotNull(), F.format_string("Begin with %s %s.", F.col("component"), F.col("version"))).otherwise("Nothing is open.")
    return overview.select("project", F.concat_ws(" ", lead, work, start).alias("text"))


def normalised_cases(rows: DataFrame) -> DataFrame:
    """Raw rows as cases of one shape: what is missing gets a name that says so, what is not given follows from the rest.

    ``rows`` may have scope, reachability_verdict, call_locations, decision_tier and status; a tier or status that is none is
    replaced by the default.
    """
    shaped = _with_extra(rows, [c for c in ("scope", "reachability_verdict", "call_locations", "decision_tier", "status", "scan_id") if c in rows.columns])
    has_fix, kev = F.size("fix_versions") > 0, F.coalesce("kev", F.lit(False))
    verdict = F.coalesce(F.nullif("reachability_verdict", F.lit("")), F.lit("no_sink_data"))
    calls, chain = F.size("call_locations") > 0, F.size("dependency_chain") > 0
    tier = X.decision_tier(kev, F.col("risk_score"), verdict, has_fix)
    clean = F.lower(F.trim("decision_tier"))
    return shaped.select(
        F.coalesce("project", F.lit("unknown-project")).alias("project"), F.coalesce("vulnerability", F.lit("unknown-vulnerability")).alias("vuln_id"), F.coalesce("component", F.lit("unknown-component")).alias("component_name"),
        F.col("version").alias("component_version"), "cvss", "epss", "kev", X.severity(F.col("cvss"), F.col("kev")).alias("severity"), "fix_versions", F.col("depth").alias("dependency_depth"), verdict.alias("reachability_verdict"),
        X.confidence(verdict, calls, chain, has_fix).alias("evidence_confidence"), F.when(clean.isin(*X.TIERS), clean).otherwise(tier).alias("decision_tier"), X.valid_status(F.col("status")).alias("status"),
        snippet(F.col("detail_summary"), 420).alias("advisory_summary"), snippet(F.col("detail_summary"), 320).alias("impact_summary"),
    )


def _with_extra(rows: DataFrame, extra: list[str]) -> DataFrame:
    """``evidence`` of the rows beside the columns that it does not have; missing ones are null or empty."""
    shaped = evidence(rows, [*extra])
    for name, kind in {"scope": "string", "reachability_verdict": "string", "decision_tier": "string", "status": "string", "call_locations": "array<string>"}.items():
        if name not in extra:
            shaped = shaped.withColumn(name, F.lit(None).cast(kind))
    return shaped.withColumn("call_locations", X.strings(F.col("call_locations")))
