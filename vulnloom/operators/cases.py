"""Cases: alerts with a decision, their stored state, snapshots of reports and what changed between two of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vulnloom.functions import exprs as X

CASE_STATE = "project string, vuln_id string, component_id string, decision_tier string, status string, owner string, note string, last_seen_scan_id string, last_verified_at string, updated_at string"
CLOSED = ("resolved_pending_verify", "verified_closed")


def alert_cases(alerts: DataFrame, states: DataFrame | None = None, chains: DataFrame | None = None) -> DataFrame:
    """One case per alert: risk fields, evidence, a decision tier and the stored status.

    A state of the case's own component is preferred over one of the whole vulnerability (component '').  States are given
    as a table, or lie with the alerts already (``states``, as ``alerts.alerts`` gathers them).  ``chains``
    (project, vuln_id, dependency_chain) says how the component is reached.
    """
    component = F.element_at(F.array_sort("all_component_ids"), 1)
    name = F.element_at(F.array_sort("all_components"), 1)
    version = F.element_at(F.array_sort("all_versions"), 1)
    rows = alerts.withColumns({"component_id": component, "component_name": name, "component_version": version})
    if chains is None:
        rows = rows.withColumn("dependency_chain", F.array().cast("array<string>"))
    else:
        rows = rows.join(chains, ["project", "vuln_id"], "left").withColumn("dependency_chain", X.strings(F.col("dependency_chain")))
    has_fix = F.size(X.strings(F.col("fix_versions"))) > 0
    has_calls = F.size(X.strings(F.col("call_locations"))) > 0
    tier = X.decision_tier(F.col("kev"), F.col("risk_score"), F.col("reachability_verdict"), has_fix)
    rows = rows.withColumns(
        {
            "has_fix": has_fix,
            "decision_tier": tier,
            "tier_reason": X.tier_reason(tier, F.col("kev"), F.col("reachability_verdict"), has_fix),
            "evidence_confidence": X.confidence(F.col("reachability_verdict"), has_calls, F.size("dependency_chain") > 0, has_fix),
            "evidence_scope": X.evidence_scope(F.col("call_locations")),
            "target_version": X.preferred_version(F.col("fix_versions")),
            "risk_band": X.risk_band(F.col("risk_score")),
        }
    )
    if states is None and "states" in rows.columns:
        one = lambda c: F.get(F.filter("states", lambda x: x["component_id"] == c), F.lit(0))
        own, wide = one(F.col("component_id")), one(F.lit(""))
        chosen = {c: F.when(own.isNotNull(), own[c]).otherwise(wide[c]) for c in ("status", "owner", "note")}
        return rows.withColumns(chosen).withColumn("status", X.valid_status(F.col("status"))).drop("states")
    if states is None:
        return rows.withColumns({"status": F.lit("new"), "owner": F.lit(None).cast("string"), "note": F.lit(None).cast("string")})
    pick = lambda n: states.select(F.col("project").alias(f"{n}p"), F.col("vuln_id").alias(f"{n}v"), F.coalesce("component_id", F.lit("")).alias(f"{n}c"), *[F.col(c).alias(f"{n}_{c}") for c in ("status", "owner", "note")])
    own, wide = pick("o"), pick("w").filter("wc = ''")
    met = rows.join(own, (F.col("project") == F.col("op")) & (F.col("vuln_id") == F.col("ov")) & (F.col("component_id") == F.col("oc")), "left")
    met = met.join(wide, (F.col("project") == F.col("wp")) & (F.col("vuln_id") == F.col("wv")), "left")
    found = F.col("ov").isNotNull()
    chosen = {c: F.when(found, F.col(f"o_{c}")).otherwise(F.col(f"w_{c}")) for c in ("status", "owner", "note")}
    return met.withColumns(chosen).withColumn("status", X.valid_status(F.col("status"))).drop(*own.columns, *wide.columns)


# --- state --------------------------------------------------------------------------------------------------------

KEY = ["project", "vuln_id", "component_id"]


def upsert_states(old: DataFrame, new: DataFrame) -> DataFrame:
    """States after an update: given values replace, missing ones keep what was stored.  ``new`` has one row a key."""
    fields = [c for c in old.columns if c not in KEY]
    keyed = lambda df: df.withColumn("component_id", F.coalesce("component_id", F.lit("")))
    b = keyed(new).select(*KEY, *[F.col(c).alias(f"new_{c}") for c in fields])
    met = keyed(old).join(b, KEY, "full_outer")
    default = {"status": F.lit("new"), "decision_tier": F.lit("monitor")}
    return met.select(*KEY, *[F.coalesce(f"new_{c}", c, default.get(c, F.lit(None))).alias(c) for c in fields])


def bootstrap_states(old: DataFrame, cases: DataFrame) -> DataFrame:
    """States with a ``new`` one for each case that has none; existing ones stay as they are."""
    fresh = cases.select("project", "vuln_id", "component_id", "decision_tier").distinct().join(old.select(*KEY), KEY, "left_anti")
    return old.unionByName(fresh.withColumn("status", F.lit("new")), allowMissingColumns=True)


def retier(states: DataFrame, cases: DataFrame) -> DataFrame:
    """States with tiers as recomputed (status, owner and note stay); ``changed`` says where that made a difference."""
    tiers = cases.select(*KEY, F.col("decision_tier").alias("_tier"))
    met = states.join(tiers, KEY, "left")
    changed = F.coalesce(F.col("_tier") != F.col("decision_tier"), F.lit(False))
    return met.withColumn("changed", changed).withColumn("decision_tier", F.coalesce("_tier", "decision_tier")).drop("_tier")


# --- snapshots ----------------------------------------------------------------------------------------------------


def snapshot(cases: DataFrame) -> DataFrame:
    return cases.select(
        "project", "scan_id", "source_commit", "vuln_id", "component_id", "risk_score", "reachability_verdict",
        F.col("has_fix").alias("fix_available"), "decision_tier", "status",
    )


def baseline_run(runs: DataFrame, snapshots: DataFrame, last: int = 10) -> DataFrame:
    """(project, run_id, scan_id): of each project's ``last`` runs the newest with another scan than its current one and a snapshot."""
    newest = Window.partitionBy("project").orderBy(F.desc("generated_at"), F.desc("run_id"))
    ranked = runs.withColumn("n", F.row_number().over(newest)).withColumn("current", F.first("scan_id").over(newest))
    fit = ranked.filter((F.col("n") <= last) & ~F.col("scan_id").eqNullSafe(F.col("current"))).join(snapshots.select("run_id").distinct(), "run_id", "left_semi")
    return fit.withColumn("k", F.row_number().over(newest)).filter("k = 1").select("project", "run_id", "scan_id")


def recent_runs(runs: DataFrame, n: int) -> DataFrame:
    """(project, run_id, scan_id, n): the newest runs of each project, numbered."""
    newest = Window.partitionBy("project").orderBy(F.desc("generated_at"), F.desc("run_id"))
    return runs.withColumn("n", F.row_number().over(newest)).filter(F.col("n") <= n).select("project", "run_id", "scan_id", "n")


def delta(old: DataFrame, new: DataFrame, least: float = 0.01) -> DataFrame:
    """Changed cases between two snapshots of the same projects, with what changed and advice on closing.

    Both sides are gathered under their key, so that snapshots which are dealt by project are compared where they lie; a key
    that a side has several times gives every pair, as a join would.
    """
    cols = ["risk_score", "reachability_verdict", "fix_available", "status"]
    fields = ["project", "vuln_id", "component_id", *cols]
    key = ["project", "vuln_id", "component_id"]
    side = lambda df, n: df.select(*key, F.struct(*[F.col(c).alias(f"{n}_{c}") for c in fields]).alias(f"_{n}"))
    both = side(old, "old").unionByName(side(new, "new"), allowMissingColumns=True)
    met = both.groupBy(*key).agg(F.collect_list("_old").alias("_old"), F.collect_list("_new").alias("_new"))
    met = met.select(F.explode_outer("_old").alias("_old"), "_new").select("_old", F.explode_outer("_new").alias("_new")).select("_old.*", "_new.*")
    return compared(met, least)


def compared(met: DataFrame, least: float = 0.01, *more: Column) -> DataFrame:
    """What changed between the sides of ``met`` (old_project to old_status, new_project to new_status, null where a side has none), with the columns of ``more``."""
    added, resolved = F.col("old_project").isNull(), F.col("new_project").isNull()
    both = ~added & ~resolved
    moved = F.round(F.col("new_risk_score") - F.col("old_risk_score"), 4)
    rank = lambda n: X.verdict_rank(F.col(f"{n}_reachability_verdict"), X.EVIDENCE_RANK)
    kinds = [
        ("added", added),
        ("resolved", resolved),
        ("risk_increased", both & (moved > least)),
        ("risk_decreased", both & (moved < -least)),
        ("verdict_improved", both & (rank("new") < rank("old"))),
        ("verdict_regressed", both & (rank("new") > rank("old"))),
        ("fix_gained", both & F.col("new_fix_available") & ~F.col("old_fix_available")),
        ("fix_lost", both & ~F.col("new_fix_available") & F.col("old_fix_available")),
    ]
    changes = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in kinds]))
    advice = (
        F.when(resolved, "Verify and close: the finding is gone.").when(F.coalesce(F.col("new_status") == "resolved_pending_verify", F.lit(False)), "Still present: reopen.")
        .when(added, "Triage the new finding.").otherwise("Keep tracking.")
    )
    return met.select(
        F.coalesce("new_project", "old_project").alias("project"), F.coalesce("new_vuln_id", "old_vuln_id").alias("vuln_id"), F.coalesce("new_component_id", "old_component_id").alias("component_id"),
        "old_risk_score", "new_risk_score", moved.alias("risk_delta"), "old_reachability_verdict", "new_reachability_verdict", changes.alias("changes"), advice.alias("advice"), *more,
    )


def changed_rows(deltas: DataFrame, ordered: bool = True) -> DataFrame:
    """Rows with a change, regressions first unless the order is left open (which moves no row)."""
    if not ordered:
        return deltas.filter(F.size("changes") > 0)
    has = lambda x: F.array_contains("changes", x)
    order = [has("verdict_regressed").desc(), has("risk_increased").desc(), F.abs(F.coalesce("risk_delta", F.lit(0.0))).desc(), "project", "vuln_id", "component_id"]
    return deltas.filter(F.size("changes") > 0).orderBy(*order)


def delta_summary(deltas: DataFrame) -> DataFrame:
    """Counters per project."""
    has = lambda x: F.count_if(F.array_contains("changes", x)).alias(x)
    names = ("added", "resolved", "risk_increased", "risk_decreased", "verdict_improved", "verdict_regressed", "fix_gained", "fix_lost")
    return deltas.groupBy("project").agg(
        F.count_if(~F.array_contains("changes", "added")).alias("baseline"), F.count_if(~F.array_contains("changes", "resolved")).alias("current"),
        *[has(n) for n in names], F.count_if(F.size("changes") == 0).alias("unchanged"),
    )
