"""Column functions of the risk model.  Everything is a built-in expression: nothing leaves the JVM."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the risk model: verdicts with their factor, and the two orders in which verdicts outrank each other.
REACH_FACTOR = {"confirmed_reachable": 1.0, "likely_reachable": 0.7, "likely_unreachable": 0.3, "no_sink_data": 0.5}
VERDICT_RANK = {"confirmed_reachable": 4, "likely_reachable": 3, "uncertain": 2, "likely_unreachable": 1, "no_sink_data": 0}
EVIDENCE_RANK = {"confirmed_reachable": 4, "likely_reachable": 3, "no_sink_data": 2, "likely_unreachable": 1}
TIERS = ("fix_now", "plan_remediation", "mitigate", "monitor", "accept")
STATUSES = ("new", "triaged", "planned", "in_progress", "resolved_pending_verify", "verified_closed")
LEGACY_STATUS = {"fix_planned": "planned", "mitigation_planned": "planned", "deferred": "planned", "accepted_risk": "planned"}
ECOSYSTEMS = {"golang": "go", "gem": "rubygems"}
PACKAGE_MANAGERS = {"pypi": "pip", "golang": "go", "gem": "bundler"}
TEST_MARKS = "test|spec|fixture"


@dataclass(frozen=True)
class RiskWeights:
    """Weights of severity, exploitation, scope and reachability; they must sum to 1."""

    severity: float = 0.25
    exploit: float = 0.25
    scope: float = 0.15
    reach: float = 0.35

    def __post_init__(self) -> None:
        parts = (self.severity, self.exploit, self.scope, self.reach)
        if abs(sum(parts) - 1) > 1e-9 or not all(0 <= p <= 1 for p in parts):
            raise ValueError("risk weights must lie in [0, 1] and sum to 1")


def lookup(key: Column, table: dict, default: Column | None = None) -> Column:
    """``table[key]``, else ``default`` (null if not given), as one CASE."""
    found = None
    for k, v in table.items():
        found = F.when(key == k, F.lit(v)) if found is None else found.when(key == k, F.lit(v))
    return found if default is None else found.otherwise(default)


def strings(array: Column) -> Column:
    return F.coalesce(array, F.array().cast("array<string>"))


def joined(array: Column) -> Column:
    """Sorted elements joined by a bar, '' for null: a scalar form of an unordered list."""
    return F.array_join(F.array_sort(strings(array)), "|")


def canonical_vuln_id(vuln_id: Column, aliases: Column) -> Column:
    """The first alias that is a CVE, else the id, else the first alias."""
    cve = F.try_element_at(F.filter(strings(aliases), lambda x: F.startswith(x, F.lit("CVE-"))), F.lit(1))
    return F.coalesce(cve, vuln_id, F.try_element_at(aliases, F.lit(1)))


def matches_vuln(vuln_id: Column, aliases: Column, wanted: str) -> Column:
    return (vuln_id == wanted) | F.array_contains(strings(aliases), wanted)


def severity(cvss: Column, kev: Column) -> Column:
    return F.when(F.coalesce(kev, F.lit(False)), "critical").when(cvss >= 9, "critical").when(cvss >= 7, "high").when(cvss >= 4, "medium").otherwise("low")


def portfolio_severity(cvss: Column) -> Column:
    return F.when(cvss >= 9, "Critical").when(cvss >= 7, "High").when(cvss >= 4, "Medium").otherwise("Low")


def scope_score(scopes: Column) -> Column:
    some = lambda *names: F.arrays_overlap(strings(scopes), F.array(*[F.lit(n) for n in names]))
    return F.when(some("required", "runtime"), 1.0).when(some("optional", "dev", "test"), 0.3).otherwise(0.6)


def scope_class(scope: Column) -> Column:
    """2 for scopes that ship, 1 for those that do not, 0 for others: the greatest of a set decides its ``scope_score``."""
    return F.when(scope.isin("required", "runtime"), 2).when(scope.isin("optional", "dev", "test"), 1).otherwise(0)


def scopes_of(greatest: Column) -> Column:
    """A set of scopes whose greatest ``scope_class`` is the one given."""
    return F.when(greatest == 2, F.array(F.lit("required"))).when(greatest == 1, F.array(F.lit("dev"))).otherwise(F.array().cast("array<string>"))


def reach_factor(verdict: Column) -> Column:
    return lookup(verdict, REACH_FACTOR, F.lit(0.5))


def risk_score(cvss: Column, epss: Column, kev: Column, scopes: Column, factor: Column, w: RiskWeights = RiskWeights()) -> Column:
    """0 to 100: weighted severity, exploitation (1 if known exploited), scope and reachability."""
    return weighted(cvss, epss, kev, scope_score(scopes), factor, w)


def weighted(cvss: Column, epss: Column, kev: Column, scope: Column, factor: Column, w: RiskWeights = RiskWeights()) -> Column:
    """``risk_score`` of a scope's score."""
    exploit = F.when(F.coalesce(kev, F.lit(False)), 1.0).otherwise(F.coalesce(epss, F.lit(0.0)))
    parts = F.lit(w.severity) * (F.coalesce(cvss, F.lit(0.0)) / 10) + F.lit(w.exploit) * exploit + F.lit(w.scope) * scope + F.lit(w.reach) * factor
    return F.round(parts * 100, 2)


def risk_band(score: Column) -> Column:
    return F.when(score >= 85, "Critical").when(score >= 70, "High").when(score >= 40, "Medium").otherwise("Low")


def risk_parts(cvss: Column, epss: Column, kev: Column, scopes: Column, factor: Column, w: RiskWeights = RiskWeights()) -> Column:
    """Array of (part, score, weight, contribution), to be inlined to four rows."""
    exploit = F.when(F.coalesce(kev, F.lit(False)), 1.0).otherwise(F.coalesce(epss, F.lit(0.0)))
    rows = [("severity", F.coalesce(cvss, F.lit(0.0)) / 10, w.severity), ("exploit", exploit, w.exploit), ("scope", scope_score(scopes), w.scope), ("reach", factor, w.reach)]
    return F.array(*[F.struct(F.lit(n).alias("part"), s.alias("score"), F.lit(x).alias("weight"), F.round(s * x * 100, 2).alias("contribution")) for n, s, x in rows])


def verdict_rank(verdict: Column, ranks: dict[str, int] = VERDICT_RANK) -> Column:
    return lookup(verdict, ranks, F.lit(-1))


def is_reachable(verdict: Column) -> Column:
    return F.coalesce(verdict.isin("confirmed_reachable", "likely_reachable"), F.lit(False))


def decision_tier(kev: Column, risk: Column, verdict: Column, has_fix: Column) -> Column:
    return (
        F.when(is_reachable(verdict), "fix_now")
        .when(F.coalesce(kev, F.lit(False)) & has_fix, "plan_remediation")
        .when(F.coalesce(kev, F.lit(False)), "mitigate")
        .when((risk >= 65) & has_fix, "plan_remediation")
        .when((risk >= 70) & ~has_fix, "mitigate")
        .otherwise("monitor")
    )


def tier_reason(tier: Column, kev: Column, verdict: Column, has_fix: Column) -> Column:
    known = F.when(F.coalesce(kev, F.lit(False)), " It is known to be exploited.").otherwise("")
    fix = F.when(has_fix, " A fixed version exists.").otherwise(" No fixed version is known.")
    main = lookup(tier, {"fix_now": "Vulnerable code is reachable.", "plan_remediation": "Risk is high enough to schedule an upgrade.", "mitigate": "Risk is high and needs a temporary control.", "accept": "The risk was accepted."}, F.lit("Risk is low enough to keep watching."))
    return F.concat(main, known, fix)


def valid_tier(tier: Column) -> Column:
    clean = F.lower(F.trim(tier))
    return F.when(clean.isin(*TIERS), clean).otherwise("monitor")


def valid_status(status: Column) -> Column:
    clean = F.lower(F.trim(status))
    return F.when(clean.isin(*STATUSES), clean).otherwise(lookup(clean, LEGACY_STATUS, F.lit("new")))


def confidence(verdict: Column, has_calls: Column, has_chain: Column, has_fix: Column) -> Column:
    return (
        F.when((verdict == "confirmed_reachable") & has_calls, "high")
        .when(is_reachable(verdict), F.when(has_chain, "high").otherwise("medium"))
        .when(has_chain | has_fix, "medium")
        .otherwise("low")
    )


def purl_type(purl: Column) -> Column:
    return F.when(F.startswith(purl, F.lit("pkg:")), F.split(F.substring(purl, 5, 1 << 30), "/")[0])


def ecosystem(purl: Column) -> Column:
    kind = purl_type(purl)
    return lookup(kind, ECOSYSTEMS, kind)


def package_manager(purl: Column) -> Column:
    kind = purl_type(purl)
    return lookup(kind, PACKAGE_MANAGERS, kind)


def component_identity(purl: Column, bom_ref: Column, name: Column, version: Column) -> Column:
    blank = lambda c: F.nullif(c, F.lit(""))
    named = F.concat(F.coalesce(name, F.lit("None")), F.lit("@"), F.coalesce(version, F.lit("None")))
    return F.coalesce(blank(purl), blank(bom_ref), named)


def days_ago(iso: Column, now: Column) -> Column:
    at = F.coalesce(F.try_to_timestamp(iso), F.try_to_timestamp(F.substring(iso, 1, 10)))
    return F.floor((F.unix_micros(now) - F.unix_micros(at)) / 86_400_000_000).cast("int")


def is_test_location(location: Column) -> Column:
    return F.lower(location).rlike(TEST_MARKS)


def evidence_scope(locations: Column) -> Column:
    some = lambda f: F.exists(strings(locations), f)
    test, live = some(is_test_location), some(lambda x: ~is_test_location(x))
    return F.when(test & live, "mixed").when(test, "test").when(live, "production").otherwise("none")


def functional_area(path: Column) -> Column:
    p = F.lower(F.coalesce(path, F.lit("")))
    return (
        F.when(p.rlike(TEST_MARKS), "test").when(p.rlike("admin"), "admin").when(p.rlike("api|route|controller"), "api")
        .when(p.rlike("front|ui/|view|component"), "frontend").when(p.rlike("src|server|back|lib"), "backend").otherwise("general")
    )


def pretty_area(area: Column) -> Column:
    return F.initcap(F.translate(area, "_-", "  "))


def snippet(text: Column, most: int = 200) -> Column:
    clean = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(clean) <= most, clean).otherwise(F.concat(F.rtrim(F.substring(clean, 1, most - 3)), F.lit("...")))


def public_poc(text: Column) -> Column:
    """Whether the text mentions a public exploit (null if blank)."""
    marks = "proof of concept|proof-of-concept|poc|exploit available|public exploit"
    return F.when(F.length(F.trim(text)) > 0, F.lower(text).rlike(marks))


def location_path(ref: Column) -> Column:
    return F.when(ref.rlike(r":-?\d+$"), F.regexp_extract(ref, r"^(.*):(-?\d+)$", 1)).otherwise(ref)


def location_line(ref: Column) -> Column:
    return F.when(ref.rlike(r":-?\d+$"), F.regexp_extract(ref, r"^(.*):(-?\d+)$", 2).try_cast("int"))


def advisory_url(vuln_id: Column) -> Column:
    return F.when(F.startswith(F.upper(vuln_id), F.lit("CVE-")), F.concat(F.lit("https://nvd.nist.gov/vuln/detail/"), F.upper(vuln_id)))


def version_key(version: Column) -> Column:
    """Comparable form of a version: numeric before other, then its numbers, release before pre-release, then text."""
    core = F.regexp_extract(version, r"^v?(\d+(?:\.\d+)*)", 1)
    numbers = F.transform(F.split(core, r"\."), lambda x: F.coalesce(x.try_cast("bigint"), F.lit(0).cast("bigint")))
    numeric = core != ""
    stable = numeric & (F.regexp_replace(version, r"^v?\d+(?:\.\d+)*", "") == "")
    return F.struct(numeric.alias("numeric"), F.when(numeric, numbers).otherwise(F.array().cast("array<bigint>")).alias("numbers"), stable.alias("stable"), F.lower(version).alias("folded"), version.alias("version"))


def preferred_version(versions: Column) -> Column:
    found = F.array_distinct(F.filter(strings(versions), lambda v: F.length(F.trim(v)) > 0))
    return F.when(F.size(found) <= 1, F.get(found, F.lit(0))).otherwise(F.array_max(F.transform(found, version_key))["version"])


def coarse_ecosystem(component_id: Column) -> Column:
    """npm, pypi, cargo or other, by the beginning of a component's id."""
    starts = lambda p: F.startswith(component_id, F.lit(p))
    return F.when(starts("pkg:npm"), "npm").when(starts("pkg:pypi"), "pypi").when(starts("pkg:cargo"), "cargo").otherwise("other")
