"""Texts of reports as column functions: cleaning, labels and the sentences that follow from a case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vulnloom.functions import exprs as X

#: Wording by audience: (audience, kind, key) -> text.
VOCABULARY = {
    ("management", "reachability"): {"confirmed_reachable": "Used by our code", "likely_reachable": "Probably used by our code", "uncertain": "Use is unclear", "likely_unreachable": "Probably not used", "no_sink_data": "Not assessed"},
    ("developer", "reachability"): {"confirmed_reachable": "Confirmed call path", "likely_reachable": "Package imported, call not seen", "uncertain": "Inconclusive", "likely_unreachable": "No import or call found", "no_sink_data": "No sink known"},
    ("management", "tier"): {"fix_now": "Act now", "plan_remediation": "Schedule", "mitigate": "Contain", "monitor": "Watch", "accept": "Accepted"},
    ("developer", "tier"): {"fix_now": "Fix now", "plan_remediation": "Plan upgrade", "mitigate": "Mitigate", "monitor": "Monitor", "accept": "Accept"},
    ("management", "scope"): {"production": "Live product", "test": "Tests only", "mixed": "Live product and tests", "none": "Unknown"},
    ("developer", "scope"): {"production": "Production code", "test": "Test code", "mixed": "Production and test code", "none": "No location"},
}


def worded(key: Column, audience: str, kind: str) -> Column:
    return X.lookup(key, VOCABULARY[audience, kind], F.initcap(F.translate(key, "_-", "  ")))


def without_label(text: Column) -> Column:
    """The text without a repeated label in front ('Impact: Impact: x' and 'Impact: x' give 'x')."""
    return F.trim(F.regexp_replace(text, r"(?i)^\s*(?:(?:impact|summary|action|risk|note|status|next step)\s*[:\-]\s*)+", ""))


def plain(markdown: Column) -> Column:
    """Markdown without its marks, on one line."""
    text = F.regexp_replace(markdown, r"(?m)^\s{0,3}(?:#{1,6}\s+|[-*+]\s+|\d+\.\s+|>\s?)", "")
    text = F.regexp_replace(text, r"\[([^\]]*)\]\([^)]*\)", "$1")
    text = F.regexp_replace(text, r"(\*\*|__|`|\*)(.+?)\1", "$2")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def compact(text: Column, most: int = 160) -> Column:
    """At most ``most`` characters: cut after the last full sentence if one fits, else after a word."""
    clean = F.trim(F.regexp_replace(text, r"\s+", " "))
    head = F.substring(clean, 1, most)
    sentence = F.regexp_extract(head, r"^(.*[.!?])(?:\s|$)", 1)
    word = F.concat(F.regexp_replace(F.substring(clean, 1, most - 3), r"\s+\S*$", ""), F.lit("..."))
    return F.when(F.length(clean) <= most, clean).when(F.length(sentence) >= most // 3, sentence).otherwise(word)


def section(text: Column, heading: str, most: int = 300) -> Column:
    """What follows a heading, to the next one."""
    found = F.regexp_extract(text, rf"(?is)^.*?#+\s*{heading}\s*\n(.*?)(?=\n#|$)", 1)
    return X.snippet(F.nullif(F.trim(found), F.lit("")), most)


def version_path(current: Column, target: Column) -> Column:
    return F.when(target.isNull(), F.lit("no fixed version")).when(current.isNull() | (current == ""), F.concat(F.lit("to "), target)).otherwise(F.concat(current, F.lit(" to "), target))


def component_shown(names: Column, versions: Column) -> Column:
    """One component with its version, one with several versions, or how many there are."""
    return (
        F.when(F.size(names) == 0, "unknown")
        .when((F.size(names) == 1) & (F.size(versions) == 1), F.concat_ws("@", names[0], versions[0]))
        .when(F.size(names) == 1, F.concat(names[0], F.lit(" ("), F.size(versions).cast("string"), F.lit(" versions)")))
        .otherwise(F.concat(F.size(names).cast("string"), F.lit(" components")))
    )


def why_fix_now(verdict: Column, kev: Column, has_fix: Column) -> Column:
    parts = F.array_compact(F.array(F.when(verdict == "confirmed_reachable", F.lit("a call path is confirmed")), F.when(verdict == "likely_reachable", F.lit("the package is imported")), F.when(F.coalesce(kev, F.lit(False)), F.lit("it is exploited in the wild")), F.when(has_fix, F.lit("a fix is available"))))
    return F.array_join(parts, ", ")


def why_not_now(verdict: Column, has_fix: Column) -> Column:
    return F.when(X.is_reachable(verdict), F.lit(None).cast("string")).when(verdict == "no_sink_data", "nothing is known of a call path").when(~has_fix, "no fixed version is known").otherwise("no call path was found")


def next_action(tier: Column, target: Column) -> Column:
    return F.when((tier.isin("fix_now", "plan_remediation")) & target.isNotNull(), F.concat(F.lit("Upgrade to "), target)).when(tier == "fix_now", "Remove or isolate the call").when(tier == "mitigate", "Add a compensating control").otherwise("Review at the next scan")
