"""Words of reports by audience, as a dimension that rows meet by their most telling key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnloom.functions import exprs as X

# Fixed values: (audience, kind) -> key -> (badge, sentence); a kind's fallback is the key that stands for all unknown ones.
WORDS = {
    ("stakeholder", "reachability"): {
        "confirmed_reachable": ("Direct evidence of use", "has direct code-level evidence of use in the application"),
        "likely_reachable": ("Signs of active use", "shows signs of use in relevant application paths"),
        "likely_unreachable": ("Not observed as directly used", "was not observed as directly used in the current scan"),
        "no_sink_data": ("Evidence still incomplete", "does not yet have enough sink-level evidence to judge practical exposure"),
        "unknown": ("Evidence pending", "still needs additional evidence before practical exposure can be judged"),
    },
    ("developer", "reachability"): {
        "confirmed_reachable": ("Direct call evidence", "has direct call evidence in project code"),
        "likely_reachable": ("Import/use evidence", "has import or usage evidence, but no direct vulnerable sink call was confirmed"),
        "likely_unreachable": ("No direct use observed", "was scanned successfully and no direct or import evidence supporting active use was found"),
        "no_sink_data": ("Sink evidence missing", "does not have sink-level evidence yet, so practical reachability cannot be concluded"),
        "unknown": ("Evidence pending", "still needs more evidence before practical reachability can be concluded"),
    },
    ("stakeholder", "tier"): {
        "fix_now": ("Act in current release", "needs action in the current release window"),
        "plan_remediation": ("Schedule next release", "should be scheduled into the next remediation window"),
        "mitigate": ("Mitigate and assign", "needs mitigation ownership or a compensating control decision"),
        "monitor": ("Keep under observation", "should stay under observation until stronger evidence or a release window is available"),
        "accept_risk": ("Track accepted risk", "is currently being tracked as accepted risk and should still be revisited at the next checkpoint"),
    },
    ("developer", "tier"): {
        "fix_now": ("Immediate queue", "belongs in the immediate remediation queue"),
        "plan_remediation": ("Planned upgrade", "belongs in the planned upgrade queue"),
        "mitigate": ("Mitigation / investigation", "needs mitigation work or deeper investigation before an upgrade can be closed out"),
        "monitor": ("Monitor", "should remain in the monitor queue pending stronger evidence or a later window"),
        "accept_risk": ("Accepted risk", "is being tracked as accepted risk and should still be revisited when evidence changes"),
    },
    ("stakeholder", "scope"): {"production": ("Production path evidence",), "test-only": ("Test-only evidence",), "mixed": ("Mixed production and test evidence",), "unknown": ("Scope not yet classified",)},
    ("developer", "scope"): {"production": ("Production code path",), "test-only": ("Test-only path",), "mixed": ("Mixed production and test paths",), "unknown": ("Unclassified scope",)},
    ("any", "urgency"): {"immediate": ("Immediate",), "next_window": ("Next release window",), "monitor": ("Monitor",)},
}
FALLBACK = {"reachability": "unknown", "tier": "monitor", "scope": "unknown", "urgency": "monitor"}
STYLES = ("badge", "sentence")
SCHEMA = "audience string, kind string, key string, style string, text string"


def entries() -> list[tuple[str, str, str, str, str]]:
    """(audience, kind, key, style, text) of every entry."""
    return [(a, kind, key, style, text) for (a, kind), keys in WORDS.items() for key, texts in keys.items() for style, text in zip(STYLES, texts, strict=False)]


def dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(entries(), SCHEMA)


def text_of(audience: str, kind: str, key: str, style: str = "badge") -> str:
    return WORDS[audience, kind][key][STYLES.index(style)]


def present(df: DataFrame, key: str, kind: str, audience: str, style: str, name: str, words: DataFrame | None = None) -> DataFrame:
    """``df`` with the text of column ``key`` as ``name``.

    Levels, the first that has an entry: the key for this audience and style, the key for any audience, the kind's fallback
    for this audience, the fallback for any.  Keys are compared without case and surrounding space; null and blank ones are
    unknown.  The dimension is reduced to the one kind and style, a few rows, before it is broadcast.  ``words`` (the columns
    of ``SCHEMA``) replaces the fixed dimension.
    """
    known = dimension(df.sparkSession) if words is None else words
    fit = known.filter((F.col("kind") == kind) & (F.col("style") == style) & F.col("audience").isin(audience, "any"))
    level = F.when(F.col("audience") == audience, 0).otherwise(1)
    best = fit.groupBy("key").agg(F.min_by("text", level).alias("_text"), F.min(level).alias("_level"))
    rest = best.filter(F.col("key") == FALLBACK.get(kind, "unknown")).agg(F.min_by("_text", "_level").alias("_rest"))
    met = df.withColumn("_key", F.lower(F.trim(F.coalesce(F.col(key).cast("string"), F.lit(""))))).join(F.broadcast(best.select(F.col("key").alias("_key"), "_text")), "_key", "left")
    return met.crossJoin(F.broadcast(rest)).withColumn(name, F.coalesce("_text", "_rest")).select(*[c for c in df.columns if c != name], name)


def legend(audience: str, kind: str) -> dict[str, str]:
    """What each key means, in sentences; an unknown one is no key of its own."""
    return {key: texts[1] for key, texts in WORDS[audience, kind].items() if key != "unknown" and len(texts) > 1}


def worded(key: Column, audience: str, kind: str, style: str = "badge") -> Column:
    """The same as a column, for places where a join would be in the way."""
    k = STYLES.index(style)
    words = {x: texts[k] for x, texts in WORDS[audience, kind].items() if len(texts) > k}
    return X.lookup(F.lower(F.trim(key)), words, F.lit(words[FALLBACK[kind]]))
