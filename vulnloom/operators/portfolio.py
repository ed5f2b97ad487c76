"""Roll-ups over the alerts of all projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vulnloom.functions import exprs as X


def _cents() -> Column:
    """Sum of scores in hundredths, as a whole number: exact, so nothing hangs on the order of rows."""
    return F.sum(F.round(F.col("risk_score") * 100).cast("long"))


def _total_risk() -> Column:
    return _cents() / F.lit(100.0)


def _mean_of(cents: Column, n: Column) -> Column:
    """Mean score to four digits, rounded half up in whole numbers."""
    return F.call_function("div", cents * 200 + n, n * 2) / F.lit(10000.0)


def _mean_risk() -> Column:
    return _mean_of(_cents(), F.count("risk_score"))


def by_project(alerts: DataFrame, n: int = 12) -> DataFrame:
    one = alerts.groupBy("project").agg(F.count("*").alias("alerts"), _total_risk().alias("total_risk"), _mean_risk().alias("avg_risk"))
    return one.orderBy(F.desc("total_risk"), "project").limit(n)


def severity_histogram(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy(X.portfolio_severity(F.col("cvss")).alias("severity")).agg(F.count("*").alias("alerts"))


def verdict_histogram(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("reachability_verdict").agg(F.count("*").alias("alerts"))


def by_vuln(alerts: DataFrame, n: int = 10) -> DataFrame:
    one = alerts.groupBy("vuln_id").agg(
        F.max("risk_score").alias("max_risk"), _total_risk().alias("total_risk"), F.count("*").alias("alerts"), F.count_distinct("project").alias("projects"),
        F.max("cvss").alias("max_cvss"), F.bool_or("kev").alias("kev"), F.count_if(X.is_reachable(F.col("reachability_verdict"))).alias("reachable"),
    )
    return one.orderBy(F.desc("max_risk"), F.desc("projects"), F.desc_nulls_last("max_cvss"), "vuln_id").limit(n)


def by_dependency(alerts: DataFrame, n: int = 10) -> DataFrame:
    rows = alerts.select("project", "risk_score", F.explode("all_components").alias("component"))
    one = rows.groupBy("component").agg(_total_risk().alias("risk"), F.count("*").alias("alerts"), F.count_distinct("project").alias("projects"))
    return one.orderBy(F.desc("risk"), F.desc("alerts"), "component").limit(n)


LANGUAGES = {"npm": "JavaScript", "pip": "Python", "pypi": "Python", "maven": "Java"}


def language_of(language: Column, manager: Column, component_id: Column) -> Column:
    """A project's language: as given, else by its package manager, else by the kind of a component, else Unknown."""
    kind = F.nullif(F.lower(F.regexp_extract(component_id, "^pkg:([^/]+)", 1)), F.lit(""))
    low = F.nullif(F.lower(F.trim(manager)), F.lit(""))
    named = lambda c: X.lookup(c, LANGUAGES, F.initcap(c))
    return F.coalesce(F.nullif(F.trim(language), F.lit("")), F.when(low.isNotNull(), named(low)), F.when(kind.isNotNull(), named(kind)), F.lit("Unknown"))


def heatmap(alerts: DataFrame, projects: DataFrame) -> DataFrame:
    """Alerts by language and severity; a missing language follows from the package manager, else from the components."""
    kinds = ("Critical", "High", "Medium", "Low")
    one = alerts.groupBy("project").agg(
        F.min(F.array_min(F.filter("all_component_ids", lambda x: F.startswith(x, F.lit("pkg:"))))).alias("_c"),
        *[F.count_if(X.portfolio_severity(F.col("cvss")) == s).alias(s.lower()) for s in kinds],
    )
    met = one.join(projects, "project").withColumn("language", language_of(F.col("language"), F.col("package_manager"), F.col("_c")))
    return met.groupBy("language").agg(*[F.sum(s.lower()).alias(s.lower()) for s in kinds])


def kpis(alerts: DataFrame) -> DataFrame:
    """Totals: projects are counted by their first alerts, vulnerabilities by the groups that the other totals are summed over."""
    nth = F.row_number().over(Window.partitionBy("project").orderBy("vuln_id"))
    one = alerts.withColumn("_n", nth).groupBy("vuln_id").agg(
        F.count("*").alias("alerts"), F.count_if((F.col("_n") == 1) & F.col("project").isNotNull()).alias("projects"), F.count_if("kev").alias("kev"),
        F.count_if(F.col("reachability_verdict") == "confirmed_reachable").alias("confirmed"), _cents().alias("cents"), F.count("risk_score").alias("scores"), F.max("risk_score").alias("max_risk"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c)
    return one.agg(
        total("alerts"), total("projects"), F.count("vuln_id").alias("vulns"), total("kev"), total("confirmed"), _mean_of(F.sum("cents"), F.sum("scores")).alias("avg_risk"), F.max("max_risk").alias("max_risk"),
    )


def manager_brief(alerts: DataFrame, n: int = 10) -> DataFrame:
    """Per project the first risk score in alert order, its vulnerabilities and those known to be exploited."""
    order = Window.partitionBy("project").orderBy(F.desc("risk_score"), "vuln_id")
    ranked = alerts.withColumn("k", F.row_number().over(order))
    one = ranked.groupBy("project").agg(F.max("risk_score").alias("risk"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= 10, F.struct("k", "vuln_id")))), lambda x: x["vuln_id"]), "|").alias("vulns"), F.count_if("kev").alias("kev"))
    return one.orderBy(F.desc("risk"), "project").limit(n)


TRIAGE_CAPS = {"fix_now": 30, "temp_mitigation": 30, "monitor": 20}


def triage_queue(alerts: DataFrame) -> DataFrame:
    """Each project's queue in three buckets, at most 30, 30 and 20 long."""
    severe, fix = F.coalesce("cvss", F.lit(0.0)) >= 7, F.size("fix_versions") > 0
    bucket = F.when((severe | F.coalesce("kev", F.lit(False))) & fix, "fix_now").when(severe & ~fix, "temp_mitigation").otherwise("monitor")
    order = Window.partitionBy("project", "bucket").orderBy(F.desc("risk_score"), "vuln_id")
    ranked = alerts.withColumn("bucket", bucket).withColumn("position", F.row_number().over(order))
    return ranked.filter(F.col("position") <= X.lookup(F.col("bucket"), TRIAGE_CAPS)).select("project", "bucket", "position", "vuln_id", "risk_score")


def completeness(alerts: DataFrame) -> DataFrame:
    """Fields that a record lacks."""
    lists = {"fix_versions", "cwe", "call_locations", "all_scopes"}
    names = ("cvss", "epss", "published", "fix_versions", "cwe", "call_locations", "all_scopes")
    missing = [F.when(F.coalesce(F.size(c) == 0 if c in lists else F.col(c).isNull(), F.lit(True)), F.lit(c)) for c in names]
    return alerts.select("project", "vuln_id", F.array_join(F.array_compact(F.array(*missing)), "|").alias("missing"))


def stakeholder_inputs(alerts: DataFrame, named: DataFrame | None = None, components: int = 20, vulns: int = 10) -> DataFrame:
    """Per project what a report for stakeholders starts from: counts, verdicts, the commonest components, the first alerts.

    ``named`` (project, component, n) counts alerts by component, where ``alerts`` have no lists of components.  Alerts are
    read once: first ones are numbered, the others counted together.
    """
    if named is None:
        named = alerts.select("project", F.explode("all_components").alias("component")).filter(F.trim("component") != "").groupBy("project", "component").agg(F.count("*").alias("n"))
    has_fix = F.col("has_fix") if "has_fix" in alerts.columns else F.size("fix_versions") > 0
    order = [F.desc_nulls_last("risk_score"), F.asc_nulls_last("closest_depth"), F.desc_nulls_last("published"), "vuln_id"]
    verdicts = {v: F.coalesce("reachability_verdict", F.lit("no_sink_data")) == v for v in X.VERDICT_RANK}
    counted = {"critical_high": F.col("severity").isin("critical", "high"), "kev": F.col("kev"), "with_fix": has_fix, **verdicts}
    placed = alerts.withColumn("_k", F.row_number().over(Window.partitionBy("project").orderBy(*order)))
    shown = lambda c: F.when(F.col("_k") <= vulns, F.col(c)).alias(f"_s{c}")
    few = placed.groupBy("project", shown("_k"), shown("vuln_id")).agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in counted.items()])
    texts = lambda rows: F.array_join(F.transform(F.array_sort(rows), lambda x: x["s"]), "|")
    first = F.collect_list(F.when(F.col("_s_k").isNotNull(), F.struct(F.col("_s_k").alias("k"), F.col("_svuln_id").alias("s"))))
    counts = few.groupBy("project").agg(*[F.sum(c).alias(c) for c in ("total", *counted)], texts(first).alias("vulns"))
    ranked = named.withColumn("k", F.row_number().over(Window.partitionBy("project").orderBy(F.desc("n"), "component"))).filter(F.col("k") <= components)
    top = ranked.groupBy("project").agg(texts(F.collect_list(F.struct("k", F.concat_ws(":", "component", F.col("n").cast("string")).alias("s")))).alias("components"))
    return counts.join(top, "project", "left")
