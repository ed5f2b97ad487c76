"""Alerts in the fields that a score needs alone, made of numbers.

Advisories, components of a project and verdicts are numbered in the order of their names, so that the least name is the least
number, and alerts are aggregates of numbers, which a hash table holds as they are; nothing is sorted and no list is gathered.
A verdict on an advisory's own id counts where that is an alert's internal id, so advisories are told apart first
(project, vulnerability, advisory), then gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vulnloom.functions import exprs as X
from vulnloom.operators import alerts
from vulnloom.sources.testbed import Graph

#: Codes of verdicts: their rank and one, so that the strongest is the greatest; 0 is none.
CODES = {v: r + 1 for v, r in X.VERDICT_RANK.items()}


def numbered(g: Graph) -> bool:
    """Whether all verdicts are known ones, which have numbers."""
    return g.reachability.filter("verdict IS NOT NULL").filter(~F.col("verdict").isin(*CODES)).isEmpty()


def _advisories(g: Graph) -> DataFrame:
    """Advisories with ``_no`` and ``_canon``, numbers (from 1) of their own and canonical ids, and ``published`` as a number."""
    at = lambda c: F.dense_rank().over(Window.orderBy(F.col(c).asc_nulls_first()))
    named = g.vulns.select(F.col("id").alias("vuln"), X.canonical_vuln_id(F.col("id"), F.col("aliases")).alias("vuln_id"), "cvss", "epss", "kev", (F.size(X.strings(F.col("fix_versions"))) > 0).alias("has_fix"), "published")
    found = named.filter("vuln IS NOT NULL").withColumns({"_no": at("vuln"), "_canon": at("vuln_id"), "published": F.when(F.col("published").isNotNull(), at("published"))})
    return F.broadcast(found) if g.advisories <= alerts.MOST_ADVISORIES else found


def _edges(g: Graph, scans: DataFrame) -> DataFrame:
    """Components of ``scans`` (project, scan_id, side)."""
    return scans.select("project", "scan_id", "side").join(g.projects.select("project"), "project").join(g.has_component.select("scan_id", "component_id", "depth"), "scan_id")


def components(g: Graph, scans: DataFrame) -> DataFrame:
    """(project, ids): the components of a project in order; a component's number is its place there."""
    return _edges(g, scans).select("project", "component_id").repartition(g.partitions, "project").groupBy("project").agg(F.array_sort(F.collect_set("component_id")).alias("ids"))


def _parts(g: Graph, scans: DataFrame) -> DataFrame:
    """One row per component of a scan, dealt by project: its number, and the numbers of its advisories."""
    ids = _advisories(g).select("vuln", "_no", "_canon")
    known = g.affected_by.join(ids, "vuln").groupBy("component_id").agg(F.collect_set("_no").alias("_vulns"), F.collect_set("_canon").alias("_canons"))
    told = g.components.select("component_id", "name", X.scope_class(F.col("scope")).alias("scope")).join(known, "component_id")
    dealt = _edges(g, scans).join(told, "component_id", "left").repartition(g.partitions, "project")
    return dealt.withColumn("_c", F.dense_rank().over(Window.partitionBy("project").orderBy("component_id"))).filter("_vulns IS NOT NULL")


def named_components(g: Graph, scans: DataFrame) -> DataFrame:
    """(project, component, n): names of components with the number of alerts they are in."""
    rows = _parts(g, scans).filter("trim(name) <> ''").groupBy("project", F.col("name").alias("component")).agg(F.flatten(F.collect_list("_canons")).alias("_canons"))
    return rows.select("project", "component", F.size(F.array_distinct("_canons")).cast("long").alias("n"))


def _said(g: Graph) -> DataFrame:
    """(project, vuln_id, _no, _code): strongest verdicts, under the id they name (number 0), and under the canonical id of an advisory they name."""
    code = X.lookup(F.col("verdict"), CODES)
    merged = g.reachability.select("project", "vuln_id", code.alias("_code")).repartition(g.partitions, "project").groupBy("project", "vuln_id").agg(F.max("_code").alias("_code"))
    ids = _advisories(g).select(F.col("vuln").alias("vuln_id"), F.col("vuln_id").alias("_canonical"), "_no").distinct()
    ids = F.broadcast(ids) if g.advisories <= alerts.MOST_ADVISORIES else ids
    at = F.array_compact(F.array(F.struct("vuln_id", F.lit(0).alias("_no")), F.when(F.col("_canonical") != F.col("vuln_id"), F.struct(F.col("_canonical").alias("vuln_id"), "_no"))))
    return merged.join(ids, "vuln_id", "left").select("project", "_code", F.explode(at).alias("a")).select("project", "a.*", "_code")


def narrow_alerts(g: Graph, scans: DataFrame, sides: tuple[str, ...] = ("new",)) -> DataFrame:
    """(project, vuln_id) with, for each of ``sides``, a struct of the alert in that side's scan, null if it has none: ``component``
    (its first one's number), ``cvss``, ``epss``, ``kev``, ``has_fix``, ``closest_depth``, ``published`` (a number in the order of the
    days), ``reachability_verdict``, ``risk_score`` and ``severity``."""
    rows = _parts(g, scans).select("project", "side", "depth", "scope", "_c", F.explode("_vulns").alias("_no")).join(_advisories(g).drop("vuln", "_canon"), "_no")
    rows = rows.unionByName(_said(g), allowMissingColumns=True)
    of = lambda s, c: F.when(F.col("side") == s, c)
    facts = ("cvss", "epss", "kev", "has_fix", "published")
    one = rows.groupBy("project", "vuln_id", "_no").agg(
        *[F.max(c).alias(c) for c in facts if c != "published"], F.min("published").alias("published"), F.max("_code").alias("_code"),
        *[x for s in sides for x in (F.min(of(s, F.col("_c"))).alias(f"_c_{s}"), F.min(of(s, F.col("depth"))).alias(f"_d_{s}"), F.max(of(s, F.col("scope"))).alias(f"_s_{s}"))],
    )

    def gathered(s: str) -> list[Column]:
        there = lambda c: F.when(F.col(f"_c_{s}").isNotNull(), c)
        own = F.shiftleft(F.col("_no").cast("long"), 8) + F.coalesce("_code", F.lit(0))
        return [*[F.max(there(F.col(c))).alias(f"{s}_{c}") for c in facts if c != "published"], F.min(there(F.col("published"))).alias(f"{s}_published"), F.min(f"_c_{s}").alias(f"_c_{s}"), F.min(f"_d_{s}").alias(f"_d_{s}"), F.max(f"_s_{s}").alias(f"_s_{s}"), F.min(there(own)).alias(f"_b_{s}")]

    both = one.groupBy("project", "vuln_id").agg(F.max(F.when(F.col("_no") == 0, F.col("_code"))).alias("_a"), *[x for s in sides for x in gathered(s)])

    def alert(s: str) -> Column:
        cvss, epss, kev = (F.col(f"{s}_{c}") for c in ("cvss", "epss", "kev"))
        # By number alone, and the code by itself: of one large expression Java compiles nothing.
        code = F.col(f"_v_{s}")
        verdict = X.lookup(code, {c: v for v, c in CODES.items()}, F.lit("no_sink_data"))
        factor = X.lookup(code, {c: X.REACH_FACTOR[v] for v, c in CODES.items() if v in X.REACH_FACTOR}, F.lit(0.5))
        scope = F.when(F.col(f"_s_{s}") == 2, 1.0).when(F.col(f"_s_{s}") == 1, 0.3).otherwise(0.6)
        risk = X.weighted(cvss, epss, kev, scope, factor)
        made = {"component": F.col(f"_c_{s}"), "cvss": cvss, "epss": epss, "kev": kev, "has_fix": F.col(f"{s}_has_fix"), "closest_depth": F.col(f"_d_{s}"), "published": F.col(f"{s}_published"), "reachability_verdict": verdict, "risk_score": risk, "severity": X.severity(cvss, kev)}
        return F.when(F.col(f"_c_{s}").isNotNull(), F.struct(*[c.alias(n) for n, c in made.items()])).alias(s)

    anywhere = F.coalesce(*[F.col(f"_c_{s}") for s in sides]).isNotNull()
    codes = {f"_v_{s}": F.coalesce("_a", F.col(f"_b_{s}").bitwiseAND(255)) for s in sides}
    return both.filter(anywhere).withColumns(codes).select("project", "vuln_id", *[alert(s) for s in sides])


def two_scans(sboms: DataFrame) -> DataFrame:
    """The newest scan of each project (side new) and the one before it (side old)."""
    newest = Window.partitionBy("project").orderBy(F.col("generated_at").desc_nulls_first(), F.col("scan_id").desc())
    return sboms.withColumn("_n", F.row_number().over(newest)).filter("_n <= 2").withColumn("side", F.when(F.col("_n") == 1, "new").otherwise("old")).drop("_n")


def sides(g: Graph, scans: DataFrame) -> DataFrame:
    """Cases of both scans side by side, as ``cases.compared`` takes them, with ``new_kev``: one row where the first component is the same, else one of each side."""
    rows = narrow_alerts(g, scans, ("old", "new"))
    # A project has one list of components, which lies where its alerts do.
    met = rows.join(components(g, scans).hint("shuffle_hash"), "project")
    old, new = F.col("old"), F.col("new")
    alone = F.array_compact(F.array(F.when(old.isNotNull(), F.struct("old", F.when(old.isNull(), new).alias("new"))), F.when(new.isNotNull(), F.struct(F.when(new.isNull(), old).alias("old"), "new"))))
    pairs = F.explode(F.when(F.coalesce(old["component"] == new["component"], F.lit(False)), F.array(F.struct("old", "new"))).otherwise(alone)).alias("_p")
    met = met.select("project", "vuln_id", "ids", pairs)

    def side(n: str) -> list[Column]:
        at = F.col(f"_p.{n}")
        fields = {
            "project": F.col("project"), "vuln_id": F.col("vuln_id"), "component_id": F.get(F.col("ids"), at["component"] - 1), "risk_score": at["risk_score"], "reachability_verdict": at["reachability_verdict"],
            "fix_available": at["has_fix"], "status": F.lit("new"), "kev": at["kev"],
        }
        return [F.when(at.isNotNull(), c).alias(f"{n}_{name}") for name, c in fields.items()]

    return met.select(*side("old"), *side("new"))
