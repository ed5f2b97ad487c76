"""Answers known by hand: the predicate language, tiers, versions, deltas, clusters, depths."""

import pytest
from pyspark.sql import functions as F

from vulnloom.functions import exprs as X
from vulnloom.operators import cases, findings, paths, portfolio, reports, rules, upserts
from vulnloom.plans import predicates as P
from vulnloom.sources import advisories, repositories

ROWS = [
    ("alpha/repo", "critical", 9.8, 0.91, True, 92.4, "confirmed_reachable", True, 2, ["required", "runtime"], 1, ["CWE-79", "CWE-94"], "2026-01-10", 3),
    ("beta/repo", "high", 7.4, 0.15, False, 61.2, "likely_reachable", False, 0, ["optional"], 3, ["CWE-22"], "2024-05-01", 0),
    ("gamma/repo", "medium", 5.6, 0.02, False, 34.7, "no_sink_data", True, 1, ["dev"], 5, [], "2023-08-15", 0),
    ("null/repo", None, None, None, None, None, None, None, None, None, None, None, None, None),
]
SCHEMA = "project string, severity string, cvss double, epss double, kev boolean, risk_score double, reachability_verdict string, fix_available boolean, fix_versions_count int, all_scopes array<string>, closest_depth int, cwe array<string>, published string, call_locations_count int"


R, ALL, ANY, NOT = P.rule, P.all_of, P.any_of, P.negated


@pytest.mark.parametrize(
    ("form", "names"),
    [
        (ALL(R("severity", "in", ["critical", "high"]), R("fix_available", "=", True)), "a"),
        (ALL(NOT(R("project", "=", "alpha/repo")), ANY(R("kev", "=", True), R("risk_score", ">=", 60))), "b"),
        (ANY(R("all_scopes", "contains_any", ["required", "runtime"]), R("cwe", "contains", "CWE-22")), "ab"),
        (R("published", ">=", "2024-01-01"), "ab"),
        (ALL(R("cwe", "exists"), R("call_locations_count", ">=", 1)), "a"),
        (NOT(R("cvss", ">", 5)), "n"),
        (R("severity", "!=", "low"), "abgn"),
        (R("kev", "=", None), "n"),
        (R("all_scopes", "contains_all", []), "abgn"),
        (R("all_scopes", "contains_any", "DEV"), "g"),
        (R("cvss", "<", -1), ""),
        (ANY(R("severity", "starts_with", "MED"), R("project", "ends_with", "BETA/REPO")), "bg"),
        (ANY(R("nothing", "=", "x"), NOT(R("nothing", "exists"))), "abgn"),
        (NOT(NOT(R("severity", "=", "high"))), "b"),
        (ALL(), "abgn"),
        (ANY(), ""),
    ],
)
def test_predicates(spark, form, names):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert "".join(sorted(r.project[0] for r in P.where(df, form).collect())) == names


def test_forms():
    form = {"join": "and", "items": [{"field": "severity", "op": "in", "value": ["critical", "high"]}, {"field": "fix_available", "op": "=", "value": True}, {"field": "project", "op": "=", "value": 'a"b', "negate": True}]}
    text = P.text_of(form)
    assert text == 'severity in ("critical", "high") AND fix_available = true AND NOT (project = "a\\"b")'
    assert P.faults(form) == []
    assert P.faults({"items": [{"field": "kev", "op": ">"}, {"field": "x", "op": "="}, {"items": []}]}) == ["kev does not take '>'", "unknown field 'x'", "a group is empty"]


def test_tiers(spark):
    rows = [(True, 92.0, "confirmed_reachable", True, "fix_now"), (False, 70.0, "likely_reachable", False, "fix_now"), (False, 20.0, "confirmed_reachable", False, "fix_now"), (False, 67.0, "likely_unreachable", True, "plan_remediation"), (False, 80.0, "no_sink_data", False, "mitigate"), (False, 10.0, None, True, "monitor")]
    df = spark.createDataFrame(rows, "kev boolean, risk double, verdict string, fix boolean, want string")
    assert df.filter(X.decision_tier(F.col("kev"), F.col("risk"), F.col("verdict"), F.col("fix")) != F.col("want")).count() == 0
    one = spark.createDataFrame([("invalid-tier", "accepted_risk"), (None, None), ("MITIGATE", "planned")], "t string, s string")
    assert [tuple(r) for r in one.select(X.valid_tier(F.col("t")), X.valid_status(F.col("s"))).collect()] == [("monitor", "planned"), ("monitor", "new"), ("mitigate", "planned")]


def test_preferred_version(spark):
    df = spark.createDataFrame([(["0.31.0", "1.13.5", "1.13.5-rc1"],), (["main", "1.2"],), ([],), (None,), (["1.9.0", "1.10.0"],)], "v array<string>")
    assert [r[0] for r in df.select(X.preferred_version(F.col("v"))).collect()] == ["1.13.5", "1.2", None, None, "1.10.0"]


def test_call_names(spark):
    rows = [
        ("new Runner(...)", "Runner", False), ("$OBJ.fetch(...)", "fetch", False), ("a.b-c.d (x)", "d", False), ("evalAll(...)", "evalAll", False), ("new  a.b(x)", None, False), ("()", None, False),
        ("plain", None, False), (".$ANY(...)", None, True), ("GET /admin", None, True), ("GETS /admin", None, False), ("/x/y", None, True), ("an Endpoint here", None, True), ("endpoints", None, False),
        ("@routes.get(x)", None, True), (None, None, False), ("", None, False),
    ]
    df = spark.createDataFrame(rows, "p string, name string, weak boolean")
    assert [tuple(r) for r in df.select("p", rules.called_name(F.col("p")), rules.is_weak(F.col("p"))).collect()] == rows


def test_raw_rows(spark):
    rows = [("9.87654", "YES", " A  b\n c ", "2", {"id": "V", "cvss_score": "1"}), ("n/a", "0", "", "x", {"id": None, "cvss_score": "7"}), ("", None, "a POC", None, None)]
    df = spark.createDataFrame([(a, b, c, [], d, tuple(v.values()) if v else None) for a, b, c, d, v in rows], "cvss string, kev string, detail_summary string, fix_versions array<string>, depth string, v struct<id:string,cvss_score:string>")
    got = [(r.cvss, r.kev, r.impact_summary, r.depth, r.vulnerability, r.has_public_poc, r.project, r.fix_versions) for r in findings.evidence(df).collect()]
    assert got == [(9.8765, True, "A b c", 2, "V", False, None, []), (None, False, None, None, None, None, None, []), (None, None, "a POC", None, None, True, None, [])]
    assert df.select(findings.snippet(F.lit("abc  def ghi"), 8), findings.snippet(F.lit("abc def"), 7)).first() == ("abc d...", "abc def")


def test_class_rules(spark):
    """A method of a class is also looked for on what the class makes; of sinks with one rule id the first wins."""
    rows = [("CVE-1", "lib", "npm", "runIt", "Engine", None, "function_call", "x", 0.9, 2), ("CVE-1", "other", "npm", "runIt", None, None, "function_call", "x", 0.9, 5), ("CVE-2", "a-b", "pypi", "load", "Box", "Box.load(...)", "constructor", "x", 0.9, 1)]
    got = {(r.vuln_id, r.tier): r for r in rules.rules(spark.createDataFrame(rows, rules.SINKS)).collect()}
    assert len(got) == 4 and {r.package_name for r in got.values()} == {"lib", "a-b"}
    patterns = got["CVE-1", "direct"].patterns
    assert "import { Engine } from 'lib'; ... $OBJ = new Engine(...); ... $OBJ.runIt(...)" in patterns and "const { runIt: $FN } = require('lib'); ... $FN(...)" in patterns
    assert got["CVE-2", "direct"].patterns[:2] == ["Box.load(...)", "import a_b ... a_b.Box(...)"] and not any("$OBJ =" in p for p in got["CVE-2", "direct"].patterns)


def test_patches_and_hosts(spark):
    text = "From x\ndiff --git a b\n--- a\n+++ b\n@@ -1 +1 @@\n same\n-old\r\n+new"
    df = spark.createDataFrame([("1", text), ("2", "nothing"), ("3", None)], "id string, text string")
    assert {r.id: r.changed for r in advisories.patch_lines(df).collect()} == {"1": "diff --git a b\n@@ -1 +1 @@\n-old\n+new", "2": "", "3": None}
    assert advisories.patch_lines(df, 10).filter("id = '1'").first().changed == "diff --git\n... [cut]"
    urls = spark.createDataFrame([("https://Docs.example.org/x", True), ("ftp://docs.example.org/", False), ("https://example.org", False), (None, False), ("words", False)], "u string, ok boolean")
    assert urls.filter(advisories.allowed(F.col("u"), ["docs.example.org"]) != F.col("ok")).count() == 0


def test_languages(spark):
    rows = [("Go", "npm", None, "Go"), (" ", "PIP", None, "Python"), (None, "cargo", None, "Cargo"), (None, None, "pkg:maven/a", "Java"), (None, "", "x", "Unknown"), (None, None, None, "Unknown")]
    df = spark.createDataFrame(rows, "l string, m string, c string, want string")
    assert [r[0] for r in df.select(portfolio.language_of(F.col("l"), F.col("m"), F.col("c"))).collect()] == [r[3] for r in rows]


def test_inside_tree(spark):
    paths_ = [("a/b.py", True), ("../b", False), ("a/../b", False), ("/etc", False), ("C:\\x", False), ("a\\..\\b", False), ("a..b/c", True)]
    df = spark.createDataFrame(paths_, "p string, ok boolean")
    assert df.filter(repositories.inside_tree(F.col("p")) != F.col("ok")).count() == 0


def test_weights():
    with pytest.raises(ValueError):
        X.RiskWeights(0.5, 0.5, 0.5, 0.5)


SNAP = "project string, scan_id string, source_commit string, vuln_id string, component_id string, risk_score double, reachability_verdict string, fix_available boolean, decision_tier string, status string"


def test_delta(spark):
    row = lambda scan, v, c, risk, verdict, fix: ("p", scan, "c", v, c, risk, verdict, fix, "monitor", "new")
    old = spark.createDataFrame([row("1", "CVE-1", "a", 90.0, "confirmed_reachable", False), row("1", "CVE-2", "b", 40.0, "likely_unreachable", True)], SNAP)
    new = spark.createDataFrame([row("2", "CVE-1", "a", 65.0, "likely_reachable", True), row("2", "CVE-3", "c", 88.0, "confirmed_reachable", False)], SNAP)
    deltas = cases.delta(old, new)
    got = cases.delta_summary(deltas).first().asDict()
    assert got == {"project": "p", "baseline": 2, "current": 2, "added": 1, "resolved": 1, "risk_increased": 0, "risk_decreased": 1, "verdict_improved": 1, "verdict_regressed": 0, "fix_gained": 1, "fix_lost": 0, "unchanged": 0}
    assert cases.changed_rows(deltas).count() == 3


CASE = "project string, vuln_id string, component_id string, component_name string, component_version string, severity string, cvss double, risk_score double, kev boolean, reachability_verdict string, decision_tier string, status string, has_fix boolean, fix_versions array<string>, call_locations array<string>, evidence_scope string, closest_depth int"


def case(v, name="libxmljs2", tier="fix_now", verdict="confirmed_reachable", fixes=("0.33.0",), calls=("src/a.js:1",), status="new", scope="production", kev=False):
    return ("p", v, "npm/" + name, name, "1.0.0", "high", 8.0, 80.0, kev, verdict, tier, status, bool(fixes), list(fixes), list(calls), scope, 1)


def test_clusters(spark):
    df = spark.createDataFrame([case("CVE-1"), case("CVE-2", fixes=["0.35.0"], calls=["src/b.test.js:2", "src/c.js:1"][:1], scope="test")], CASE)
    df = df.withColumn("call_locations", F.when(F.col("vuln_id") == "CVE-2", F.array(F.lit("src/a.js:1"))).otherwise(F.col("call_locations")))
    r = reports.clusters(df).collect()
    assert len(r) == 1 and r[0].target_version == "0.35.0" and r[0].cases == 2 and r[0].production == 1 and r[0].test_only == 1 and r[0].vulns == "CVE-1|CVE-2"


def test_posture_and_areas(spark):
    df = spark.createDataFrame([case("CVE-1", kev=True), case("CVE-2", tier="monitor", status="verified_closed"), case("CVE-3", tier="plan_remediation", verdict="likely_reachable", status="planned")], CASE)
    got = reports.posture(df).first()
    assert (got.total, got.confirmed, got.likely, got.posture) == (2, 1, 1, "elevated")
    tests = spark.createDataFrame([case("CVE-1", calls=["tests/a.js:1"]), case("CVE-2", calls=["x/b.spec.js:1"])], CASE)
    areas = reports.affected_areas(tests).collect()
    assert [a.title for a in areas] == ["Repository-Wide Exposure"] and areas[0].cases == 2


def edges(spark, *pairs):
    return spark.createDataFrame([("s", a, b) for a, b in pairs], "scan_id string, src string, dst string")


@pytest.mark.parametrize(
    ("pairs", "want"),
    [
        ([("r", "a"), ("a", "b"), ("b", "c")], {"r": 0, "a": 1, "b": 2, "c": 3}),
        ([("r", "a"), ("r", "b"), ("a", "b")], {"r": 0, "a": 1, "b": 2}),
        ([("a", "b"), ("b", "c")], {"r": 0, "a": 1, "b": 2, "c": 3}),
        ([("r", "a"), ("x", "a"), ("a", "b")], {"r": 0, "x": 1, "a": 2, "b": 3}),
        ([("r", "a"), ("a", "b"), ("b", "a")], None),
        ([], {}),
    ],
)
def test_depths(spark, pairs, want):
    roots = spark.createDataFrame([("s", "r")], "scan_id string, root string")
    got = {r.node: r.depth for r in paths.depths(edges(spark, *pairs), roots).collect()}
    if want is None:  # a cycle whose only way in was pruned: nothing but the root, and it ends
        assert got["r"] == 0
    else:
        assert got == want


def test_shortest_chain(spark):
    df = edges(spark, ("r", "b"), ("r", "a"), ("a", "t"), ("b", "t"), ("t", "r"))
    one = spark.createDataFrame([("s", "r")], "scan_id string, root string")
    targets = spark.createDataFrame([("s", "t"), ("s", "r"), ("s", "zz")], "scan_id string, target string")
    got = {r.target: (r.hops, r.chain) for r in paths.shortest_chains(df, one, targets).collect()}
    assert got == {"t": (2, ["r", "a", "t"]), "r": (0, ["r"])}


def test_upserts(spark):
    schema = "k string, v string, seq int"
    old = spark.createDataFrame([("a", "1", 1), (None, "2", 2)], schema)
    new = spark.createDataFrame([("a", "3", 3), ("b", "4", 4), ("b", "5", 5), (None, "6", 6)], schema)
    pairs = lambda df: sorted((r.k or "-", r.v) for r in df.collect())
    assert pairs(upserts.last_wins(old, new, ["k"], "seq")) == [("-", "2"), ("-", "6"), ("a", "3"), ("b", "5")]
    assert pairs(upserts.first_wins(old, new, ["k"], "seq")) == [("-", "2"), ("-", "6"), ("a", "1"), ("b", "4")]
    merged = upserts.merge_fields(spark.createDataFrame([("a", "x", "y")], "k string, p string, q string"), spark.createDataFrame([("a", None, "z"), ("b", "w", None)], "k string, p string, q string"), ["k"])
    assert sorted(map(tuple, merged.collect())) == [("a", "x", "z"), ("b", "w", None)]


def test_rules(spark):
    df = spark.createDataFrame(
        [("CVE-1", "@s/p/x", "npm", "merge_all", None, None, "function_call", "x", 0.9, 1), ("CVE-2", "py-yaml", "pypi", None, None, "yaml.load_it(...)", "function_call", "x", 0.9, 2), ("CVE-3", "q", "npm", "get", None, "get(...)", "function_call", "x", 0.9, 3), ("CVE-4", "w", "npm", None, None, "POST /x", "function_call", "x", 0.9, 4)],
        rules.SINKS,
    )
    got = {r.rule_id: r for r in rules.rules(df).collect()}
    assert set(got) == {"sbom-reach-cve_1-merge_all-direct", "sbom-reach-cve_1-merge_all-import", "sbom-reach-cve_2-load_it-direct", "sbom-reach-cve_2-load_it-import", "sbom-reach-cve_3-get-direct", "sbom-reach-cve_3-get-import", "sbom-reach-cve_4-any-import"}
    assert "const { merge_all } = require('@s/p'); ... merge_all(...)" in got["sbom-reach-cve_1-merge_all-direct"].patterns
    assert got["sbom-reach-cve_2-load_it-direct"].patterns[0] == "yaml.load_it(...)" and "import py_yaml" in got["sbom-reach-cve_2-load_it-import"].patterns
    assert "get(...)" not in got["sbom-reach-cve_3-get-direct"].patterns and got["sbom-reach-cve_3-get-direct"].quality == "generic" and got["sbom-reach-cve_4-any-import"].quality == "weak"


def test_texts(spark):
    from vulnloom.functions import texts

    df = spark.createDataFrame([("Impact: impact - bad **thing** here. And [more](http://x) `code` follows it",)], "t string")
    one = lambda c: df.select(c).first()[0]
    assert one(texts.plain(texts.without_label(F.col("t")))) == "bad thing here. And more code follows it"
    assert one(texts.compact(F.lit("First part is here. Second part is long"), 30)) == "First part is here."
    assert one(texts.compact(F.lit("no sentence ends in this long text"), 20)) == "no sentence ends..."
    assert one(texts.section(F.lit("# A\nx\n## Impact\nyes it  is\n# B\nz"), "impact")) == "yes it is"
    assert one(texts.version_path(F.lit("1.0"), F.lit("2.0"))) == "1.0 to 2.0" and one(texts.version_path(F.lit("1"), F.lit(None).cast("string"))) == "no fixed version"
    assert one(texts.why_fix_now(F.lit("likely_reachable"), F.lit(True), F.lit(False))) == "the package is imported, it is exploited in the wild"


def test_repository_names(spark, tmp_path):
    from vulnloom.sources import advisories, repositories

    (tmp_path / "links.txt").write_text("# c\n\nhttps://github.com/a/b.git\norg/name@abc\n git@host.org:x/y/ \nnot a link\nhttps://h.org/p.q/r-s\n")
    assert [r.full_name for r in repositories.read_links(spark, str(tmp_path / "links.txt")).collect()] == ["a/b", "org/name", "x/y", "p.q/r-s"]


def test_deep_graphs_fold(spark):
    """Depths of a chain deeper than several folds, beside a short cut and a cycle."""
    n = 2 * paths.FOLD + 5
    edges = [("s", f"n{k}", f"n{k + 1}") for k in range(n)] + [("s", "n3", "n9"), ("s", f"n{n}", "n5"), ("t", "a", "b")]
    got = {(r.scan_id, r.node): r.depth for r in paths.depths(spark.createDataFrame(edges, "scan_id string, src string, dst string"), spark.createDataFrame([("s", "n0"), ("t", "a")], "scan_id string, root string")).collect()}
    assert got == {("s", f"n{k}"): k if k < 9 else k - 5 for k in range(n + 1)} | {("t", "a"): 0, ("t", "b"): 1}


def test_states_of_odd_keys(spark):
    """Texts whose parts hold bars, blank parts, several states of a key, and cases that differ in a blank component."""
    cases = spark.createDataFrame([("a|b", "v", "c"), ("a", "b|v", "c"), ("a", "b", None), ("a", "b", ""), ("", "w", "c"), (None, "w", None), ("q", None, "c"), ("q", "w", "d"), ("z", "y", "")], "project string, vuln_id string, component_id string")
    given = [
        (None, None, None, "a|b|v|c", "open", "1"), (None, None, None, "a|b|", "blank", "1"), (None, None, None, "a|b", "short", "1"), (None, "w", "", None, "wide", "1"), ("", "w", "c", None, "part", "2"), ("", "w", "c", None, "older", "1"),
        ("q", "w", None, None, None, "1"), (None, None, "c", None, "none", "1"), (None, None, None, "|w|c", "none", "1"), (None, None, None, "q||c", "none", "1"), ("z", "y", "", "z|y|", "own", "1"),
    ]
    states = spark.createDataFrame([(*r, "me") for r in given], "project string, vuln_id string, component_id string, state_key string, status string, updated_at string, owner string")
    for partitions in (None, 5):
        got = {(r.project, r.vuln_id, r.component_id): (r.status, r.owner) for r in findings.resolve_states(cases, states, partitions).collect()}
        assert got == {
            ("a|b", "v", "c"): ("open", "me"), ("a", "b|v", "c"): ("open", "me"), ("a", "b", None): ("blank", "me"), ("a", "b", ""): ("blank", "me"), ("", "w", "c"): ("part", "me"), (None, "w", None): ("wide", "me"),
            ("q", None, "c"): (None, None), ("q", "w", "d"): (None, "me"), ("z", "y", ""): ("own", "me"),
        }


def test_states_move_a_case_once(spark):
    """Between a case and its state lies one shuffle, by vulnerability."""
    from vulnloom.plans import catalog

    from tests.test_dealing import moved

    for name in ("state_resolution", "state_shapes"):
        df = catalog.queries()[name](spark, "/root/testdata/sf0.001")
        cases = df._jdf.queryExecution().executedPlan().toString()
        assert "posexplode" not in cases
        assert all("hashpartitioning(vuln_id" in x or "hashpartitioning(project" in x for x in moved(df))
