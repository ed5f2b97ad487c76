"""Sinks in texts of any shape, damaged ones, coverage; repositories that are ready; order of call evidence."""

from vulnloom.operators import reports
from vulnloom.sources import generated, repositories

TEXTS = [
    ("v1", "p", 'Sure:\n```json\n{"sinks": [{"function_name": "f", "confidence": 2, "evidence": "e"}, {"function_name": 7, "vulnerability_type": "RCE"}]}\n``` bye'),
    ("v2", "p", '[{"vuln_id": "x", "package": "q", "ecosystem": "PyPI", "sinks": [{"class_name": "C", "package_name": "own"}, {"call_pattern": "a(...)"}, null]}, {"function_name": "g"}, 3]'),
    ("v3", "p", "```\n[]\n```"),
    ("v4", "p", '{"sinks": {"function_name": "f"}}'),
    ("v5", "p", '{"other": 1}'),
    ("v6", "p", '{"sinks": [{"function_name": "f"}'),
    ("v7", "p", None),
    ("v8", "p", "``` ```"),
    ("v9", None, '"text"'),
]


def test_shapes(spark):
    texts = spark.createDataFrame(TEXTS, "vuln_id string, package_name string, text string")
    got = sorted((r.vuln_id, r.seq, r.package_name, r.ecosystem, r.function_name, r.class_name, r.call_pattern, r.vuln_type, r.confidence, r.note) for r in generated.sinks(texts).collect())
    assert got == [
        ("v1", 0, "p", "", "f", None, None, "", 1.0, "e"),
        ("v1", 1000, "p", "", "7", None, None, "RCE", 0.5, ""),
        ("v2", 0, "own", "PyPI", None, "C", None, "", 0.5, ""),
        ("v2", 1, "q", "PyPI", None, None, "a(...)", "", 0.5, ""),
        ("v2", 1000, "p", "", "g", None, None, "", 0.5, ""),
    ]
    rejected = sorted((r.vuln_id, r.reason) for r in generated.rejects(texts).collect())
    assert rejected == [("v2", "entry is no object"), ("v2", "entry is no object"), ("v4", "no list of sinks"), ("v5", "no list of sinks"), ("v6", "not JSON"), ("v7", "empty"), ("v8", "empty"), ("v9", "no list of sinks")]
    assert generated.sinks(texts.limit(0)).count() == generated.rejects(texts.limit(0)).count() == 0


def test_coverage(spark):
    pairs = spark.createDataFrame([("a", "v1"), ("a", "v1"), ("a", "v2"), ("b", "v2"), ("b", None)], "project string, vuln_id string")
    known = spark.createDataFrame([("v1",), ("v1",), ("v9",)], "vuln_id string")
    assert sorted(map(tuple, generated.coverage(pairs, known).collect())) == [("a", 2, 1, 1), ("b", 2, 0, 2)]


def test_ready(spark):
    rows = [("a/x", "TS ", "success"), ("a/y", "ts", "updated"), ("a/z", "py", "success"), (None, "ts", "success"), ("a/w", None, "success"), ("a/v", "js", "failed"), ("a/u", "js", None)]
    repos = spark.createDataFrame(rows, "full_name string, language string, clone_status string")
    done = spark.createDataFrame([("a/z",), (None,)], "full_name string")
    names = lambda df: sorted(r.full_name for r in df.collect())
    assert names(repositories.ready(repos, done, "nodejs")) == ["a/x"] and names(repositories.ready(repos, done, "nodejs", repositories.CLONED)) == ["a/x", "a/y"]
    assert names(repositories.ready(repos, done, "python")) == [] and names(repositories.ready(repos, done)) == ["a/w", "a/x"]


def test_evidence_order(spark):
    rows = [("p", "v3", "c", "confirmed_reachable", "test"), ("p", "v2", "c", "likely_reachable", "production"), ("p", "v1", "c", None, None), ("p", "v4", "c", "confirmed_reachable", "production")]
    cases = spark.createDataFrame(rows, "project string, vuln_id string, component_id string, reachability_verdict string, evidence_scope string")
    got = [r.vuln_id for r in reports.evidence_order()(cases).orderBy("rank").collect()]
    assert got == ["v4", "v3", "v2", "v1"] and reports.evidence_order(most=2)(cases).count() == 2
