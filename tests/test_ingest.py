"""Documents and advisories from JSON files to graph tables, in a batch and as a stream."""

import json

from vulnloom.sources import advisories, sbom
from vulnloom.streaming import landing


def document(serial="urn:1"):
    comp = lambda ref, name, loc=None: {"bom-ref": ref, "name": name, "version": "1", "purl": f"pkg:npm/{name}", "scope": "required", "evidence": {"occurrences": [{"location": loc}] if loc else []}}
    return {
        "serialNumber": serial,
        "metadata": {"timestamp": "2026-01-01T00:00:00Z", "component": {"bom-ref": "root", "name": "app"}, "properties": [{"name": "x", "value": "1"}, {"name": "git.branch", "value": "main"}]},
        "components": [comp("a", "alpha", "package.json#7"), comp("b", "beta", "#3"), comp("c", "gamma", "lock")],
        "dependencies": [{"ref": "root", "dependsOn": ["a", "b"]}, {"ref": "a", "dependsOn": ["x"]}, {"ref": "a", "dependsOn": ["b", "c"]}, {"ref": "", "dependsOn": ["c"]}],
    }


def test_graph_tables(spark, tmp_path):
    (tmp_path / "project=app").mkdir()
    (tmp_path / "project=app" / "one.json").write_text("﻿" + json.dumps(document()), encoding="utf-8")
    docs = sbom.read_sboms(spark, str(tmp_path))
    tables = sbom.graph_tables(docs)
    assert [tuple(r) for r in tables["sboms"].collect()] == [("urn:1", "app", "2026-01-01T00:00:00Z", "main")]
    assert {r.component_id: (r.depth, r.is_direct) for r in tables["has_component"].collect()} == {"pkg:npm/alpha": (1, True), "pkg:npm/beta": (2, False), "pkg:npm/gamma": (2, False)}
    assert {(r.src, r.dst) for r in tables["depends_on"].collect()} == {("pkg:npm/alpha", "pkg:npm/beta"), ("pkg:npm/alpha", "pkg:npm/gamma")}
    assert {(r.path, r.line) for r in tables["declared_in"].collect()} == {("package.json", 7), ("lock", None)}


def test_advisories(spark, tmp_path):
    record = {
        "id": "GHSA-1", "details": "text", "aliases": ["X-1", "CVE-2", "CVE-1"], "severity": [{"score": "V"}],
        "affected": [{"package": {"name": "lib", "ecosystem": "PyPI"}, "ranges": [{"events": [{"fixed": "1.2"}, {"last_affected": "1.0"}, {"fixed": "1.2"}]}], "ecosystem_specific": {"affected_functions": ["lib.mod:run_it"]}}],
        "references": [{"type": "FIX", "url": f"https://h/{k}"} for k in range(5)] + [{"type": "WEB", "url": "https://h/w"}, {"type": "REPORT", "url": "http://h/r"}],
    }
    (tmp_path / "v.json").write_text(json.dumps(record))
    records = advisories.read(spark, str(tmp_path / "v.json"))
    row = advisories.details(records).first()
    assert (row.detail_summary, row.fix_versions, row.cve_ids, row.severity_vectors) == ("text", ["1.0", "1.2"], ["CVE-2", "CVE-1"], ["V"])
    metric = lambda s: [{"cvssData": {"baseScore": s, "baseSeverity": "HIGH"}}]
    lines = [{"cve_id": "CVE-2", "metrics": {"cvssMetricV2": metric(5.0), "cvssMetricV31": metric(9.0)}, "weaknesses": [{"description": [{"value": "CWE-9"}, {"value": "noinfo"}]}]}, {"cve_id": "CVE-1", "metrics": {"cvssMetricV40": metric(7.5)}, "weaknesses": []}]
    (tmp_path / "n.json").write_text("\n".join(map(json.dumps, lines)))
    nvd = spark.read.schema(advisories.NVD).json(str(tmp_path / "n.json"))
    epss = spark.createDataFrame([("CVE-1", 0.2, 0.5)], "cve_id string, epss double, percentile double")
    kev = spark.createDataFrame([("CVE-2",)], "cve_id string")
    got = advisories.enrich(advisories.details(records), nvd, epss, kev).first()
    assert (got.epss, got.kev, got.cvss_score, got.cwe) == (0.2, True, 7.5, ["CWE-9"])
    assert advisories.listed_functions(records).first().function_name == "run_it"
    assert [r.url for r in advisories.followed_references(records).collect()] == [f"https://h/{k}" for k in range(3)]
    assert advisories.package_name(records).first().package_name == "lib"


def test_sink_files(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([{"vuln_id": "CVE-1", "package": "p", "ecosystem": "crates.io", "sinks": [{"function_name": "f"}, {"function_name": "g", "confidence": 0.9, "sink_type": "constructor"}]}]))
    rows = advisories.sink_rows(advisories.read(spark, str(tmp_path / "s.json"), advisories.SINK_FILE)).collect()
    assert [(r.function_name, r.ecosystem, r.sink_type, r.vuln_type, r.confidence) for r in rows] == [("f", "cargo", "function_call", "Unknown", 0.7), ("g", "cargo", "constructor", "Unknown", 0.9)]


def test_landing(spark, tmp_path):
    src, out, check = (tmp_path / n for n in ("in", "out", "check"))
    (src / "project=app").mkdir(parents=True)
    (src / "project=app" / "one.json").write_text(json.dumps(document()))
    for k in (1, 2):
        landing.land(spark, str(src), str(out), str(check)).awaitTermination()
        assert landing.imported(spark, str(out), "sboms").count() == k
        assert {n: landing.imported(spark, str(out), n).count() for n in ("components", "has_component", "depends_on", "declared_in")} == {"components": 3 * k, "has_component": 3 * k, "depends_on": 2 * k, "declared_in": 2 * k}
        (src / "project=app" / "two.json").write_text(json.dumps(document("urn:2")))
