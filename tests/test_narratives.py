"""Words by audience, sections and technical findings against known answers."""

from pyspark.sql import functions as F

from vulnloom.functions import vocabulary
from vulnloom.operators import narratives, reports

CASE = "project string, vuln_id string, component_id string, component_name string, component_version string, status string, decision_tier string, kev boolean, severity string, reachability_verdict string, risk_score double, cvss double, closest_depth int, has_fix boolean, fix_versions array<string>, call_locations array<string>, evidence_scope string, evidence_confidence string"


def cases(spark, *rows):
    return spark.createDataFrame(rows, CASE)


FIRST = ("p", "CVE-1", "c1", "Lib", "1.0", "new", "fix_now", True, "critical", "confirmed_reachable", 90.0, 9.1, 1, True, ["1.1"], ["src/api/a.py:3", " ", "tests/t.py:1", "b.py:2", "c.py:4"], "mixed", "high")
SECOND = ("p", "CVE-2", "c2", "Tool", None, "verified_closed", "monitor", False, "low", "no_sink_data", None, None, None, False, None, None, "none", None)


def test_levels_of_words(spark):
    rows = spark.createDataFrame([(1, " Confirmed_Reachable "), (2, "nonsense"), (3, None), (4, "")], "n int, key string")
    got = [r.text for r in vocabulary.present(rows, "key", "reachability", "developer", "badge", "text").orderBy("n").collect()]
    assert got == ["Direct call evidence", "Evidence pending", "Evidence pending", "Evidence pending"]
    # An own dimension: the audience's entry before that of any, the fallback last.
    own = spark.createDataFrame([("any", "tier", "a", "badge", "A"), ("x", "tier", "a", "badge", "XA"), ("any", "tier", "monitor", "badge", "M"), ("x", "tier", "b", "sentence", "no")], vocabulary.SCHEMA)
    keyed = spark.createDataFrame([("a",), ("b",)], "key string").withColumn("text", F.lit("old"))
    for audience, want in (("x", ["XA", "M"]), ("y", ["A", "M"])):
        shown = vocabulary.present(keyed, "key", "tier", audience, "badge", "text", own)
        assert shown.columns == ["key", "text"] and [r.text for r in shown.orderBy("key").collect()] == want
    assert vocabulary.present(rows.limit(0), "key", "tier", "developer", "badge", "text").count() == 0
    assert vocabulary.present(rows, "key", "tier", "developer", "badge", "text", own.limit(0)).filter("text IS NULL").count() == 4


def test_dimension_is_whole():
    found = vocabulary.entries()
    count = lambda kind: sum(e[1] == kind for e in found)
    assert (count("reachability"), count("tier"), count("scope"), count("urgency")) == (20, 20, 8, 3) and len({e[:4] for e in found}) == len(found)
    assert "unknown" not in vocabulary.legend("developer", "reachability") and len(vocabulary.legend("stakeholder", "tier")) == 5


def test_sections(spark):
    both = cases(spark, FIRST, SECOND)
    notes = spark.createDataFrame([("p", "No baseline yet.")], "project string, note string")
    got = {r.section: r.text for r in narratives.stakeholder_sections(both, notes).collect()}
    assert got["attention"].startswith("1 of 2 cases need action in this release. 1 has direct code-level evidence") and "lib: Act in current release. Code evidence" in got["attention"]
    assert got["importance"] == "1 open cases are critical or high, 1 known to be exploited. Evidence lies in Api (1). 1 direct and 0 transitive dependencies are open; 1 cases have a fix."
    assert got["decision"] == "Fix 1 reachable findings now; Review 1 open findings" and got["uncertainty"].endswith("No baseline yet.")
    got = {r.section: r.text for r in narratives.developer_sections(both).collect()}
    assert got["evidence"] == "First is CVE-1 on lib, which has direct call evidence in project code. Project code calls it." and got["next"] == "Upgrade lib."
    assert got["uncertainty"].startswith("1 cases lack evidence")
    closed = {r.section: r.text for r in narratives.stakeholder_sections(cases(spark, SECOND)).collect()}
    assert "No cluster is listed." in closed["attention"] and "the whole repository" in closed["importance"] and closed["decision"] == "Nothing is to be decided."
    assert narratives.developer_sections(both.limit(0)).count() == 0


def test_technical_findings(spark):
    one, two = narratives.technical_findings(cases(spark, FIRST, SECOND).withColumn("summary", F.lit(" s "))).orderBy("vuln_id").collect()
    assert one.key_call_evidence == ["src/api/a.py:3", "tests/t.py:1", "b.py:2"] and one.nvd_url.endswith("/CVE-1") and one.impact_summary == "s" and one.why_this_tier == "Known to be exploited, and in use."
    assert two.call_locations == [] and two.why_this_tier == "Weak evidence or little urgency: verdict no_sink_data, risk 0.00, confidence medium."
    assert narratives.technical_findings(cases(spark, SECOND)).first().impact_summary == "No impact summary is known."
    assert set(reports.REPORT_COLUMNS) <= set(cases(spark).columns)
