"""Documents of projects that are passed over leave a batch before whole documents are sorted."""

from vulnloom.sources import sbom
from vulnloom.streaming import landing


def test_ledger_is_asked_first(spark):
    docs = spark.createDataFrame([], f"{sbom.SCHEMA}, project string")
    made = [r'{"serialNumber": "%s", "metadata": {"timestamp": "2024-01-01"}, "components": [{"bom-ref": "a"}], "project": "%s"}' % r for r in (("s2", "p"), ("s1", "p"), ("s3", "q"), ("s4", "r"))]
    docs = spark.read.schema(docs.schema).json(spark.sparkContext.parallelize(made))
    ledger = spark.createDataFrame([("q", 0), ("r", 1)], "repo_key string, batch long")
    found = landing.unseen(docs, ledger, 1)
    assert sorted((r.project, r.serialNumber) for r in found.collect()) == [("p", "s1"), ("r", "s4")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Join LeftAnti")
