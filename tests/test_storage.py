"""Tables merged by key, committed runs, landed documents: what a write touches, what a reader sees, what a repeat changes."""

import glob
import json
import os
import random
from types import SimpleNamespace

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from vulnloom.operators import upserts
from vulnloom.sources import keyed, runs, shared
from vulnloom.streaming import landing

SCHEMA = "a string, b long, x string, y long"


def files(path):
    return {os.path.relpath(f, path): os.path.getmtime(f) for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


@pytest.fixture
def table(spark, tmp_path):
    rows = [(f"k{i % 40}", i, f"old{i}", i) for i in range(200)] + [(None, 1, "nameless", 0)]
    return keyed.create(spark.createDataFrame(rows, SCHEMA), ["a", "b"], slices=16, buckets=4, path=str(tmp_path / "t"))


def test_upsert_touches_its_slices(spark, table):
    before = files(table.path)
    new = spark.createDataFrame([("k3", 3, "new", None), ("k0", 999, "more", 5)], SCHEMA)
    touched = keyed.upsert(table, new, keyed.keeping)
    after = files(table.path)
    of = lambda f: int(f.split("/")[0].partition("=")[2])
    assert 1 <= len(touched) <= 2 and {of(f) for f in set(before) ^ set(after)} == set(touched)
    assert {f: t for f, t in before.items() if of(f) not in touched} == {f: t for f, t in after.items() if of(f) not in touched}
    got = {(r.a, r.b): (r.x, r.y) for r in table.read(spark).collect()}
    assert len(got) == 202 and got["k3", 3] == ("new", 3) and got["k0", 999] == ("more", 5) and got["k4", 4] == ("old4", 4) and got[None, 1] == ("nameless", 0)
    assert keyed.upsert(table, new.limit(0)) == [] and files(table.path) == after


def test_old_side_is_not_shuffled(spark, table):
    new = spark.createDataFrame([("k3", 3, "new", None)], SCHEMA)
    plan = keyed.merged(table, new, keyed.replacing, [3, 5])._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "Bucketed: true" in scan and "slice#" in scan and "IN (3,5)" in scan.replace(" ", "").replace("IN(", "IN (")
    # One exchange, of the new rows.
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan or "ShuffledHashJoin" in plan


def test_rules_of_fields(spark, table):
    new = spark.createDataFrame([("k1", 1, "late", None, 2), ("k1", 1, "early", 7, 1), (None, 1, "again", 1, 1), ("z", 1, None, 3, 1)], f"{SCHEMA}, s long")
    keyed.upsert(table, new, keyed.replacing, "s")
    got = sorted((tuple(r) for r in table.read(spark).filter("a IS NULL OR a = 'z' OR b = 1").collect()), key=repr)
    assert got == sorted([("k1", 1, "late", None), (None, 1, "nameless", 0), (None, 1, "again", 1), ("z", 1, None, 3)], key=repr)
    keyed.upsert(table, new.filter("a = 'k1' OR a = 'z'"), keyed.first_stays, "s")
    keyed.upsert(table, spark.createDataFrame([("z", 1, "given")], "a string, b long, x string"), keyed.first_stays)
    assert table.read(spark).filter("a = 'z'").first()[2] is None
    keyed.upsert(table, spark.createDataFrame([("z", 1, "given")], "a string, b long, x string"), keyed.keeping)
    assert tuple(table.read(spark).filter("a = 'z'").first()) == ("z", 1, "given", 3)


def test_random_upserts_and_attach(spark, table):
    rng, want = random.Random(7), {(f"k{i % 40}", i): (f"old{i}", i) for i in range(200)}
    for step in range(3):
        rows = {(f"k{i % 40}", i): (rng.choice([None, f"s{step}"]), rng.choice([None, step])) for i in rng.sample(range(260), 30)}
        keyed.upsert(table, spark.createDataFrame([(*k, *v) for k, v in rows.items()], SCHEMA), keyed.keeping)
        for k, (x, y) in rows.items():
            ox, oy = want.get(k, (None, None))
            want[k] = (ox if x is None else x, oy if y is None else y)
    other = keyed.attach(spark, table.path, SCHEMA, ["a", "b"], slices=16, buckets=4)
    for t in (table, other):
        assert {(r.a, r.b): (r.x, r.y) for r in t.read(spark).filter("a IS NOT NULL").collect()} == want


# --- runs ---------------------------------------------------------------------------------------------------------


def seen(store):
    return sorted(map(tuple, store.read().collect()))


def test_runs(spark, tmp_path):
    store = runs.RunStore(spark, f"file://{tmp_path}/s", "x long")
    made = lambda *rows: spark.createDataFrame(rows, "run_id string, x long")
    assert seen(store) == [] and store.read().columns == ["run_id", "x"]
    assert store.replace(made(("a", 1), ("a", 2), ("b", 3))) == 0
    assert store.replace(made(("a", 9)).withColumn("more", F.lit(1))) == 1
    assert seen(store) == [("a", 9), ("b", 3)]
    # A task that fails leaves what was there.
    with pytest.raises(PySparkException):
        store.replace(made(("b", 1), ("b", 2)).repartition(2).withColumn("x", F.when(F.col("x") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("x")).cast("long")))
    with pytest.raises(PySparkException):
        store.replace(made((None, 1)))
    assert seen(store) == [("a", 9), ("b", 3)]
    # So does a writer that dies before its commit; its folder is deleted when asked for.
    made(("b", 77)).write.partitionBy("run_id").parquet(f"{tmp_path}/s/data/version=dead")
    assert seen(store) == [("a", 9), ("b", 3)] and "version=dead" in store.vacuum() and seen(store) == [("a", 9), ("b", 3)]
    assert store.replace(made().limit(0)) == 2 and seen(store) == [("a", 9), ("b", 3)]
    store.clear()
    assert seen(store) == []
    store.replace(made(("b", 4)))
    assert seen(store) == [("b", 4)]


def test_second_writer_takes_the_next_number(spark, tmp_path, monkeypatch):
    one, two = (runs.RunStore(spark, f"file://{tmp_path}/s", "x long") for _ in range(2))
    one.replace(spark.createDataFrame([("a", 1)], "run_id string, x long"))
    monkeypatch.setattr(runs.RunStore, "_names", lambda self, folder: [])  # a listing from before the first commit
    assert two._commit(version="v", clear=False) == 1
    monkeypatch.undo()
    assert [json.loads(open(f).read())["number"] for f in sorted(glob.glob(f"{tmp_path}/s/log/*.json"))] == [0, 1]


def test_export(spark, tmp_path):
    rows = spark.createDataFrame([("p", "x", "v1"), ("p", "x", "v2"), ("q", "y", "v1")], "project string, verdict string, vuln_id string")
    assert sorted(map(tuple, runs.export_verdicts(rows, str(tmp_path / "o")).collect())) == [("p", "x", 2), ("q", "y", 1)]
    assert spark.read.json(str(tmp_path / "o")).count() == 3


# --- landing ------------------------------------------------------------------------------------------------------


def document(scan, when, n):
    parts = [{"bom-ref": f"r{k}", "name": f"n{k}", "version": "1", "evidence": {"occurrences": [{"location": f"p{k}#1"}]}} for k in range(n)]
    return {"serialNumber": scan, "metadata": {"timestamp": when, "component": {"bom-ref": "r0"}}, "components": parts, "dependencies": [{"ref": f"r{k}", "dependsOn": [f"r{k + 1}"]} for k in range(n - 1)]}


def put(folder, project, name, *args):
    (folder / f"project={project}").mkdir(parents=True, exist_ok=True)
    (folder / f"project={project}" / f"{name}.json").write_text(json.dumps(document(*args)))


def test_a_project_is_imported_once(spark, tmp_path):
    src, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    go = lambda: landing.land(spark, str(src), out, check, once=True).awaitTermination()
    scans = lambda: sorted(r.scan_id for r in landing.imported(spark, out, "sboms").collect())
    put(src, "p", "one", "s1", "2024-01-02", 3)
    put(src, "p", "two", "s0", "2024-01-01", 2)
    go()
    assert scans() == ["s0"]
    put(src, "p", "three", "s3", "2024-01-03", 3)
    put(src, "q", "one", "s4", "2024-01-03", 4)
    put(src, "r", "none", "s5", "2024-01-03", 0)
    go()  # a new query over the same checkpoint: a restart
    assert scans() == ["s0", "s4"] and sorted(r[0] for r in landing.ledger(spark, out).collect()) == ["p", "q"]
    # A batch that runs again decides as before.
    docs = spark.read.schema(landing.sbom.SCHEMA + ", project string").json(str(src)).filter("project <> 'r'")
    landing.write_batch(docs, 1, out, once=True)
    assert scans() == ["s0", "s4"]
    landing.clear(spark, out)
    assert scans() == [] and landing.ledger(spark, out).count() == 0
    landing.write_batch(docs, 2, out, once=True)
    assert scans() == ["s0", "s4"]


def test_totals_are_kept(spark, tmp_path):
    rng, out, last = random.Random(3), str(tmp_path / "out"), {}
    for number in range(3):
        batch = {rng.choice("pq") + str(rng.randint(0, 2)): rng.randint(1, 5) for _ in range(4)}
        last |= batch
        docs = [{"project": k[0], **document(k, "2024-01-01", n)} for k, n in batch.items()]
        landing.write_batch(spark.read.schema(landing.sbom.SCHEMA + ", project string").json(spark.sparkContext.parallelize([json.dumps(d) for d in docs])), number, out)
    want = {}
    for k, n in last.items():
        t = want.setdefault(k[0], [0, 0, 0, 0, 0])
        t[0] += 1
        t[1] += n
        t[2] += n - 1
        t[3] += n
        t[4] = max(t[4], n - 1)
    assert {r.project: [r.scans, r.components, r.dependencies, r.places, r.deepest or 0] for r in landing.totals(spark, out).collect()} == want


def test_import_list(spark):
    summary = spark.read.schema("results array<struct<vulnerability_file:string>>").json(spark.sparkContext.parallelize(['{"results": [{"vulnerability_file": "a.json"}, {"vulnerability_file": " "}, {}, {"vulnerability_file": "a.json"}, {"vulnerability_file": "b.json"}]}']))
    assert sorted(r[0] for r in landing.listed_files(summary).collect()) == ["a.json", "b.json"]
    rows = [("b.json", (None, "o/r", None, "r"), "1"), ("a.json", ("", "o/r", "u", "r"), "2"), ("c.json", ("m", "o/x", None, None), "3"), ("d.json", (None, None, " ", None), "4"), ("e.json", None, "5")]
    found = spark.createDataFrame(rows, "file string, repo struct<metadata_key:string,full_name:string,url:string,name:string>, sbom_file string")
    done = spark.createDataFrame([("m",)], "repo_key string")
    assert sorted(map(tuple, landing.import_list(found, done).collect())) == [("o/r", "a.json", "2")]
    assert upserts.not_imported(found.limit(0).withColumn("repo_key", F.lit("x")), done).count() == 0


def test_shared_folder(spark):
    plain = lambda master, found: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: found), sparkContext=SimpleNamespace(master=master, applicationId="app"), _jvm=spark._jvm, _jsc=spark._jsc)
    own = shared.shared_dir(plain("local[4]", None))
    assert own.startswith("file:///") and os.path.isdir(own[7:]) and shared.shared_dir(plain("local[4]", None)) == own
    with pytest.raises(ValueError):
        shared.shared_dir(plain("spark://h:7077", None))
    assert shared.shared_dir(plain("yarn", "/tmp/x/")) == "file:/tmp/x" and shared.shared_dir(plain("yarn", "s3a://b/x/")) == "s3a://b/x"
