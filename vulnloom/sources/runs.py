"""Runs (of reports, scans, verdicts) written so that a reader sees all of a write or nothing of it.

A write goes to a folder of its own, ``data/version=V/run_id=R``; it counts once its commit stands in ``log`` as one small
file, created only if that number is still free (a writer that comes second takes the next).  The rows of a run are those of
its last committed version; clearing is a commit that makes all earlier ones count no more.  Tasks that fail or run twice,
and writers that die, leave folders that no commit names: readers pass over them and ``vacuum`` deletes them.

Readers meet data and commits in an equi-join on the partition columns, so what no longer counts is pruned by partition and
no list of files goes through the driver.

Defined cases: rows without a run id are refused; a write without rows replaces no run; a store without commits is empty.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN, VERSION = "run_id", "version"


@dataclass(frozen=True)
class RunStore:
    spark: SparkSession
    path: str
    #: Columns of the rows, without the run's id.
    schema: str

    def _fs(self, path: str):  # noqa: ANN202
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        where, fs = self._fs(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def _commit(self, **said: object) -> int:
        """Writes the next commit; another writer's makes this one take the number after it."""
        taken = [int(n[:20]) for n in self._names("log") if n[:20].isdigit()]
        number = max(taken, default=-1) + 1
        while True:
            where, fs = self._fs(f"{self.path}/log/{number:020d}.json")
            if not fs.exists(where):
                try:
                    out = fs.create(where, False)
                except Exception:  # a py4j error of whatever file system: the number is taken, or nothing can be written
                    if not fs.exists(where):
                        raise
                else:
                    out.write(bytearray((json.dumps({"number": number, **said}) + "\n").encode()))
                    out.close()
                    return number
            number += 1

    def replace(self, rows: DataFrame) -> int:
        """Commits the rows of one or more runs (``run_id`` and the store's columns); each replaces what that run had."""
        version = uuid.uuid4().hex
        columns = [RUN, *self.spark.createDataFrame([], self.schema).columns]
        checked = F.when(F.col(RUN).isNotNull(), F.col(RUN)).otherwise(F.raise_error(F.lit("a run needs an id")).cast("string"))
        rows.select(*columns).withColumn(RUN, checked).write.partitionBy(RUN).parquet(f"{self.path}/data/{VERSION}={version}")
        return self._commit(version=version, clear=False)

    def clear(self) -> int:
        """Commits that nothing so far counts."""
        return self._commit(version="", clear=True)

    def commits(self) -> DataFrame:
        """(number, version) of the commits that count."""
        schema = "number long, version string, clear boolean"
        if not self._names("log"):
            return self.spark.createDataFrame([], "number long, version string")
        log = self.spark.read.schema(schema).json(f"{self.path}/log")
        cleared = log.agg(F.coalesce(F.max(F.when(F.col("clear"), F.col("number"))), F.lit(-1)).alias("cleared"))
        return log.crossJoin(F.broadcast(cleared)).filter("number > cleared AND NOT clear").select("number", VERSION)

    def read(self) -> DataFrame:
        """``run_id`` and the store's columns of all runs that count."""
        if not [n for n in self._names("data") if n.startswith(f"{VERSION}=")] or not self._names("log"):
            return self.spark.createDataFrame([], f"{RUN} string, {self.schema}")
        data = self.spark.read.schema(f"{self.schema}, {VERSION} string, {RUN} string").parquet(f"{self.path}/data")
        held = data.select(RUN, VERSION).distinct().join(self.commits(), VERSION)
        live = held.groupBy(RUN).agg(F.max_by(VERSION, "number").alias(VERSION))
        return data.join(live, [RUN, VERSION], "left_semi").select(RUN, *self.spark.createDataFrame([], self.schema).columns)

    def vacuum(self) -> list[str]:
        """Deletes the versions that no commit names, for when no writer is at work; returns them."""
        named = {json.loads(line)["version"] for n in self._names("log") for line in self._text(f"log/{n}").splitlines()}
        lost = [n for n in self._names("data") if n.startswith(f"{VERSION}=") and n.partition("=")[2] not in named]
        for name in lost:
            where, fs = self._fs(f"{self.path}/data/{name}")
            fs.delete(where, True)
        return lost

    def _text(self, name: str) -> str:
        where, fs = self._fs(f"{self.path}/{name}")
        stream = fs.open(where)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()


def export_verdicts(rows: DataFrame, path: str) -> DataFrame:
    """Writes verdicts as JSON lines, a folder per project, and returns how many there are of each."""
    rows.write.mode("overwrite").partitionBy("project").json(path)
    return rows.groupBy("project", "verdict").agg(F.count("*").alias("n"))
