"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of sessions of one process that name none, by application.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where it is unset, a session of one process (tests) gets one temporary folder, kept here, as Spark takes no change of that
    setting; on a cluster that is an error, as executors would write where nobody else reads.  A name without a scheme is
    one of the default file system, and is given its scheme.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        application = spark.sparkContext.applicationId
        if application not in _OWN:
            _OWN[application] = "file://" + tempfile.mkdtemp(prefix="vulnloom-")
        return _OWN[application]
    return qualified(spark, found)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme that Spark reads it by."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        return path.rstrip("/")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString().rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back: lineage ends here."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Deletes the files behind a frame that ``stored`` returned, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
