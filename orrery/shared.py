"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir with its file system; where that is unset a temporary folder of a local session, and an error on
    a cluster, whose machines would not see each other's folders."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = _local.setdefault(context.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="orrery-")
        _local[context.applicationId] = where
    at, fs = _hadoop(spark, where)
    return fs.makeQualified(at).toString().rstrip("/")


def fresh(spark: SparkSession, name: str = "t") -> str:
    """A new folder below the shared one, which goes when the driver's JVM ends: lazy results may read it until then."""
    path = f"{folder(spark)}/orrery-{name}-{uuid.uuid4().hex}"
    at, fs = _hadoop(spark, path)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def saved(df: DataFrame, name: str = "t") -> DataFrame:
    """df written and read again: its rows are what they were on the first run, whatever is lost or repeated later."""
    path = f"{fresh(df.sparkSession, name)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
