"""What the training-data operators share: the shared folder, written tables and Arrow row mapping."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one Arrow batch takes to a Python worker, and rows in it.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 2000

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one in local mode, as in tests; an error on a
    cluster, whose machines would not see each other's folders."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="orrery-")
        _delete_at_exit(spark, _local[app])
    return _local[app]


def _hadoop_path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, as tasks need it that don't go through Spark's readers."""
    at, fs = _hadoop_path(spark, path)
    return fs.makeQualified(at).toString()


def delete(spark: SparkSession, path: str) -> None:
    at, fs = _hadoop_path(spark, path)
    fs.delete(at, True)


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    """The file system deletes the folder when the driver's JVM ends: lazy results may read its tables until then."""
    at, fs = _hadoop_path(spark, path)
    fs.mkdirs(at)
    fs.deleteOnExit(at)


class Workspace:
    """Tables of one run in the shared folder. A written table cuts lineage and survives lost executors. What a run doesn't
    drop itself goes when the driver ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/orrery-{uuid.uuid4().hex}"
        self._n = 0
        _delete_at_exit(spark, self.root)

    def save(self, df: DataFrame, name: str = "t", partition_by: str | None = None, options: dict[str, str] | None = None) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        writer = df.write.partitionBy(partition_by) if partition_by else df.write
        writer.options(**(options or {})).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._orrery_path = path
        return out

    def save_bucketed(self, df: DataFrame, keys: list[str], name: str = "t", aligned: bool = False) -> DataFrame:
        """A table bucketed and sorted by keys, one file a bucket and as many buckets as shuffle partitions: two of them
        are merge-joined on the keys without an exchange or a sort. aligned: df comes from such joins, bucket by bucket."""
        self._n += 1
        spark = self.spark
        # a bucketed scan tells its order only under this setting
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        path, table = f"{self.root}/{self._n:03d}-{name}", f"orrery_{name}_{uuid.uuid4().hex}"
        rows = df if aligned else df.repartition(buckets, *keys)
        rows.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).format("parquet").saveAsTable(table)
        out = spark.table(table)
        out._orrery_path, out._orrery_table = path, table
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Deletes tables that nothing reads any more."""
        for t in tables:
            if getattr(t, "_orrery_table", None):
                self.spark.sql(f"DROP TABLE IF EXISTS {t._orrery_table}")
            if getattr(t, "_orrery_path", None):
                delete(self.spark, t._orrery_path)


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small, so that long texts don't fill a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_rows(df: DataFrame, make: Callable[[], Callable[[list[list]], Iterator[list[list]]]], schema: str) -> DataFrame:
    """mapInArrow over plain columns. make() is called once a task and gives a function from the
    columns of a batch to any number of output column lists."""
    small_batches(df.sparkSession)
    fields = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for out in fn([c.to_pylist() for c in batch.columns]):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, arrow.types, strict=True)], schema=arrow)

    return df.mapInArrow(run, fields)


def blank(text: Column) -> Column:
    """Null text counts as empty."""
    return F.coalesce(text, F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
