"""A keyed table store on Parquet: each key is an ordered column of its own length."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import sequence, zips


class ColumnStore:
    """Keys under one folder, each a table (idx, value). Modes: w starts anew, a goes on, r reads."""

    def __init__(self, spark: SparkSession, path: str, mode: str = "r"):
        if mode not in ("r", "w", "a"):
            raise ValueError(f"unknown mode {mode!r}")
        self.spark, self.path, self.mode = spark, path.rstrip("/"), mode
        if mode == "w":
            fs, at = self._fs()
            fs.delete(at, True)

    def _fs(self, key: str | None = None):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{key}" if key else self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def keys(self) -> list[str]:
        fs, at = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()] if fs.exists(at) else []
        return sorted(n for n in names if not n.startswith("_"))

    def __getitem__(self, key: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{key}")

    def length(self, key: str) -> int:
        return self[key].count()

    def extend(self, key: str, rows: DataFrame, order: Sequence[str], value: str) -> None:
        """Appends rows in order; idx goes on from the key's length. The first rows set the type, later ones must have it."""
        if self.mode == "r":
            raise ValueError("opened for reading")
        fs, at = self._fs(key)
        start = self.length(key) if fs.exists(at) else 0
        if start and self[key].schema["value"].dataType != rows.schema[value].dataType:
            raise TypeError(f"{key} holds {self[key].schema['value'].dataType.simpleString()}")
        indexed = sequence.index_all(rows, order[0], order[1:], "idx").select((F.col("idx") + start).alias("idx"), F.col(value).alias("value"))
        indexed.write.mode("append").option("compression", "zstd").parquet(f"{self.path}/{key}")

    def values(self, key: str, inds: Sequence[int] | None = None, every: int | None = None) -> DataFrame:
        """A column, or its rows at sorted indices, or every k-th."""
        df = self[key]
        if inds is not None:
            df = sequence.pick(df, "idx", list(inds))
        return sequence.stride(df, "idx", every) if every else df

    def rows(self, keys: Sequence[str], inds: Sequence[int] | None = None) -> DataFrame:
        """Columns side by side, as far as the shortest goes."""
        return zips.zip_streams([self.values(k, inds).withColumnRenamed("value", k) for k in keys], ["idx"])

    def chunks(self, key: str, size: int = 10) -> DataFrame:
        return sequence.chunks(self[key], [], "idx", "value", size)

    def chunks_of(self, keys: Sequence[str], size: int = 10) -> DataFrame:
        """(chunk, a list a key): chunks of several keys side by side, as far as the shortest goes."""
        each = [self.chunks(k, size).withColumnRenamed("items", k) for k in keys]
        return zips.zip_streams(each, ["chunk"])

    def __setitem__(self, key: str, rows: DataFrame) -> None:
        """Puts rows (idx, value) in the place of a key's."""
        if self.mode == "r":
            raise ValueError("opened for reading")
        rows.select(F.col("idx").cast("bigint").alias("idx"), "value").write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{key}")

    def items(self, keys: Sequence[str] | None = None) -> Iterator[tuple[str, DataFrame]]:
        """Each key with its rows."""
        for k in keys or self.keys():
            yield k, self[k]

    def describe(self, **meta) -> None:
        """Notes about the store (plain values), beside what is noted already."""
        if self.mode == "r":
            raise ValueError("opened for reading")
        rows = [(json.dumps({**self.meta(), **meta}),)]
        self.spark.createDataFrame(rows, "value string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/_meta_next")
        fs, at = self._fs("_meta")
        fs.delete(at, True)
        fs.rename(self._fs("_meta_next")[1], at)

    def meta(self) -> dict:
        """The notes; without any, an empty dictionary."""
        fs, at = self._fs("_meta")
        return json.loads(self.spark.read.parquet(f"{self.path}/_meta").first()["value"]) if fs.exists(at) else {}
