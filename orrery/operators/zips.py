"""Joins by position: streams zipped on an index, padded sensors, range look-ups and joins to the last earlier row."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def zip_streams(streams: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Rows with all streams at one index: stops where the shortest does."""
    return reduce(lambda a, b: a.join(b, list(on), "inner"), streams)


def zip_optional(first: DataFrame, others: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """All rows of the first stream; nulls where another has none (an absent sensor is an empty table)."""
    return reduce(lambda a, b: a.join(b, list(on), "left"), others, first)


def absent(df: DataFrame, name: str, kind: str) -> DataFrame:
    """A sensor that isn't there: nulls."""
    return df.withColumn(name, F.lit(None).cast(kind))


def same_length(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the common length; raises at run time if they differ."""
    n = a.agg(F.count("*").alias("n")).crossJoin(b.agg(F.count("*").alias("m")))
    return n.select(F.when(F.col("n") == F.col("m"), F.col("n")).otherwise(F.raise_error(F.lit("streams differ in length")).cast("bigint")).alias("length"))


def union_scenes(scenes: dict[str, DataFrame]) -> DataFrame:
    """All scenes' rows, each with its scene's name."""
    return reduce(DataFrame.unionByName, [d.withColumn("scene", F.lit(k)) for k, d in scenes.items()])


def with_all(df: DataFrame, small: DataFrame, most: int = 10_000) -> DataFrame:
    """Each row with each row of a small dimension, as centroids are: more than `most` of these are an error."""
    if small.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows to compare each row with")
    return df.join(F.broadcast(small))


def range_lookup(df: DataFrame, key: str, ranges: DataFrame, lo: str = "lo", hi: str = "hi", most: int = 10_000) -> DataFrame:
    """Left join to the row whose lo <= key <= hi. Ranges are a small dimension: more than `most` rows are an error,
    so broadcasting them is safe."""
    if ranges.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} ranges; join them on a bucketed key")
    return df.join(F.broadcast(ranges), (F.col(key) >= F.col(lo)) & (F.col(key) <= F.col(hi)), "left")


def asof(left: DataFrame, right: DataFrame, by: Sequence[str], ts: str, columns: Sequence[str], forward: bool = False) -> DataFrame:
    """For each left row the columns of the last right row at or before its ts (or the first at or after it): one sort of
    both sides together per partition, no range join."""
    r = right.select(*by, ts, F.struct(F.col(ts).alias("ts"), *columns).alias("_r"))
    l_ = left.withColumn("_r", F.lit(None).cast(r.schema["_r"].dataType)).withColumn("_left", F.lit(1))
    both = l_.unionByName(r.withColumn("_left", F.lit(0)), allowMissingColumns=True)
    if forward:
        w = Window.partitionBy(*by).orderBy(F.col(ts), F.col("_left").desc()).rowsBetween(0, Window.unboundedFollowing)
        found: Column = F.first("_r", ignorenulls=True).over(w)
    else:
        w = Window.partitionBy(*by).orderBy(F.col(ts), F.col("_left")).rowsBetween(Window.unboundedPreceding, 0)
        found = F.last("_r", ignorenulls=True).over(w)
    return both.withColumn("match", found).where("_left = 1").drop("_left", "_r")
