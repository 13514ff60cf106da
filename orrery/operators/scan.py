"""Scans along trajectories of any length: products of poses don't commute, but they associate.

A table is cut into blocks of its order (by range, so a long trajectory spans many). Each block is scanned on its own in
doubling steps; the products of whole blocks, which are few, are scanned in the same way, by blocks again where there are
many; each row's result is the product of all blocks before it and its place in its own. A block's first row sees the last
row of the block before.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery import shared
from orrery.functions import pose as P
from orrery.operators.poses import _mul, _rotate

#: Rows of a block, about; most partitions that blocks are cut from, beyond which each holds several blocks.
BLOCK = 1 << 16
PARTS = 200
_POSE = "struct<q: struct<x: double, y: double, z: double, w: double>, t: struct<x: double, y: double, z: double>>"


def products(q: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """p_0, p_0 p_1, p_0 p_1 p_2, ...: after the step of width d each place holds the product of its last 2d poses."""
    q, t, d = q.copy(), t.copy(), 1
    while d < len(q):
        late_q, late_t = _mul(q[:-d], q[d:]), _rotate(q[:-d], t[d:]) + t[:-d]
        q[d:], t[d:] = late_q, late_t
        d *= 2
    return q, t


def blocks(df: DataFrame, by: Sequence[str], order: str, size: int = BLOCK, name: str = "_block") -> DataFrame:
    """df with the number of its block in (by, order), written once: blocks rise with the order, and rows that come
    again after a loss keep theirs. The order is total in a trajectory, so a block may end anywhere."""
    n = min(PARTS, max(1, -(-df.count() // size)))
    # the rows' ids go up from 2^33 times the partition's number, so no block has rows of two partitions
    ordered = df.repartitionByRange(n, *by, order).sortWithinPartitions(*by, order)
    return shared.saved(ordered.withColumn(name, F.floor(F.monotonically_increasing_id() / size)), "blocks")


def _same(a: str, b: str, keys: Sequence[str]) -> Column:
    """Null-safe equality of the keys of two aliases."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def with_previous(cut: DataFrame, by: Sequence[str], order: str, col: str, name: str) -> DataFrame:
    """Adds the value of col in the row before (null for a trajectory's first): from the same block, or the last row of the
    trajectory's block before."""
    key = [*by, "_block"]
    ends = cut.groupBy(*key).agg(F.max_by(col, order).alias("_end"))
    ends = ends.withColumn("_end", F.lag("_end").over(Window.partitionBy(*by).orderBy("_block")))  # a row a block
    joined = cut.alias("a").join(ends.alias("b"), _same("a", "b", key), "left").select("a.*", "b._end")
    inside = Window.partitionBy(*key).orderBy(order)
    first = F.row_number().over(inside) == 1
    return joined.withColumn(name, F.when(first, F.col("_end")).otherwise(F.lag(col).over(inside))).drop("_end")


def _local(cut: DataFrame, by: Sequence[str], order: str, col: str) -> DataFrame:
    """Adds _upto and _before: the products within the block, with and without the row itself."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        rows = table.column(col).combine_chunks()
        part = lambda s, keys: np.stack([rows.field(s).field(k).to_numpy(zero_copy_only=False) for k in keys], 1).astype(float)
        q, t = products(part("q", "xyzw"), part("t", "xyz"))
        wrap = lambda a, keys: pa.StructArray.from_arrays([pa.array(c) for c in a.T.copy()], list(keys))
        pose = lambda q, t: pa.StructArray.from_arrays([wrap(q, "xyzw"), wrap(t, "xyz")], ["q", "t"])
        first = np.array([[0.0, 0, 0, 1]]), np.zeros((1, 3))
        return table.append_column("_upto", pose(q, t)).append_column("_before", pose(np.concatenate([first[0], q[:-1]]), np.concatenate([first[1], t[:-1]])))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    return cut.groupBy(*by, "_block").applyInArrow(run, f"{fields}, _upto {_POSE}, _before {_POSE}")


def prefix_products(df: DataFrame, by: Sequence[str], order: str, col: str = "pose", name: str = "chain", before: str | None = None, size: int = BLOCK) -> DataFrame:
    """Each row's product of all poses of its trajectory up to it, in order; before names a column for the product without
    the row itself. The order must be total in a trajectory; poses must not be null. A null key is a trajectory too."""
    return _scan(df if "_block" not in df.columns else df.drop("_block"), by, order, col, name, before, size)


def _scan(df: DataFrame, by: Sequence[str], order: str, col: str, name: str, before: str | None, size: int) -> DataFrame:
    cut = blocks(df, by, order, size)
    local = shared.saved(_local(cut, by, order, col), "local")
    key = [*by, "_block"]
    whole = local.groupBy(*key).agg(F.max_by("_upto", order).alias("_whole"))
    # the most blocks of a trajectory: many trajectories of one block each need no chain, and no further round
    n = whole.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if n <= 1:
        out = local.withColumn(name, F.col("_upto")).withColumn("_ahead", F.col("_before"))
    else:
        if n > size:
            ahead = _scan(whole.withColumnRenamed("_block", "_at"), by, "_at", "_whole", "_all", "_offset", size).select(*by, F.col("_at").alias("_block"), "_offset")
        else:  # one block of blocks for each trajectory
            ahead = _local(whole.withColumnRenamed("_block", "_at").withColumn("_block", F.lit(0)), by, "_at", "_whole").select(*by, F.col("_at").alias("_block"), F.col("_before").alias("_offset"))
        joined = local.alias("a").join(ahead.alias("b"), _same("a", "b", key)).select("a.*", "b._offset")
        out = joined.withColumn(name, P.compose(F.col("_offset"), F.col("_upto"))).withColumn("_ahead", P.compose(F.col("_offset"), F.col("_before"))).drop("_offset")
    out = out.withColumn(before, F.col("_ahead")) if before else out
    return out.drop("_ahead", "_upto", "_before", "_block")


def normals(key: Column, seed: int, kind: str, n: int = 3) -> list[Column]:
    """Numbers of the standard normal distribution, drawn by SHA-256 of seed, kind and key: the same for a row wherever and
    however often it is computed. Up to four."""
    if n > 4:
        raise ValueError("a hash gives four numbers")
    h = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(kind), key.cast("string")), 256)
    u = lambda i: (F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return [F.sqrt(-2 * F.log(u(2 * i))) * F.cos(2 * np.pi * u(2 * i + 1)) for i in range(n)]


def noisy_odometry(df: DataFrame, by: Sequence[str], order: str, key: Column, noise: Sequence[float], seed: int = 1, col: str = "pose", name: str = "noisy", size: int = BLOCK) -> DataFrame:
    """Trajectories that drift: the first pose stays, each later one follows the noisy one before it by the true step, moved
    by noise of its own. noise has two spreads (of place and of angles) or six (x, y, z, roll, pitch, yaw); key tells rows
    apart for the draw. Steps are drawn row by row and chained by a scan, so a trajectory may have any length."""
    if len(noise) not in (2, 6):
        raise ValueError("noise has two or six entries")
    spread = [float(s) for s in (np.repeat(noise, 3) if len(noise) == 2 else noise)]
    cut = with_previous(blocks(df, by, order, size), by, order, col, "_previous")
    e = [x * s for x, s in zip([*normals(key, seed, "step"), *normals(key, seed, "turn")], spread, strict=True)]
    step = P.compose(P.from_rpyxyz(*e[3:], *e[:3]), P.between(F.col("_previous"), F.col(col)))
    moved = cut.withColumn("_step", F.when(F.col("_previous").isNull(), F.col(col)).otherwise(step)).drop("_previous", "_block")
    return prefix_products(moved, by, order, "_step", name, size=size).drop("_step")
