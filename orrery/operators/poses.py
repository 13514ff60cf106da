"""Trajectories: tables with by columns, an order column and a pose struct (q, t)."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import pose as P
from orrery.operators import zips


def relative_to_first(df: DataFrame, by: Sequence[str], order: str, col: str = "pose", name: str = "rel") -> DataFrame:
    """Each pose as seen from its trajectory's first: that one is found by an aggregate and joined."""
    first = df.groupBy(*by).agg(F.min_by(col, order).alias("_first"))
    joined = df.join(first, list(by)) if by else df.crossJoin(F.broadcast(first))
    return joined.withColumn(name, P.between(F.col("_first"), F.col(col))).drop("_first")


def deltas(df: DataFrame, by: Sequence[str], order: str, col: str = "pose", name: str = "delta") -> DataFrame:
    """Each pose as seen from the one before; the first of a trajectory has none and goes."""
    before = F.lag(col).over(Window.partitionBy(*by).orderBy(order))
    return df.withColumn("_before", before).where("_before IS NOT NULL").withColumn(name, P.between(F.col("_before"), F.col(col))).drop("_before")


def apply_to_points(poses: DataFrame, points: DataFrame, on: Sequence[str], col: str = "pose", point: str = "p", keep: Sequence[str] = ()) -> DataFrame:
    """Points moved by the poses that they share keys with; keep names more columns of the poses."""
    return points.join(poses.select(*on, *keep, col), list(on)).withColumn("moved", P.apply(F.col(col), F.col(point)))


def oxts(df: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Packets (lat, lon, alt, roll, pitch, yaw) -> pose: Mercator metres and the turn Rz(yaw) Ry(pitch) Rx(roll), with the
    scale of the first packet's latitude; and rel, the pose as seen from the first."""
    first = df.groupBy(*by).agg(F.min_by("lat", order).alias("_lat0"))
    joined = df.join(first, list(by)) if by else df.crossJoin(F.broadcast(first))
    from orrery.functions import euler

    t = P.mercator(F.col("lat"), F.col("lon"), F.col("alt"), F.cos(F.radians("_lat0")))
    posed = joined.withColumn("pose", P.pose(euler.to_quat(F.col("roll"), F.col("pitch"), F.col("yaw"), "sxyz"), t)).drop("_lat0")
    return relative_to_first(posed, by, order)


def interpolate_at(queries: DataFrame, track: DataFrame, by: Sequence[str], ts: str, col: str = "pose") -> DataFrame:
    """Poses between the rows before and after each query time; null outside the trajectory."""
    a = zips.asof(queries, track, by, ts, [col]).withColumnRenamed("match", "_a")
    b = zips.asof(a, track, by, ts, [col], forward=True).withColumnRenamed("match", "_b")
    x = lambda c: F.col(c).cast("double")
    span = x("_b.ts") - x("_a.ts")
    w = F.when(span == 0, 0.0).otherwise(F.try_divide(x(ts) - x("_a.ts"), span))
    inside = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    out = b.withColumn("_w", w).withColumn("pose", F.when(inside, P.interpolate(F.col(f"_a.{col}"), F.col(f"_b.{col}"), F.col("_w"))))
    return out.drop("_a", "_b", "_w")


# history-gated sampling: one step for batch and stream


def _rotate(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    u, w = q[..., :3], q[..., 3:]
    c = np.cross(u, v)
    return v + 2 * (w * c + np.cross(u, c))


def _mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    va, wa, vb, wb = a[..., :3], a[..., 3:], b[..., :3], b[..., 3:]
    return np.concatenate([wa * vb + wb * va + np.cross(va, vb), wa * wb - (va * vb).sum(-1, keepdims=True)], -1)


def _angles(q: np.ndarray) -> np.ndarray:
    """roll, pitch, yaw of Rx Ry Rz."""
    x, y, z, w = np.moveaxis(q, -1, 0)
    return np.stack([np.arctan2(2 * (x * w - y * z), 1 - 2 * (x * x + y * y)), np.arcsin(np.clip(2 * (x * z + y * w), -1, 1)), np.arctan2(2 * (z * w - x * y), 1 - 2 * (y * y + z * z))], -1)


def sample_step(history: np.ndarray, new: np.ndarray, displacement: float, theta: float) -> bool:
    """Whether a pose (7 numbers: t, q) is taken: no pose of the history is both nearer than the displacement and turned by
    less than theta on all three axes."""
    tx, ty, tz, x, y, z, w = (float(v) for v in new)
    for hx, hy, hz, a, b, c, d in history.tolist() if isinstance(history, np.ndarray) else history:
        ex, ey, ez = hx - tx, hy - ty, hz - tz
        # the turn back to the pose: (-x, -y, -z, w) (a, b, c, d)
        qx, qy, qz, qw = w * a - d * x - (y * c - z * b), w * b - d * y - (z * a - x * c), w * c - d * z - (x * b - y * a), w * d + (x * a + y * b + z * c)
        if (
            math.sqrt(ex * ex + ey * ey + ez * ez) < displacement
            and abs(math.atan2(2 * (qx * qw - qy * qz), 1 - 2 * (qx * qx + qy * qy))) < theta
            and abs(math.asin(max(-1.0, min(1.0, 2 * (qx * qz + qy * qw))))) < theta
            and abs(math.atan2(2 * (qz * qw - qx * qy), 1 - 2 * (qy * qy + qz * qz))) < theta
        ):
            return False
    return True


def _seven(pdf: pd.DataFrame) -> np.ndarray:
    return pdf[["tx", "ty", "tz", "qx", "qy", "qz", "qw"]].to_numpy(float)


def flat(df: DataFrame, col: str = "pose") -> DataFrame:
    """The pose struct as seven columns."""
    return df.select("*", *[F.col(f"{col}.t.{k}").alias(f"t{k}") for k in "xyz"], *[F.col(f"{col}.q.{k}").alias(f"q{k}") for k in "xyzw"]).drop(col)


def sample_poses(df: DataFrame, by: Sequence[str], order: str, displacement: float = 0.25, theta: float = math.radians(20), history: int = 10) -> DataFrame:
    """Keyframes: rows (with seven pose columns, see flat) that the step takes, in order. Acceptance depends on what was
    accepted before, so a trajectory is one task's work."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        kept, past = [], []
        for i, row in enumerate(_seven(pdf).tolist()):
            if sample_step(past, row, displacement, theta):
                kept.append(i)
                past = [*past, row][-history:]
        return pdf.iloc[kept]

    return df.groupBy(*by).applyInPandas(run, df.schema)


def inject_noise(df: DataFrame, by: Sequence[str], order: str, noise: Sequence[float] = (0.0, 0.0), seed: int = 1) -> DataFrame:
    """Odometry with seeded Gaussian noise: p'_k = p'_{k-1} (n (p_{k-1}^-1 p_k)). noise: two spreads (turn, step) or six."""
    if len(noise) not in (2, 6):
        raise ValueError("noise has two or six entries")
    spread = np.repeat(noise, 3) if len(noise) == 2 else np.asarray(noise, float)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order).copy()
        rows, rng = _seven(pdf), np.random.RandomState(seed)
        # all steps at once, with their noise; only the chain itself goes row by row
        back = rows[:-1, 3:] * np.array([-1, -1, -1, 1])
        step_t, step_q = _rotate(back, rows[1:, :3] - rows[:-1, :3]), _mul(back, rows[1:, 3:])
        e = rng.normal(size=(len(back), 6)) * spread
        h = e[:, :3] / 2
        n = np.tile([0.0, 0.0, 0.0, 1.0], (len(back), 1))
        for axis in range(3):
            q = np.zeros((len(back), 4))
            q[:, axis], q[:, 3] = np.sin(h[:, axis]), np.cos(h[:, axis])
            n = _mul(n, q)
        step_t, step_q = _rotate(n, step_t) + e[:, 3:], _mul(n, step_q)
        out = [rows[0].tolist()] if len(rows) else []
        for (vx, vy, vz), (a, b, c, d) in zip(step_t.tolist(), step_q.tolist(), strict=True):
            tx, ty, tz, x, y, z, w = out[-1]
            cx, cy, cz = y * vz - z * vy, z * vx - x * vz, x * vy - y * vx
            tx, ty, tz = tx + vx + 2 * (w * cx + y * cz - z * cy), ty + vy + 2 * (w * cy + z * cx - x * cz), tz + vz + 2 * (w * cz + x * cy - y * cx)
            x, y, z, w = w * a + d * x + (y * c - z * b), w * b + d * y + (z * a - x * c), w * c + d * z + (x * b - y * a), w * d - (x * a + y * b + z * c)
            size = math.sqrt(x * x + y * y + z * z + w * w)
            out.append([tx, ty, tz, *((k / size for k in (x, y, z, w)) if size else (math.nan,) * 4)])
        out = np.array(out, float).reshape(-1, 7)
        pdf[["tx", "ty", "tz", "qx", "qy", "qz", "qw"]] = out
        return pdf

    return df.groupBy(*by).applyInPandas(run, df.schema)


def align(pairs: DataFrame, by: Sequence[str], scaling: bool = False) -> DataFrame:
    """Least-squares rigid (or similarity) motion from points (ax, ay, az) to (bx, by_, bz): sums and the 3x3 covariance are
    partial aggregates; only these meet, and a 3x3 SVD gives the answer. -> (by, r: 9 numbers, t: 3, scale, rmse)."""
    a, b = ["ax", "ay", "az"], ["bx", "by_", "bz"]
    sums = [F.count("*").alias("n"), *[F.sum(c).alias(f"s_{c}") for c in a + b], *[F.sum(F.col(x) * F.col(y)).alias(f"s_{x}{y}") for x in a for y in b], *[F.sum(F.col(c) * F.col(c)).alias(f"q_{c}") for c in a + b]]
    stats = pairs.groupBy(*by).agg(*sums)
    fields = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in by)

    def run(batches):
        for pdf in batches:
            rows = []
            for _, s in pdf.iterrows():
                n = s["n"]
                ma, mb = np.array([s[f"s_{c}"] for c in a]) / n, np.array([s[f"s_{c}"] for c in b]) / n
                cov = np.array([[s[f"s_{x}{y}"] for y in b] for x in a]) - n * np.outer(ma, mb)
                va, vb = sum(s[f"q_{c}"] for c in a) - n * ma @ ma, sum(s[f"q_{c}"] for c in b) - n * mb @ mb
                u, d, vt = np.linalg.svd(cov)
                sign = np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T)) or 1])
                r = vt.T @ sign @ u.T
                scale = math.sqrt(vb / va) if scaling and va > 0 else 1.0
                err = max(0.0, vb + scale**2 * va - 2 * scale * np.trace(r @ cov))
                rows.append([*(s[c] for c in by), r.ravel().tolist(), (mb - scale * r @ ma).tolist(), scale, math.sqrt(err / n)])
            yield pd.DataFrame(rows, columns=[*by, "r", "t", "scale", "rmse"])

    return stats.mapInPandas(run, f"{fields}{', ' if by else ''}r array<double>, t array<double>, scale double, rmse double")
