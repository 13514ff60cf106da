"""Scans of poses against a plain loop, and drift that follows from the row."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import pose as P
from orrery.functions import quat, vec
from orrery.operators import scan
from orrery.operators.poses import _mul, _rotate


def made(n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    q = rng.normal(size=(n, 4))
    return q / np.linalg.norm(q, axis=1, keepdims=True), rng.normal(size=(n, 3))


def looped(q: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out_q, out_t = [q[0]], [t[0]]
    for a, b in zip(q[1:], t[1:]):
        out_t.append(_rotate(out_q[-1], b) + out_t[-1])
        out_q.append(_mul(out_q[-1], a))
    return np.array(out_q), np.array(out_t)


@pytest.mark.parametrize("n", [1, 2, 3, 8, 1000])
def test_products(n):
    q, t = made(n)
    got, want = scan.products(q, t), looped(q, t)
    assert all(np.allclose(a, b) for a, b in zip(got, want, strict=True))


def frame(spark, keys, n):
    rows = []
    for k in keys:
        q, t = made(n, 0 if k is None else k)
        rows += [(k, i, [*map(float, t[i])], [*map(float, q[i])]) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, i int, t array<double>, q array<double>")
    g = lambda c, j: F.col(c)[j]
    return df.select("k", "i", P.pose(quat.quat(*[g("q", j) for j in range(4)]), vec.vec3(*[g("t", j) for j in range(3)])).alias("pose")).orderBy(F.rand(3))


@pytest.mark.parametrize("size", [5, 1 << 16])
def test_prefix_products(spark, size):
    """Trajectories over many blocks (and blocks of blocks), a null key, products with and without the row."""
    n = 60
    got = scan.prefix_products(frame(spark, (1, 2, None), n), ["k"], "i", before="before", size=size)
    assert got.columns == ["k", "i", "pose", "chain", "before"]
    rows = {(r["k"], r["i"]): r for r in got.collect()}
    assert len(rows) == 3 * n
    for k in (1, 2, None):
        q, t = looped(*made(n, 0 if k is None else k))
        for i in range(n):
            c, b = rows[k, i]["chain"], rows[k, i]["before"]
            assert np.allclose([*c["t"]], t[i]) and np.allclose([c["q"][x] for x in "xyzw"], q[i])
            assert np.allclose([*b["t"]], t[i - 1] if i else 0) and np.allclose([b["q"][x] for x in "xyzw"], q[i - 1] if i else [0, 0, 0, 1])
    assert scan.prefix_products(frame(spark, (1,), 2).limit(0), ["k"], "i").count() == 0


def test_noise(spark):
    p = frame(spark, (1, 2), 50)
    key = F.concat_ws("/", "k", "i")
    same = scan.noisy_odometry(p, ["k"], "i", key, [0, 0], size=9).collect()
    assert all(np.allclose([*r["pose"]["t"]], [*r["noisy"]["t"]]) for r in same)
    draw = lambda size, seed: {(r["k"], r["i"]): [*r["noisy"]["t"]] for r in scan.noisy_odometry(p, ["k"], "i", key, [0.1] * 6, seed, size=size).collect()}
    one, two, other = draw(9, 1), draw(1000, 1), draw(1000, 2)
    assert all(np.allclose(one[k], two[k]) for k in one)  # however it is cut
    assert sum(np.allclose(one[k], other[k]) for k in one) == 2  # each trajectory's first
    with pytest.raises(ValueError):
        scan.noisy_odometry(p, ["k"], "i", key, [1, 2, 3])
    z = spark.range(20_000).select(*[c.alias(f"n{i}") for i, c in enumerate(scan.normals(F.col("id"), 3, "x"))]).toPandas().to_numpy()
    assert np.abs(z.mean(0)).max() < 0.03 and np.abs(z.std(0) - 1).max() < 0.03 and np.abs(np.corrcoef(z.T) - np.eye(3)).max() < 0.03
