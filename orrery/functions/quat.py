"""Quaternions: structs of x, y, z, w. Products nest large expressions: give each its own withColumn."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from orrery.functions import vec


def quat(x, y, z, w) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(float(v))).cast("double").alias(n) for n, v in zip("xyzw", (x, y, z, w), strict=True)])


def identity() -> Column:
    return quat(0, 0, 0, 1)


def from_wxyz(a: Column) -> Column:
    return quat(a[1], a[2], a[3], a[0])


def from_xyzw(a: Column) -> Column:
    return quat(a[0], a[1], a[2], a[3])


def to_wxyz(q: Column) -> Column:
    return F.array(q["w"], q["x"], q["y"], q["z"])


def to_xyzw(q: Column) -> Column:
    return F.array(q["x"], q["y"], q["z"], q["w"])


def dot(a: Column, b: Column) -> Column:
    def of(a: Column, b: Column) -> Column:
        return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"] + a["w"] * b["w"]

    return vec.bind(of, a, b)


def norm(q: Column) -> Column:
    return F.sqrt(dot(q, q))


def normalize(q: Column, tol: float = 1e-6) -> Column:
    """Unit length if it is off by more than tol."""
    n = norm(q)
    off = F.abs(n - 1) > tol
    return quat(*[F.when(off, F.try_divide(q[k], n)).otherwise(q[k]) for k in "xyzw"])


def conjugate(q: Column) -> Column:
    def of(q: Column) -> Column:
        return quat(-q["x"], -q["y"], -q["z"], q["w"])

    return vec.bind(of, q)


def inverse(q: Column) -> Column:
    """The true inverse: the conjugate divided by the squared norm."""
    def of(q: Column) -> Column:
        n = dot(q, q)
        return quat(*[F.try_divide(s * q[k], n) for k, s in zip("xyzw", (-1.0, -1.0, -1.0, 1.0), strict=True)])

    return vec.bind(of, q)


def multiply(a: Column, b: Column) -> Column:
    """Hamilton product a b: b's rotation first."""
    def of(a: Column, b: Column) -> Column:
        return quat(
            a["w"] * b["x"] + a["x"] * b["w"] + a["y"] * b["z"] - a["z"] * b["y"],
            a["w"] * b["y"] - a["x"] * b["z"] + a["y"] * b["w"] + a["z"] * b["x"],
            a["w"] * b["z"] + a["x"] * b["y"] - a["y"] * b["x"] + a["z"] * b["w"],
            a["w"] * b["w"] - a["x"] * b["x"] - a["y"] * b["y"] - a["z"] * b["z"],
        )

    return vec.bind(of, a, b)


def rotate(q: Column, v: Column) -> Column:
    """v + 2 w (u x v) + 2 u x (u x v), for unit q = (u, w)."""
    def of(q: Column, v: Column) -> Column:
        ux, uy, uz = q["x"], q["y"], q["z"]
        cx, cy, cz = uy * v["z"] - uz * v["y"], uz * v["x"] - ux * v["z"], ux * v["y"] - uy * v["x"]
        return vec.vec3(
            v["x"] + 2 * (q["w"] * cx + uy * cz - uz * cy),
            v["y"] + 2 * (q["w"] * cy + uz * cx - ux * cz),
            v["z"] + 2 * (q["w"] * cz + ux * cy - uy * cx),
        )

    return vec.bind(of, q, v)


def rotate_back(q: Column, v: Column) -> Column:
    return rotate(conjugate(q), v)


def from_angle_axis(angle: Column, axis: Column) -> Column:
    """Identity for a zero axis."""
    def of(angle: Column, axis: Column) -> Column:
        n = vec.norm(axis)
        s = F.sin(angle / 2)
        ok = n > 0
        return quat(*[F.when(ok, F.try_divide(axis[k] * s, n)).otherwise(0.0) for k in "xyz"], F.when(ok, F.cos(angle / 2)).otherwise(1.0))

    return vec.bind(of, angle, axis)


def to_angle_axis(q: Column) -> Column:
    """struct(angle, axis); no turn gives angle 0 about z."""
    def of(q: Column) -> Column:
        half = F.acos(F.greatest(F.least(q["w"], F.lit(1.0)), F.lit(-1.0)))
        s = F.sin(half)
        none = half < 1e-12
        axis = vec.vec3(*[F.when(none, F.lit(1.0 if k == "z" else 0.0)).otherwise(F.try_divide(q[k], s)) for k in "xyz"])
        return F.struct(F.when(none, 0.0).otherwise(2 * half).alias("angle"), axis.alias("axis"))

    return vec.bind(of, q)


def matrix_entries(q: Column) -> list[list[Column]]:
    """The rotation matrix as a list of rows; identity for a quaternion of almost no length."""
    n = q["x"] * q["x"] + q["y"] * q["y"] + q["z"] * q["z"] + q["w"] * q["w"]
    tiny = n < 4 * 2.220446049250313e-16
    s = F.when(tiny, 0.0).otherwise(F.try_divide(F.lit(2.0), n))
    x, y, z, w = (q[k] for k in "xyzw")
    return [
        [1 - s * (y * y + z * z), s * (x * y - z * w), s * (x * z + y * w)],
        [s * (x * y + z * w), 1 - s * (x * x + z * z), s * (y * z - x * w)],
        [s * (x * z - y * w), s * (y * z + x * w), 1 - s * (x * x + y * y)],
    ]


def to_matrix(q: Column) -> Column:
    def of(q: Column) -> Column:
        return vec.matrix(matrix_entries(q))

    return vec.bind(of, q)


def from_matrix(m: Column) -> Column:
    """From a rotation matrix (array of rows): the best-conditioned of the four forms."""
    def of(m: Column) -> Column:
        r = [[m[i][j] for j in range(3)] for i in range(3)]
        trace = r[0][0] + r[1][1] + r[2][2]

        def big(i: int) -> Column:
            j, k = (i + 1) % 3, (i + 2) % 3
            t = 1 + r[i][i] - r[j][j] - r[k][k]
            f = 0.5 / F.sqrt(F.greatest(t, F.lit(1e-300)))
            parts = {i: t * f, j: (r[i][j] + r[j][i]) * f, k: (r[k][i] + r[i][k]) * f}
            return quat(parts[0], parts[1], parts[2], (r[k][j] - r[j][k]) * f)

        t = 1 + trace
        f = 0.5 / F.sqrt(F.greatest(t, F.lit(1e-300)))
        by_trace = quat((r[2][1] - r[1][2]) * f, (r[0][2] - r[2][0]) * f, (r[1][0] - r[0][1]) * f, t * f)
        return F.when(trace > 0, by_trace).when((r[0][0] >= r[1][1]) & (r[0][0] >= r[2][2]), big(0)).when(r[1][1] >= r[2][2], big(1)).otherwise(big(2))

    return vec.bind(of, m)


def slerp(a: Column, b: Column, u, spin: int = 0, shortest: bool = True) -> Column:
    """From a (u = 0) to b (u = 1); the shorter way round unless told otherwise; linear when a and b almost agree."""
    u = u if isinstance(u, Column) else F.lit(float(u))
    return vec.bind(lambda a, b, u, d: _slerp(a, b, u, d, spin, shortest), a, b, u, dot(a, b))


def _slerp(a: Column, b: Column, u: Column, d: Column, spin: int, shortest: bool) -> Column:
    flip = F.when((d < 0) & F.lit(shortest), -1.0).otherwise(1.0)
    omega = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), d * flip))) + spin * math.pi

    def weights(omega: Column, flip: Column) -> Column:
        s = F.sin(omega)
        flat = F.abs(s) < 1e-6
        wa = F.when(flat, 1 - u).otherwise(F.try_divide(F.sin((1 - u) * omega), s))
        wb = F.when(flat, u).otherwise(F.try_divide(F.sin(u * omega), s)) * flip
        return F.struct(wa.alias("a"), wb.alias("b"))

    return vec.bind(lambda w: quat(*[w["a"] * a[k] + w["b"] * b[k] for k in "xyzw"]), vec.bind(weights, omega, flip))


def uniform(r1: Column, r2: Column, r3: Column) -> Column:
    """Uniform rotations from three uniform numbers (Shoemake's subgroup method)."""
    a, b, p, q = F.sqrt(1 - r1), F.sqrt(r1), 2 * math.pi * r2, 2 * math.pi * r3
    return quat(F.sin(p) * a, F.cos(p) * a, F.sin(q) * b, F.cos(q) * b)
