"""Euler angles in all 24 conventions, named by a letter r (axes turn along) or s (axes stay) and three axes.

A rotation in turning axes is the product of its elementary rotations from left to right; in fixed axes it is the same
with axes and angles in reverse. Everything below is derived from that product.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orrery.functions import quat, vec

CONVENTIONS = [f + a + b + c for f in "rs" for a in "xyz" for b in "xyz" for c in "xyz" if a != b and b != c]


def _turning(axes: str, angles: list) -> tuple[list[int], list]:
    if axes not in CONVENTIONS:
        raise ValueError(f"unknown convention {axes!r}")
    ids = ["xyz".index(c) for c in axes[1:]]
    return (ids, angles) if axes[0] == "r" else (ids[::-1], angles[::-1])


def _elementary(axis: int, angle: Column) -> Column:
    parts = [F.lit(0.0)] * 3
    parts[axis] = F.sin(angle / 2)
    return quat.quat(*parts, F.cos(angle / 2))


def to_quat(a: Column, b: Column, c: Column, axes: str = "rxyz") -> Column:
    ids, angles = _turning(axes, [a, b, c])

    def product(*angles: Column) -> Column:
        first, second, third = (_elementary(i, x) for i, x in zip(ids, angles, strict=True))
        return quat.multiply(quat.multiply(first, second), third)

    return vec.bind(product, *angles)


def to_matrix(a: Column, b: Column, c: Column, axes: str = "sxyz") -> Column:
    return quat.to_matrix(to_quat(a, b, c, axes))


def _angles(m: list[list[Column]], ids: list[int], tiny: float = 4 * 2.220446049250313e-16) -> list[Column]:
    i, j, last = ids
    k = 3 - i - j
    e = 1.0 if (j - i) % 3 == 1 else -1.0
    if last == k:  # three different axes
        c = F.sqrt(m[i][i] * m[i][i] + m[i][j] * m[i][j])
        lock = c <= tiny
        a = F.when(lock, F.atan2(e * m[k][j], m[j][j])).otherwise(F.atan2(-e * m[j][k], m[k][k]))
        return [a, F.atan2(e * m[i][k], c), F.when(lock, 0.0).otherwise(F.atan2(-e * m[i][j], m[i][i]))]
    s = F.sqrt(m[i][j] * m[i][j] + m[i][k] * m[i][k])
    lock = s <= tiny
    a = F.when(lock, F.atan2(-e * m[j][k], m[j][j])).otherwise(F.atan2(m[j][i], -e * m[k][i]))
    return [a, F.atan2(s, m[i][i]), F.when(lock, 0.0).otherwise(F.atan2(m[i][j], e * m[i][k]))]


def from_entries(m: list[list[Column]], axes: str = "rxyz") -> Column:
    ids, _ = _turning(axes, [0, 1, 2])
    got = _angles(m, ids)
    if axes[0] == "s":
        got = got[::-1]
    return F.struct(*[g.alias(n) for g, n in zip(got, ("roll", "pitch", "yaw"), strict=True)])


def from_matrix(m: Column, axes: str = "sxyz") -> Column:
    return vec.bind(lambda m: from_entries([[m[i][j] for j in range(3)] for i in range(3)], axes), m)


def from_quat(q: Column, axes: str = "rxyz") -> Column:
    """struct(roll, pitch, yaw)."""
    return from_matrix(quat.to_matrix(q), axes)


def rotation_vector(v: Column) -> Column:
    """Quaternion of the turn by |v| about v."""
    return quat.from_angle_axis(vec.norm(v), v)
