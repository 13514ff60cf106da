"""Turning by dragging over a ball: places in a window become unit vectors, two of them a turn."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orrery.functions import quat, vec


def on_ball(x: Column, y: Column, cx, cy, radius) -> Column:
    """The point of the unit ball under a place in the window (y down); its rim for places outside."""

    def of(v: Column) -> Column:
        n = F.sqrt(v["x"] * v["x"] + v["y"] * v["y"])
        return F.when(n > 1, vec.vec3(v["x"] / n, v["y"] / n, 0.0)).otherwise(vec.vec3(v["x"], v["y"], F.sqrt(F.greatest(1 - n * n, F.lit(0.0)))))

    return vec.bind(of, vec.vec3((x - cx) / radius, (cy - y) / radius, 0.0))


def constrained(point: Column, axis: Column) -> Column:
    """The point's direction within the plane across an axis of unit length, on the near side; where the point lies on the
    axis, a direction across it: the axis crossed with the coordinate axis that is least along it."""

    def facing(flat: Column, a: Column) -> Column:
        x, y, z = (F.abs(a[k]) for k in "xyz")
        least = F.when((x <= y) & (x <= z), vec.vec3(1, 0, 0)).when(y <= z, vec.vec3(0, 1, 0)).otherwise(vec.vec3(0, 0, 1))
        chosen = F.when(vec.norm(flat) > 1e-12, flat).otherwise(vec.cross(a, least))
        return vec.bind(lambda v: F.when(v["z"] < 0, vec.scale(v, -1.0)).otherwise(v), vec.unit(chosen))

    return vec.bind(lambda p, a: vec.bind(facing, vec.sub(p, vec.scale(a, vec.dot(a, p))), a), point, axis)


def drag(start: Column, now: Column, before: Column) -> Column:
    """The orientation after dragging from one ball point to another: no turn if they are the same."""

    def of(a: Column, b: Column, q: Column) -> Column:
        t = vec.cross(a, b)
        turned = quat.multiply(quat.quat(t["x"], t["y"], t["z"], vec.dot(a, b)), q)
        return F.when(vec.dot(t, t) < 1e-15, q).otherwise(turned)

    return vec.bind(of, start, now, before)


def nearest_axis(point: Column, axes: list[Column]) -> Column:
    """The place in the list of the axis whose arc is nearest to the point (the first in a tie)."""
    cosines = F.transform(F.array(*axes), lambda a: vec.dot(constrained(point, a), point))
    return vec.bind(lambda c: (F.array_position(c, F.array_max(c)) - 1).cast("int"), cosines)
