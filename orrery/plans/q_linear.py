"""Matrix queries: what a matrix was built from comes back, and columns of vectors, turns and cameras against their formulas."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from orrery.functions import camera as C
from orrery.functions import pose as P
from orrery.functions import quat, vec
from orrery.operators import linear as L
from orrery.plans.fixtures import FRAMES, POSES, frames, poses, r, rotate_sql, rs
from orrery.plans.registry import query

_AXIS = (1.0, 2.0, 2.0)
_IN = f"WITH {FRAMES}"
#: The foot of (tx, ty, tz) along the axis.
_ALONG = "((tx + 2 * ty + 2 * tz) / 9)"
_FOOT = (f"{_ALONG} * 1", f"{_ALONG} * 2", f"{_ALONG} * 2")
_UNIT = ("1.0 / 3", "2.0 / 3", "2.0 / 3")


def _at():
    return vec.vec3(*[F.col(c) for c in ("tx", "ty", "tz")])


def _named(prefix, parts, digits=5):
    return ", ".join(f"{rs(e, digits)} AS {prefix}{k}" for e, k in zip(parts, "xyz", strict=True))


def _three(column, prefix, digits=5):
    return [r(column[i], digits).alias(f"{prefix}{k}") for i, k in enumerate("xyz")]


@query("matrix_rotation_parts", f"{_IN} SELECT event_id, {rs('roll', 5)} AS angle, {_named('d', [f'CASE WHEN roll > 0 THEN {u} ELSE {z} END' for u, z in zip(_UNIT, ('0', '0', '1'), strict=True)])}, {_named('p', [f'CASE WHEN roll > 0 THEN t{k} - {e} ELSE 0 END' for k, e in zip('xyz', _FOOT, strict=True)], 4)} FROM frames")
def matrix_rotation_parts(spark, sf):
    """Angle, axis and the axis' point nearest to the origin."""
    m = L.held(frames(spark, sf), m=P.rotation_matrix(F.col("roll"), vec.unit(vec.vec3(*_AXIS)), _at())).select("event_id", L.rotation_parts(F.col("m")).alias("p"))
    return m.select("event_id", r(F.col("p.angle"), 5).alias("angle"), *_three(F.col("p.direction"), "d"), *_three(F.col("p.point"), "p", 4))


@query("matrix_half_turns", f"{_IN} SELECT event_id, {rs(str(math.pi), 5)} AS angle, {_named('d', [f'abs({e}) / sqrt(power(tx, 2) + power(ty, 2) + 1)' for e in ('tx', 'ty', '1')], 4)} FROM frames")
def matrix_half_turns(spark, sf):
    """Half turns, where the skew part of the matrix is nothing; the axis up to its sign."""
    axis = vec.unit(vec.vec3(F.col("tx"), F.col("ty"), 1.0))
    m = L.held(frames(spark, sf), m=P.rotation_matrix(F.lit(math.pi), axis)).select("event_id", L.rotation_parts(F.col("m")).alias("p"))
    return m.select("event_id", r(F.col("p.angle"), 5).alias("angle"), *[r(F.abs(F.col("p.direction")[i]), 4).alias(f"d{k}") for i, k in enumerate("xyz")])


@query("matrix_scale_parts", f"{_IN} SELECT event_id, {rs('2 + tz')} AS factor, {_named('o', _FOOT, 4)}, {_named('d', _UNIT)}, {rs('0.5 + tz')} AS even, true AS is_even FROM frames")
def matrix_scale_parts(spark, sf):
    """Scalings along a direction, and even ones about a point."""
    f = F.col("tz")
    both = L.held(frames(spark, sf), m=P.scale_matrix(f + 2, _at(), vec.vec3(*_AXIS)), e=P.scale_matrix(f + 0.5, _at()))
    m = both.select("event_id", L.scale_parts(F.col("m")).alias("p"), L.scale_parts(F.col("e")).alias("q"))
    return m.select("event_id", r(F.col("p.factor")).alias("factor"), *_three(F.col("p.origin"), "o", 4), *_three(F.col("p.direction"), "d"), r(F.col("q.factor")).alias("even"), F.col("q.direction").isNull().alias("is_even"))


@query("matrix_mirror_parts", f"{_IN} SELECT event_id, {_named('p', _FOOT, 4)}, {_named('n', _UNIT)} FROM frames")
def matrix_mirror_parts(spark, sf):
    m = L.held(frames(spark, sf), m=P.reflection_matrix(_at(), vec.vec3(*_AXIS))).select("event_id", L.reflection_parts(F.col("m")).alias("p"))
    return m.select("event_id", *_three(F.col("p.point"), "p", 4), *_three(F.col("p.normal"), "n"))


_CENTRE = ("tx / 50 + 1", "ty + 2", "600.0")


@query(
    "matrix_projection_parts",
    f"{_IN} SELECT event_id, {_named('p', _FOOT, 4)}, true AS straight, {_named('d', ('2.0 / 3', '1.0 / 3', '2.0 / 3'))}, {_named('c', _CENTRE, 3)}, {_named('s', _CENTRE, 3)}, {_named('f', _FOOT, 3)} FROM frames",
)
def matrix_projection_parts(spark, sf):
    """Orthogonal, oblique and central projections, the last also with depth kept."""
    n, d = vec.vec3(*_AXIS), vec.vec3(2.0, 1.0, 2.0)
    c = vec.vec3(F.col("tx") / 50 + 1, F.col("ty") + 2, 600.0)
    m = L.held(frames(spark, sf), a=P.projection_matrix(_at(), n), b=P.projection_matrix(_at(), n, d), e=P.projection_matrix(_at(), n, perspective=c), f=P.projection_matrix(_at(), n, perspective=c, pseudo=True))
    p = m.select("event_id", *[L.projection_parts(F.col(k)).alias(k) for k in "abe"], L.projection_parts(F.col("f"), True).alias("f"))
    return p.select("event_id", *_three(F.col("a.point"), "p", 4), F.col("a.direction").isNull().alias("straight"), *_three(F.col("b.direction"), "d"), *_three(F.col("e.perspective"), "c", 3), *_three(F.col("f.perspective"), "s", 3), *_three(F.col("f.point"), "f", 3))


@query("matrix_shear_parts", f"{_IN} SELECT event_id, {', '.join(f'{rs(f'CASE WHEN pitch > 0 THEN {e} END', d)} AS {n}' for e, d, n in (('pitch', 5, 'angle'), *((v, 5, f'd{k}') for k, v in zip('xyz', '100', strict=True)), *((v, 5, f'n{k}') for k, v in zip('xyz', '010', strict=True)), ('ty', 4, 'py')))} FROM frames")
def matrix_shear_parts(spark, sf):
    """The parts of a shear; of one by no angle there are none."""
    f = frames(spark, sf)
    m = L.held(f, m=P.shear_matrix(F.col("pitch"), vec.vec3(1, 0, 0), _at(), vec.vec3(0, 1, 0))).select("event_id", L.shear_parts(F.col("m")).alias("p"))
    return m.select("event_id", r(F.col("p.angle"), 5).alias("angle"), *_three(F.col("p.direction"), "d"), *_three(F.col("p.normal"), "n"), r(F.col("p.point")[1], 4).alias("py"))


@query("matrix_decompose", f"{_IN} SELECT event_id, {_named('s', ('1.5', '2', '0.5'))}, {_named('a', ('roll', 'pitch', 'yaw'))}, {_named('t', ('tx', 'ty', 'tz'), 4)}, {rs('0')} AS again FROM frames WHERE abs(roll) < 1.5")
def matrix_decompose(spark, sf):
    """Scales, angles and shift of a matrix come back, and the matrix of these is the matrix."""
    f = frames(spark, sf).where(F.abs("roll") < 1.5)
    turn = P.to_matrix(P.from_rpyxyz(F.col("roll"), F.col("pitch"), F.col("yaw"), F.col("tx"), F.col("ty"), F.col("tz"), "sxyz"))
    size = vec.matrix([[1.5, 0, 0, 0], [0, 2.0, 0, 0], [0, 0, 0.5, 0], [0, 0, 0, 1]])
    m = L.held(f, m=vec.matmul(turn, size)).select("event_id", "m", L.decompose(F.col("m")).alias("p")).withColumn("again", L.compose(F.col("p")))
    off = F.aggregate(F.zip_with(F.flatten("m"), F.flatten("again"), lambda a, b: F.abs(a - b)), F.lit(0.0), lambda acc, x: F.greatest(acc, x))
    return m.select("event_id", *_three(F.col("p.scale"), "s"), *_three(F.col("p.angles"), "a"), *_three(F.col("p.translate"), "t", 4), r(off).alias("again"))


_BACK = rotate_sql("q", ("tx", "ty", "tz"), -1)


@query("matrix_inverse", f"WITH {POSES} SELECT event_id, {_named('t', [f'-{e}' for e in _BACK], 4)} FROM poses")
def matrix_inverse(spark, sf):
    m = L.held(poses(spark, sf), m=P.to_matrix(F.col("pose"))).select("event_id", L.inverse(F.col("m")).alias("i"))
    return m.select("event_id", *[r(F.col("i")[k][3], 4).alias(f"t{'xyz'[k]}") for k in range(3)])


@query("quat_rotate_back", f"WITH {POSES} SELECT event_id, {_named('b', _BACK, 4)}, {rs('1', 5)} AS norm, {rs('qw', 5)} AS w FROM poses")
def quat_rotate_back(spark, sf):
    """Turning back, and what the dot product with no turn says."""
    p = poses(spark, sf).withColumn("b", quat.rotate_back(F.col("pose.q"), F.col("pose.t")))
    return p.select("event_id", *[r(F.col(f"b.{k}"), 4).alias(f"b{k}") for k in "xyz"], r(quat.norm(F.col("pose.q")), 5).alias("norm"), r(quat.dot(F.col("pose.q"), quat.identity()), 5).alias("w"))


@query("vec_products", f"{_IN} SELECT event_id, {rs('sqrt(tx * tx + ty * ty + tz * tz)')} AS size, {_named('c', ('ty * 2 - tz * 2', 'tz * 1 - tx * 2', 'tx * 2 - ty * 1'), 4)}, {_named('u', [f'CASE WHEN tx * tx + ty * ty + tz * tz > 0 THEN {k} / sqrt(tx * tx + ty * ty + tz * tz) END' for k in ('tx', 'ty', 'tz')], 6)} FROM frames")
def vec_products(spark, sf):
    """Length, cross product (by the skew matrix) and unit vector."""
    f = frames(spark, sf).withColumn("v", _at()).withColumn("s", vec.skew(F.col("v"))).withColumn("u", vec.unit(F.col("v")))
    cross = vec.matvec(F.col("s"), F.array(*[F.lit(x) for x in _AXIS]))
    return f.withColumn("c", cross).select("event_id", r(vec.norm(F.col("v"))).alias("size"), *_three(F.col("c"), "c", 4), *[r(F.col(f"u.{k}")).alias(f"u{k}") for k in "xyz"])


@query("pose_vector_roundtrip", f"WITH {POSES} SELECT event_id, {_named('t', ('tx', 'ty', 'tz'))}, {', '.join(f'{rs(f'q{k} * (CASE WHEN qw < 0 THEN -1 ELSE 1 END)', 5)} AS q{k}' for k in 'xyzw')} FROM poses")
def pose_vector_roundtrip(spark, sf):
    p = poses(spark, sf).withColumn("v", P.from_vector(P.to_vector(F.col("pose"))))
    sign = F.when(F.col("v.q.w") < 0, -1.0).otherwise(1.0)
    return p.select("event_id", *[r(F.col(f"v.t.{k}")).alias(f"t{k}") for k in "xyz"], *[r(F.col(f"v.q.{k}") * sign, 5).alias(f"q{k}") for k in "xyzw"])


@query("camera_rays", f"{_IN} SELECT event_id, {_named('r', ('(tx - 320) / 500', '(ty - 240) / 500', '1'))}, {_named('p', ('(tx - 320) / 500 * (tz + 1)', '(ty - 240) / 500 * (tz + 1)', 'tz + 1'))}, {rs('2 * atan(320.0 / 500)', 5)} AS fov FROM frames")
def camera_rays(spark, sf):
    """Rays through pixels, points at a depth on them, and the field of view."""
    k = C.intrinsic(500, 500, 320, 240, h=480, w=640)
    f = frames(spark, sf).withColumn("r", C.ray(k, F.col("tx"), F.col("ty"))).withColumn("p", C.reconstruct(k, F.col("tx"), F.col("ty"), F.col("tz") + 1))
    return f.select("event_id", *[r(F.col(f"r.{c}")).alias(f"r{c}") for c in "xyz"], *[r(F.col(f"p.{c}")).alias(f"p{c}") for c in "xyz"], r(C.fov(k)["x"], 5).alias("fov"))
