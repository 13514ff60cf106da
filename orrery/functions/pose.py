"""Rigid transforms (q, t), similarities (q, t, s), dual quaternions and 4x4 matrices."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from orrery.functions import euler, quat, vec


def pose(q: Column, t: Column) -> Column:
    return F.struct(q.alias("q"), t.alias("t"))


def identity() -> Column:
    return pose(quat.identity(), vec.vec3(0, 0, 0))


def from_rpyxyz(roll, pitch, yaw, x, y, z, axes: str = "rxyz") -> Column:
    return pose(euler.to_quat(roll, pitch, yaw, axes), vec.vec3(x, y, z))


def to_rpyxyz(p: Column, axes: str = "rxyz") -> Column:
    return vec.bind(lambda a, t: F.array(a["roll"], a["pitch"], a["yaw"], t["x"], t["y"], t["z"]), euler.from_quat(p["q"], axes), p["t"])


def apply(p: Column, v: Column) -> Column:
    def of(p: Column, v: Column) -> Column:
        return vec.add(quat.rotate(p["q"], v), p["t"])

    return vec.bind(of, p, v)


def compose(a: Column, b: Column) -> Column:
    def of(a: Column, b: Column) -> Column:
        return pose(quat.multiply(a["q"], b["q"]), apply(a, b["t"]))

    return vec.bind(of, a, b)


def inverse(p: Column) -> Column:
    def of(p: Column) -> Column:
        back = quat.conjugate(p["q"])
        return pose(back, quat.rotate(back, vec.scale(p["t"], -1.0)))

    return vec.bind(of, p)


def between(a: Column, b: Column) -> Column:
    """b as seen from a: inverse(a) composed with b, in one step of small expressions."""
    def of(a: Column, b: Column) -> Column:
        back = quat.conjugate(a["q"])
        return pose(quat.multiply(back, b["q"]), quat.rotate(back, vec.sub(b["t"], a["t"])))

    return vec.bind(of, a, b)


def interpolate(a: Column, b: Column, w, rotation_weight: str = "other") -> Column:
    """Weight w on b. rotation_weight='self' puts the rotation's weight on a, as older data may expect."""
    if rotation_weight not in ("other", "self"):
        raise ValueError("rotation_weight is 'other' or 'self'")
    w = w if isinstance(w, Column) else F.lit(float(w))
    u = w if rotation_weight == "other" else 1 - w
    t = vec.add(vec.scale(a["t"], 1 - w), vec.scale(b["t"], w))
    return pose(quat.slerp(a["q"], b["q"], u), t)


def to_matrix(p: Column) -> Column:
    def of(p: Column) -> Column:
        r = quat.matrix_entries(p["q"])
        return vec.matrix([[*r[0], p["t"]["x"]], [*r[1], p["t"]["y"]], [*r[2], p["t"]["z"]], [0, 0, 0, 1]])

    return vec.bind(of, p)


def from_matrix(m: Column) -> Column:
    def of(m: Column) -> Column:
        return pose(quat.from_matrix(m), vec.vec3(m[0][3], m[1][3], m[2][3]))

    return vec.bind(of, m)


def to_row(p: Column) -> Column:
    """The 12 numbers of [R|t] by rows."""
    return F.flatten(F.slice(to_matrix(p), 1, 3))


def from_row(a: Column) -> Column:
    """From 12 numbers of [R|t] by rows."""
    def of(a: Column) -> Column:
        return from_matrix(F.array(*[F.array(*[a[4 * i + j] for j in range(4)]) for i in range(3)]))

    return vec.bind(of, a)


def to_vector(p: Column) -> Column:
    def of(p: Column) -> Column:
        return F.array(p["t"]["x"], p["t"]["y"], p["t"]["z"], p["q"]["x"], p["q"]["y"], p["q"]["z"], p["q"]["w"])

    return vec.bind(of, p)


def from_vector(a: Column) -> Column:
    def of(a: Column) -> Column:
        return pose(quat.quat(a[3], a[4], a[5], a[6]), vec.vec3(a[0], a[1], a[2]))

    return vec.bind(of, a)


def from_angle_axis(angle: Column, axis: Column, t: Column) -> Column:
    return pose(quat.from_angle_axis(angle, axis), t)


def from_triad(at: Column, v1: Column, v2: Column) -> Column:
    """The frame of two vectors at a place: its axes are the rotation's columns."""
    f = vec.frame_from_two(v1, v2)
    m = F.array(*[F.array(f["x"][k], f["y"][k], f["z"][k]) for k in "xyz"])
    return pose(quat.from_matrix(m), at)


def turn_and_step(p: Column) -> Column:
    """struct(distance, roll, pitch, yaw) of a relative pose."""
    def of(p: Column) -> Column:
        a = euler.from_quat(p["q"])
        return F.struct(vec.norm(p["t"]).alias("distance"), a["roll"].alias("roll"), a["pitch"].alias("pitch"), a["yaw"].alias("yaw"))

    return vec.bind(of, p)


def camera_from_directions(direction: Column, up: Column, at: Column) -> Column:
    """z along the direction, x = up x z, y = z x x (x and y aren't scaled); the place is in thousandths."""
    def of(direction: Column, up: Column, at: Column) -> Column:
        z = vec.unit(direction)
        x = vec.cross(up, z)
        y = vec.cross(z, x)
        return F.struct(x.alias("x"), y.alias("y"), z.alias("z"), vec.scale(at, 0.001).alias("t"))

    return vec.bind(of, direction, up, at)


EARTH = 6378137.0


def mercator(lat: Column, lon: Column, alt: Column, scale: Column) -> Column:
    """Metres east, north and up by the Mercator projection; scale is the cosine of the first latitude."""
    return vec.vec3(scale * lon * math.pi * EARTH / 180, scale * EARTH * F.log(F.tan((90 + lat) * math.pi / 360)), alt)


def body_to_camera(height: float = 1.0) -> Column:
    """The constant transform from a body (x forward, z up) to a camera (z forward, y down) at a height."""
    return pose(euler.to_quat(F.lit(-math.pi / 2), F.lit(0.0), F.lit(-math.pi / 2), "sxyz"), vec.vec3(0, 0, height))


# similarities


def sim3(p: Column, s) -> Column:
    return F.struct(p["q"].alias("q"), p["t"].alias("t"), (s if isinstance(s, Column) else F.lit(float(s))).alias("s"))


def sim3_compose(a: Column, b: Column, keep_scale: bool = True) -> Column:
    t = vec.add(vec.scale(quat.rotate(a["q"], b["t"]), a["s"]), a["t"])
    p = pose(quat.multiply(a["q"], b["q"]), t)
    return sim3(p, a["s"] * b["s"]) if keep_scale else p


def sim3_apply(a: Column, v: Column) -> Column:
    def of(a: Column, v: Column) -> Column:
        return vec.add(vec.scale(quat.rotate(a["q"], v), a["s"]), a["t"])

    return vec.bind(of, a, v)


def sim3_inverse(a: Column) -> Column:
    def of(a: Column) -> Column:
        back = quat.conjugate(a["q"])
        s = F.try_divide(F.lit(1.0), a["s"])
        return sim3(pose(back, vec.scale(quat.rotate(back, a["t"]), -s)), s)

    return vec.bind(of, a)


# dual quaternions


def dual(p: Column) -> Column:
    """Real part q, dual part half of t q."""
    def of(p: Column) -> Column:
        t = quat.quat(p["t"]["x"], p["t"]["y"], p["t"]["z"], F.lit(0.0))
        d = quat.multiply(t, p["q"])
        return F.struct(p["q"].alias("real"), quat.quat(*[0.5 * d[k] for k in "xyzw"]).alias("dual"))

    return vec.bind(of, p)


def dual_multiply(a: Column, b: Column) -> Column:
    def of(a: Column, b: Column) -> Column:
        x, y = quat.multiply(a["real"], b["dual"]), quat.multiply(a["dual"], b["real"])
        return F.struct(quat.multiply(a["real"], b["real"]).alias("real"), quat.quat(*[x[k] + y[k] for k in "xyzw"]).alias("dual"))

    return vec.bind(of, a, b)


def dual_conjugate(a: Column) -> Column:
    return F.struct(quat.conjugate(a["real"]).alias("real"), quat.conjugate(a["dual"]).alias("dual"))


def from_dual(a: Column) -> Column:
    def of(a: Column) -> Column:
        t = quat.multiply(a["dual"], quat.conjugate(a["real"]))
        return pose(a["real"], vec.vec3(2 * t["x"], 2 * t["y"], 2 * t["z"]))

    return vec.bind(of, a)


# 4x4 builders


def translation_matrix(t: Column) -> Column:
    def of(t: Column) -> Column:
        return vec.matrix([[1, 0, 0, t["x"]], [0, 1, 0, t["y"]], [0, 0, 1, t["z"]], [0, 0, 0, 1]])

    return vec.bind(of, t)


def rotation_matrix(angle: Column, axis: Column, point: Column | None = None) -> Column:
    q = quat.from_angle_axis(angle, axis)
    t = vec.vec3(0, 0, 0) if point is None else vec.sub(point, quat.rotate(q, point))
    return to_matrix(pose(q, t))


def _outer(point: Column, axis: Column, factor) -> list[list[Column]]:
    """I - factor * axis axis' with the point held in place."""
    k = ["x", "y", "z"]
    shift = vec.dot(point, axis)
    return [[*[F.lit(1.0 if i == j else 0.0) - factor * axis[i] * axis[j] for j in k], factor * shift * axis[i]] for i in k]


def reflection_matrix(point: Column, normal: Column) -> Column:
    return vec.bind(lambda n, p: vec.matrix([*_outer(p, n, 2.0), [0, 0, 0, 1]]), vec.unit(normal), point)


def scale_matrix(factor: Column, origin: Column | None = None, direction: Column | None = None) -> Column:
    origin = vec.vec3(0, 0, 0) if origin is None else origin
    if direction is None:
        return vec.bind(lambda f, o: vec.matrix([[f, 0, 0, (1 - f) * o["x"]], [0, f, 0, (1 - f) * o["y"]], [0, 0, f, (1 - f) * o["z"]], [0, 0, 0, 1]]), factor, origin)
    return vec.bind(lambda f, o, d: vec.matrix([*_outer(o, d, 1 - f), [0, 0, 0, 1]]), factor, origin, vec.unit(direction))


def projection_matrix(point: Column, normal: Column, direction: Column | None = None, perspective: Column | None = None, pseudo: bool = False) -> Column:
    """Onto a plane: along its normal, along a direction, or towards a perspective point; with pseudo so that relative
    depth is kept (the orthogonal projection of its result is the plain perspective's)."""
    k = ["x", "y", "z"]
    if perspective is not None:

        def central(p: Column, n: Column, c: Column) -> Column:
            height, level = vec.dot(p, n), vec.dot(vec.sub(c, p), n)
            pull = {i: c[i] + n[i] if pseudo else c[i] for i in k}
            rows = [[*[(level if i == j else F.lit(0.0)) - pull[i] * n[j] for j in k], height * pull[i]] for i in k]
            return vec.matrix([*rows, [*[-n[j] for j in k], vec.dot(c, n)]])

        return vec.bind(central, point, vec.unit(normal), perspective)
    if direction is None:
        return vec.bind(lambda p, n: vec.matrix([*_outer(p, n, 1.0), [0, 0, 0, 1]]), point, vec.unit(normal))

    def oblique(p: Column, n: Column, d: Column) -> Column:
        along, shift = vec.dot(d, n), vec.dot(p, n)
        rows = [[*[F.lit(1.0 if i == j else 0.0) - d[i] * n[j] / along for j in k], d[i] * shift / along] for i in k]
        return vec.matrix([*rows, [0, 0, 0, 1]])

    return vec.bind(oblique, point, vec.unit(normal), direction)


def clip_matrix(left, right, bottom, top, near, far, perspective: bool = False) -> Column:
    """Frustum to normalised device coordinates. Raises at run time on inverted bounds."""
    l, r, b, t, n, f = (x if isinstance(x, Column) else F.lit(float(x)) for x in (left, right, bottom, top, near, far))
    ok = (l < r) & (b < t) & (n < f) & (F.lit(not perspective) | (n > 0))
    if perspective:
        m = vec.matrix([[-2 * n / (r - l), 0, (r + l) / (r - l), 0], [0, -2 * n / (t - b), (t + b) / (t - b), 0], [0, 0, -(f + n) / (f - n), 2 * f * n / (f - n)], [0, 0, -1, 0]])
    else:
        m = vec.matrix([[2 / (r - l), 0, 0, (r + l) / (l - r)], [0, 2 / (t - b), 0, (t + b) / (b - t)], [0, 0, 2 / (f - n), (f + n) / (n - f)], [0, 0, 0, 1]])
    return F.when(ok, m).otherwise(F.raise_error(F.lit("invalid frustum")).cast("array<array<double>>"))


def shear_matrix(angle: Column, direction: Column, point: Column, normal: Column) -> Column:
    """By an angle along a direction in the plane through a point; the direction is orthogonal to the normal."""

    def build(n: Column, d: Column, p: Column, s: Column) -> Column:
        k, shift = ["x", "y", "z"], vec.dot(p, n)
        return vec.matrix([*[[*[F.lit(1.0 if i == j else 0.0) + s * d[i] * n[j] for j in k], -s * shift * d[i]] for i in k], [0, 0, 0, 1]])

    return vec.bind(build, vec.unit(normal), vec.unit(direction), point, F.tan(angle))


def cell_matrix(a, b, c, alpha: Column, beta: Column, gamma: Column) -> Column:
    """Orthogonalisation of crystal cell lengths and angles (degrees)."""
    ca, cb, cg, sa, sb = F.cos(F.radians(alpha)), F.cos(F.radians(beta)), F.cos(F.radians(gamma)), F.sin(F.radians(alpha)), F.sin(F.radians(beta))
    co = (ca * cb - cg) / (sa * sb)
    return vec.matrix([[a * sb * F.sqrt(1 - co * co), 0, 0, 0], [-a * sb * co, b * sa, 0, 0], [a * cb, b * ca, c, 0], [0, 0, 0, 1]])
