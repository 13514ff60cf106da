"""Pinhole cameras as structs: intrinsics (fx, fy, cx, cy, skew, k1, k2, p1, p2, k3, h, w) and a pose.

World points go to the camera by the pose itself: X_c = R X + t.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from orrery.functions import pose as P
from orrery.functions import quat, vec


def _c(v, kind: str = "double") -> Column:
    return (v if isinstance(v, Column) else F.lit(v)).cast(kind)


def intrinsic(fx=500.0, fy=500.0, cx=319.5, cy=239.5, k1=0.0, k2=0.0, p1=0.0, p2=0.0, k3=0.0, h=None, w=None, skew=0.0) -> Column:
    names = dict(fx=fx, fy=fy, cx=cx, cy=cy, skew=skew, k1=k1, k2=k2, p1=p1, p2=p2, k3=k3)
    return F.struct(*[_c(v).alias(k) for k, v in names.items()], _c(h, "int").alias("h"), _c(w, "int").alias("w"))


def simulated() -> Column:
    return intrinsic(500, 500, 320, 240, h=480, w=640)


def from_fov(fov: Column, cx, cy, h=None, w=None) -> Column:
    return intrinsic(_c(cx) / F.tan(fov), _c(cy) / F.tan(fov), cx, cy, h=h, w=w)


def camera(k: Column, p: Column | None = None) -> Column:
    return F.struct(k.alias("intrinsic"), (p if p is not None else P.identity()).alias("pose"))


def K(k: Column) -> Column:
    def of(k: Column) -> Column:
        return vec.matrix([[k["fx"], k["skew"], k["cx"]], [0, k["fy"], k["cy"]], [0, 0, 1]])

    return vec.bind(of, k)


def D(k: Column) -> Column:
    return F.array(k["k1"], k["k2"], k["p1"], k["p2"], k["k3"])


def fov(k: Column) -> Column:
    def of(k: Column) -> Column:
        return F.struct((2 * F.atan(k["w"] / 2 / k["fx"])).alias("x"), (2 * F.atan(k["h"] / 2 / k["fy"])).alias("y"))

    return vec.bind(of, k)


def scaled(k: Column, s) -> Column:
    s = _c(s)
    return intrinsic(k["fx"] * s, k["fy"] * s, k["cx"] * s, k["cy"] * s, k["k1"], k["k2"], k["p1"], k["p2"], k["k3"], (k["h"] * s).cast("int"), (k["w"] * s).cast("int"), k["skew"])


def scale_camera(cam: Column, s) -> Column:
    return camera(scaled(cam["intrinsic"], s), cam["pose"])


def in_view(k: Column, u: Column, v: Column) -> Column:
    return (u >= 0) & (u < k["w"]) & (v >= 0) & (v < k["h"])


def finite_in_bounds(u: Column, v: Column, h, w) -> Column:
    """Finite and within the image; false for nulls."""
    inside = (u >= 0) & (u < w) & (v >= 0) & (v < h) & ~F.isnan(u) & ~F.isnan(v)
    return F.coalesce(inside, F.lit(False))


def distort(k: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """Radial and tangential distortion of normalised coordinates."""
    r2 = x * x + y * y
    radial = 1 + k["k1"] * r2 + k["k2"] * r2 * r2 + k["k3"] * r2 * r2 * r2
    return x * radial + 2 * k["p1"] * x * y + k["p2"] * (r2 + 2 * x * x), y * radial + k["p1"] * (r2 + 2 * y * y) + 2 * k["p2"] * x * y


def undistort_point(k: Column, u: Column, v: Column, rounds: int = 5) -> Column:
    """Pixel without distortion, by fixed-point steps. Each step is bound once, so expressions stay small."""
    x0, y0 = (u - k["cx"]) / k["fx"], (v - k["cy"]) / k["fy"]

    def step(p: Column) -> Column:
        x, y = p["x"], p["y"]
        r2 = x * x + y * y
        radial = 1 + k["k1"] * r2 + k["k2"] * r2 * r2 + k["k3"] * r2 * r2 * r2
        dx, dy = 2 * k["p1"] * x * y + k["p2"] * (r2 + 2 * x * x), k["p1"] * (r2 + 2 * y * y) + 2 * k["p2"] * x * y
        return F.struct(((x0 - dx) / radial).alias("x"), ((y0 - dy) / radial).alias("y"))

    last = F.aggregate(F.array_repeat(F.lit(0), rounds), F.struct(x0.alias("x"), y0.alias("y")), lambda p, _: step(p))
    return F.transform(F.array(last), lambda p: F.struct((p["x"] * k["fx"] + k["cx"]).alias("u"), (p["y"] * k["fy"] + k["cy"]).alias("v")))[0]


def project(cam: Column, point: Column, min_depth: float = 0.1) -> Column:
    """struct(u, v, depth, valid) of a world point. valid: in front of the camera by min_depth and inside the image;
    u and v are null for a depth of zero."""
    return vec.bind(lambda cam, point: _project(cam, point, min_depth), cam, point)


def _project(cam: Column, point: Column, min_depth: float) -> Column:
    k = cam["intrinsic"]

    def onto(c: Column) -> Column:
        def at(n: Column) -> Column:
            x, y = distort(k, n["x"], n["y"])
            u, v = k["fx"] * x + k["cx"], k["fy"] * y + k["cy"]
            return F.struct(u.alias("u"), v.alias("v"), c["z"].alias("depth"), F.coalesce((c["z"] >= min_depth) & in_view(k, u, v), F.lit(False)).alias("valid"))

        return F.transform(F.array(F.struct(F.try_divide(c["x"], c["z"]).alias("x"), F.try_divide(c["y"], c["z"]).alias("y"))), at)[0]

    return F.transform(F.array(P.apply(cam["pose"], point)), onto)[0]


def ray(k: Column, u: Column, v: Column, normalize: bool = False) -> Column:
    r = vec.vec3((u - k["cx"]) / k["fx"], (v - k["cy"]) / k["fy"], F.lit(1.0))
    return vec.unit(r) if normalize else r


def reconstruct(k: Column, u: Column, v: Column, depth: Column) -> Column:
    return vec.scale(ray(k, u, v), depth)


def visible(cam: Column, point: Column, zmin: float = 0.0, zmax: float = 100.0) -> Column:
    """Within half the field of view on both axes, and zmin <= depth <= zmax."""
    def of(cam: Column, point: Column) -> Column:
        c, angle = P.apply(cam["pose"], point), fov(cam["intrinsic"])
        return (F.abs(F.atan2(c["x"], c["z"])) < angle["x"] * 0.5) & (F.abs(F.atan2(-c["y"], c["z"])) < angle["y"] * 0.5) & (c["z"] >= zmin) & (c["z"] <= zmax)

    return vec.bind(of, cam, point)


def projection_matrix(cam: Column) -> Column:
    """P = K [R|t]."""
    return vec.matmul(K(cam["intrinsic"]), F.slice(P.to_matrix(cam["pose"]), 1, 3))


def center(cam: Column) -> Column:
    return P.inverse(cam["pose"])["t"]


def fundamental(p: Column, other: Column) -> Column:
    """Fundamental matrix of two 3x4 projection matrices, each entry a determinant of four of their rows."""
    def of(p: Column, other: Column) -> Column:
        rows = [(1, 2), (2, 0), (0, 1)]

        def det4(m: list[list[Column]]) -> Column:
            total = F.lit(0.0)
            for j in range(4):
                rest = [[m[r][c] for c in range(4) if c != j] for r in range(1, 4)]
                total = total + (1 if j % 2 == 0 else -1) * m[0][j] * vec.det3(rest)
            return total

        def entry(r: int, c: int) -> Column:
            return det4([[p[i][j] for j in range(4)] for i in rows[c]] + [[other[i][j] for j in range(4)] for i in rows[r]])

        return F.array(*[F.array(*[entry(r, c) for c in range(3)]) for r in range(3)])

    return vec.bind(of, p, other)


def essential_from_fundamental(f: Column, k: Column) -> Column:
    return vec.matmul(vec.matmul(vec.transpose(k), f), k)


def essential(cam: Column, other: Column | None = None) -> Column:
    """[t]x R of the pose of `other` as seen from cam; without other, of cam's own pose."""
    p = cam["pose"] if other is None else P.compose(other["pose"], P.inverse(cam["pose"]))
    return vec.matmul(vec.skew(p["t"]), quat.to_matrix(p["q"]))


def sampson(f: Column, a: Column, b: Column) -> Column:
    """(a' F b)^2 over the squared first two entries of F a and F b; a and b are homogeneous arrays."""
    def of(f: Column, a: Column, b: Column) -> Column:
        fa, fb = vec.matvec(f, a), vec.matvec(f, b)
        return vec.bind(lambda a, fa, fb: F.try_divide(F.pow(vec.array_dot(a, fb), F.lit(2.0)), fa[0] * fa[0] + fa[1] * fa[1] + fb[0] * fb[0] + fb[1] * fb[1]), a, fa, fb)

    return vec.bind(of, f, a, b)


def epipolar_line(f: Column, x: Column) -> Column:
    """F x scaled to a^2 + b^2 = 1."""
    return vec.bind(lambda v: F.transform(v, lambda e: F.try_divide(e, F.sqrt(v[0] * v[0] + v[1] * v[1]))), vec.matvec(f, x))


def line_ends(line: Column, width) -> Column:
    """(y at x = 0, y at x = width) of a line a x + b y + c = 0."""
    return F.struct(F.try_divide(-line[2], line[1]).alias("y0"), F.try_divide(-line[2] - line[0] * width, line[1]).alias("y1"))


# stereo and depth


def baseline_px(fx: Column, baseline: Column | None = None, px: Column | None = None) -> Column:
    none = F.lit(None).cast("double")
    return F.coalesce((baseline if baseline is not None else none) * fx, px if px is not None else none)


def stereo(left: Column, baseline) -> Column:
    shifted = P.compose(left["pose"], P.pose(quat.identity(), vec.vec3(baseline, 0, 0)))
    return F.struct(left.alias("left"), camera(left["intrinsic"], shifted).alias("right"), _c(baseline).alias("baseline"))


def Q(k: Column, baseline: Column) -> Column:
    return vec.matrix([[-1, 0, 0, k["cx"]], [0, -1, 0, k["cy"]], [0, 0, 0, -k["fx"]], [0, 0, -1 / baseline, 0]])


def depth_from_disparity(fx: Column, baseline, d: Column) -> Column:
    """Infinite where the disparity is zero; works as well from depth to disparity."""
    return F.when(d == 0, float("inf")).otherwise(fx * baseline / F.when(d != 0, d))


def disparity_of_plane(k: Column, baseline, row: Column, height) -> Column:
    z = height * k["fy"] / (row - k["cy"] + 1e-9)
    return k["fx"] * baseline / z


def reconstruct_disparity(k: Column, baseline: Column, u: Column, v: Column, d: Column) -> Column:
    """Q [u, v, d, 1] dehomogenised."""
    w = -d / baseline
    return vec.vec3(F.try_divide(k["cx"] - u, w), F.try_divide(k["cy"] - v, w), F.try_divide(-k["fx"], w))


def depth_point(k: Column, u: Column, v: Column, depth: Column, y_by_fx: bool = False) -> Column:
    """Pixel and depth to a point. y_by_fx divides y by fx, as older data may expect."""
    return vec.vec3((u - k["cx"]) / k["fx"] * depth, (v - k["cy"]) / (k["fx"] if y_by_fx else k["fy"]) * depth, depth)


# frustums

#: Half width and half height of a frustum at depth 1 (fixed values).
FRUSTUM_X, FRUSTUM_Y = 0.638, 0.478


def frustum(p: Column, zmin: float = 0.01, zmax: float = 0.1, fov_x: float | None = None) -> Column:
    """Eight corners, near then far: upper left, lower left, lower right, upper right. fov_x sets a square view instead of
    the fixed half sizes."""
    if zmin < 0.01 or (fov_x is not None and fov_x >= math.pi):
        raise ValueError("zmin must be 0.01 at least and the field of view below pi")
    rx, ry = (FRUSTUM_X, FRUSTUM_Y) if fov_x is None else (math.tan(fov_x / 2),) * 2
    corners = [(sx * rx * z, sy * ry * z, z) for z in (zmin, zmax) for sx, sy in ((-1, -1), (-1, 1), (1, 1), (1, -1))]
    return vec.bind(lambda p: F.array(*[P.apply(p, vec.vec3(*c)) for c in corners]), p)


def plane_through(p: Column, q: Column, r: Column) -> Column:
    """struct(normal, offset) with normal . x + offset = 0 for points of the plane."""
    def of(p: Column, q: Column, r: Column) -> Column:
        n = vec.unit(vec.cross(vec.sub(q, p), vec.sub(r, p)))
        return vec.bind(lambda n: F.struct(n.alias("normal"), (-vec.dot(n, p)).alias("offset")), n)

    return vec.bind(of, p, q, r)


#: Three corners of each side, so that the normals point outwards.
SIDES = [(0, 1, 2), (7, 6, 5), (0, 4, 5), (3, 2, 6), (0, 3, 7), (1, 5, 6)]


def frustum_planes(corners: Column) -> Column:
    def of(corners: Column) -> Column:
        return F.array(*[plane_through(corners[a], corners[b], corners[c]) for a, b, c in SIDES])

    return vec.bind(of, corners)


def inside_planes(planes: Column, point: Column, tol: float = 1e-12) -> Column:
    return F.forall(planes, lambda s: vec.dot(s["normal"], point) + s["offset"] <= tol)
