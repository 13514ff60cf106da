"""Geometry queries over pose trajectories derived from events. Products of poses are staged, one withColumn each."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from orrery.functions import camera as C
from orrery.functions import euler, quat, vec
from orrery.functions import pose as P
from orrery.operators import linear as L
from orrery.operators import poses as PO
from orrery.plans.fixtures import FRAMES, POSES, frames, multiply_sql, poses, r, rotate_sql, rs, table
from orrery.plans.registry import query


def _v(*names):
    return vec.vec3(*[F.col(n) if isinstance(n, str) else n for n in names])


def _seven(df, col, digits=5):
    return df.select("traj_id", "idx", *[r(F.col(f"{col}.t.{k}"), digits).alias(f"t{k}") for k in "xyz"], *[r(F.col(f"{col}.q.{k}"), digits).alias(f"q{k}") for k in "xyzw"])


_ONE = f"WITH {POSES}"
_D = ("(b_tx - a_tx)", "(b_ty - a_ty)", "(b_tz - a_tz)")
_REL_T, _REL_Q = rotate_sql("a_q", _D, -1), multiply_sql("a_q", "b_q", -1)


def _between_sql(pairs: str) -> str:
    cols = ", ".join(f"{rs(e, 5)} AS {n}" for e, n in zip((*_REL_T, *_REL_Q), ("tx", "ty", "tz", "qx", "qy", "qz", "qw"), strict=True))
    return f"{_ONE}, p AS ({pairs}) SELECT traj_id, idx, {cols} FROM p"


_B = ", ".join(f"b.{c} AS b_{c}" for c in ("tx", "ty", "tz", "qx", "qy", "qz", "qw"))
_A = ", ".join(f"a.{c} AS a_{c}" for c in ("tx", "ty", "tz", "qx", "qy", "qz", "qw"))


@query("pose_relative", _between_sql(f"SELECT b.traj_id, b.idx, {_A}, {_B} FROM poses b JOIN poses a ON a.traj_id = b.traj_id AND a.idx = 0"))
def pose_relative(spark, sf):
    return _seven(PO.relative_to_first(poses(spark, sf), ["traj_id"], "idx"), "rel")


@query("pose_delta", _between_sql(f"SELECT b.traj_id, b.idx, {_A}, {_B} FROM poses b JOIN poses a ON a.traj_id = b.traj_id AND a.idx = b.idx - 1"))
def pose_delta(spark, sf):
    return _seven(PO.deltas(poses(spark, sf), ["traj_id"], "idx"), "delta")


_MOVED = rotate_sql("q", ("px", "py", "pz"))


@query(
    "pose_apply_points",
    f"""{_ONE}, pts AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS px, p_retailprice / 100 AS py, CAST(p_partkey % 11 AS DOUBLE) AS pz, CAST(p_partkey % 50 AS BIGINT) AS idx, CAST(p_partkey % 100 AS BIGINT) AS traj_id FROM part)
SELECT p_partkey, traj_id, {", ".join(f"{rs(f'{e} + t{k}', 5)} AS {k}" for e, k in zip(_MOVED, "xyz", strict=True))} FROM pts JOIN poses USING (traj_id, idx)""",
)
def pose_apply_points(spark, sf):
    pts = table(spark, sf, "part").select("p_partkey", vec.vec3(F.col("p_size"), F.col("p_retailprice") / 100, F.col("p_partkey") % 11).alias("p"), (F.col("p_partkey") % 50).cast("bigint").alias("idx"), (F.col("p_partkey") % 100).cast("bigint").alias("traj_id"))
    got = PO.apply_to_points(poses(spark, sf), pts, ["traj_id", "idx"])
    return got.select("p_partkey", "traj_id", *[r(F.col(f"moved.{k}"), 5).alias(k) for k in "xyz"])


@query("pose_inverse", f"{_ONE} SELECT traj_id, idx, {', '.join(f'{rs(f'-({e})', 5)} AS t{k}' for e, k in zip(rotate_sql('q', ('tx', 'ty', 'tz'), -1), 'xyz', strict=True))} FROM poses")
def pose_inverse(spark, sf):
    inv = poses(spark, sf).withColumn("inv", P.inverse(F.col("pose")))
    return inv.select("traj_id", "idx", *[r(F.col(f"inv.t.{k}"), 5).alias(f"t{k}") for k in "xyz"])


@query("quat_euler_roundtrip", f"WITH {FRAMES} SELECT event_id, {rs('roll', 5)} AS roll, {rs('pitch', 5)} AS pitch, {rs('yaw', 5)} AS yaw FROM frames WHERE abs(roll) < 1.5")
def quat_euler_roundtrip(spark, sf):
    f = frames(spark, sf).where(F.abs("roll") < 1.5).withColumn("q", euler.to_quat(F.col("roll"), F.col("pitch"), F.col("yaw"))).withColumn("e", euler.from_quat(F.col("q")))
    return f.select("event_id", *[r(F.col(f"e.{k}"), 5).alias(k) for k in ("roll", "pitch", "yaw")])


@query("quat_conventions", f"WITH {FRAMES} SELECT event_id, {rs('roll', 5)} AS roll, {rs('pitch', 5)} AS pitch, {rs('yaw', 5)} AS yaw, 'syxz' AS axes FROM frames WHERE abs(roll) < 1.5 UNION ALL SELECT event_id, {rs('roll', 5)}, {rs('pitch + 0.5', 5)}, {rs('yaw', 5)}, 'rzyz' FROM frames WHERE abs(roll) < 1.5")
def quat_conventions(spark, sf):
    """Angles out of matrices are the angles that went in, for three different axes and for a repeated one."""
    f = frames(spark, sf).where(F.abs("roll") < 1.5)
    out = None
    for axes, shift in (("syxz", 0.0), ("rzyz", 0.5)):
        got = f.withColumn("m", euler.to_matrix(F.col("roll"), F.col("pitch") + shift, F.col("yaw"), axes)).withColumn("e", euler.from_matrix(F.col("m"), axes))
        got = got.select("event_id", *[r(F.col(f"e.{k}"), 5).alias(k) for k in ("roll", "pitch", "yaw")], F.lit(axes).alias("axes"))
        out = got if out is None else out.unionByName(got)
    return out


_DOT = "(a_qx*b_qx + a_qy*b_qy + a_qz*b_qz + a_qw*b_qw)"


@query(
    "quat_slerp",
    f"""{_ONE}, p AS (SELECT b.traj_id, b.idx, {_A}, {_B} FROM poses b JOIN poses a ON a.traj_id = b.traj_id AND a.idx = b.idx - 1),
o AS (SELECT *, CASE WHEN {_DOT} < 0 THEN -1.0 ELSE 1.0 END AS f, acos(least(1.0, abs({_DOT}))) AS om FROM p),
w AS (SELECT *, CASE WHEN abs(sin(om)) < 1e-6 THEN 0.75 ELSE sin(0.75 * om) / sin(om) END AS wa, f * CASE WHEN abs(sin(om)) < 1e-6 THEN 0.25 ELSE sin(0.25 * om) / sin(om) END AS wb FROM o)
SELECT traj_id, idx, {", ".join(f"{rs(f'wa * a_q{k} + wb * b_q{k}', 5)} AS q{k}" for k in "xyzw")}, {", ".join(f"{rs(f'0.75 * a_t{k} + 0.25 * b_t{k}', 5)} AS t{k}" for k in "xyz")} FROM w""",
)
def quat_slerp(spark, sf):
    p = poses(spark, sf)
    a = p.select("traj_id", (F.col("idx") + 1).alias("idx"), F.col("pose").alias("a"))
    got = p.join(a, ["traj_id", "idx"]).withColumn("m", P.interpolate(F.col("a"), F.col("pose"), 0.25))
    return _seven(got, "m")


@query("quat_angle_axis", f"{_ONE} SELECT traj_id, idx, {rs('2 * acos(least(1.0, greatest(-1.0, qw)))', 5)} AS angle, {rs('qx / sin(acos(least(1.0, greatest(-1.0, qw))))', 4)} AS x FROM poses WHERE abs(qw) < 0.999")
def quat_angle_axis(spark, sf):
    a = poses(spark, sf).where(F.abs("pose.q.w") < 0.999).withColumn("a", quat.to_angle_axis(F.col("pose.q")))
    back = a.withColumn("q", quat.from_angle_axis(F.col("a.angle"), F.col("a.axis")))
    return back.where(F.abs(quat.dot(F.col("q"), F.col("pose.q"))) > 1 - 1e-9).select("traj_id", "idx", r(F.col("a.angle"), 5).alias("angle"), r(F.col("a.axis.x"), 4).alias("x"))


@query("quat_matrix_roundtrip", f"{_ONE} SELECT traj_id, idx, {rs('3 - 4 * (qx*qx + qy*qy + qz*qz)', 5)} AS trace FROM poses")
def quat_matrix_roundtrip(spark, sf):
    """To a matrix and back gives the same turn: rows where it doesn't are lost."""
    p = poses(spark, sf).withColumn("m", quat.to_matrix(F.col("pose.q"))).withColumn("q", quat.from_matrix(F.col("m")))
    same = F.abs(F.abs(quat.dot(F.col("q"), F.col("pose.q"))) - 1) < 1e-9
    return p.where(same).select("traj_id", "idx", r(F.col("m")[0][0] + F.col("m")[1][1] + F.col("m")[2][2], 5).alias("trace"))


@query("sim3_apply", f"{_ONE} SELECT traj_id, idx, {', '.join(f'{rs(f'2.5 * ({e}) + t{k}', 5)} AS {k}' for e, k in zip(rotate_sql('q', ('1.0', '2.0', '3.0')), 'xyz', strict=True))} FROM poses")
def sim3_apply(spark, sf):
    s = poses(spark, sf).withColumn("s", P.sim3(F.col("pose"), 2.5)).withColumn("x", P.sim3_apply(F.col("s"), vec.vec3(1, 2, 3)))
    return s.select("traj_id", "idx", *[r(F.col(f"x.{k}"), 5).alias(k) for k in "xyz"])


@query("dual_quaternion", f"{_ONE} SELECT traj_id, idx, {', '.join(f'{rs(f't{k}', 5)} AS t{k}' for k in 'xyz')} FROM poses")
def dual_quaternion(spark, sf):
    d = poses(spark, sf).withColumn("d", P.dual(F.col("pose"))).withColumn("p", P.from_dual(F.col("d")))
    return d.select("traj_id", "idx", *[r(F.col(f"p.t.{k}"), 5).alias(f"t{k}") for k in "xyz"])


@query("pose_row_roundtrip", f"{_ONE} SELECT traj_id, idx, {', '.join(f'{rs(f't{k}', 5)} AS t{k}' for k in 'xyz')} FROM poses")
def pose_row_roundtrip(spark, sf):
    """Through the twelve numbers of [R|t]."""
    p = poses(spark, sf).withColumn("row", P.to_row(F.col("pose"))).withColumn("p", P.from_row(F.col("row")))
    return p.where(F.abs(F.abs(quat.dot(F.col("p.q"), F.col("pose.q"))) - 1) < 1e-9).select("traj_id", "idx", *[r(F.col(f"p.t.{k}"), 5).alias(f"t{k}") for k in "xyz"])


_OX = "o AS (SELECT user_id AS traj_id, event_id AS idx, 48 + value / 1000 AS lat, 8 + (event_id % 97) / 1000.0::DOUBLE AS lon, 110 + CAST(event_id % 13 AS DOUBLE) AS alt FROM events), f AS (SELECT traj_id, cos(radians(arg_min(lat, idx))) AS s FROM o GROUP BY traj_id)"


@query("mercator_oxts", f"WITH {_OX} SELECT traj_id, idx, {rs('s * lon * pi() * 6378137 / 180', 3)} AS tx, {rs('s * 6378137 * ln(tan((90 + lat) * pi() / 360))', 3)} AS ty, {rs('alt', 3)} AS tz FROM o JOIN f USING (traj_id)")
def mercator_oxts(spark, sf):
    e = table(spark, sf, "events")
    z = F.lit(0.0)
    o = e.select(F.col("user_id").alias("traj_id"), F.col("event_id").alias("idx"), (48 + F.col("value") / 1000).alias("lat"), (8 + (F.col("event_id") % 97) / 1000.0).alias("lon"), (110 + (F.col("event_id") % 13).cast("double")).alias("alt"), z.alias("roll"), z.alias("pitch"), z.alias("yaw"))
    return PO.oxts(o, ["traj_id"], "idx").select("traj_id", "idx", *[r(F.col(f"pose.t.{k}"), 3).alias(f"t{k}") for k in "xyz"])


@query(
    "camera_from_directions",
    f"""WITH d AS (SELECT event_id, value AS x, CAST(event_id % 50 AS DOUBLE) + 1 AS y, 3.0::DOUBLE AS z, sqrt(value * value + (event_id % 50 + 1) * (event_id % 50 + 1) + 9) AS n FROM events),
u AS (SELECT event_id, x / n AS zx, y / n AS zy, z / n AS zz FROM d)
SELECT event_id, {rs("-zy")} AS xx, {rs("zx")} AS xy, {rs("zx")} AS zx FROM u""",
)
def camera_from_directions(spark, sf):
    """up is the z axis: x = up x z."""
    e = table(spark, sf, "events")
    d = e.select("event_id", P.camera_from_directions(vec.vec3(F.col("value"), F.col("event_id") % 50 + 1, 3), vec.vec3(0, 0, 1), vec.vec3(1, 2, 3)).alias("c"))
    return d.select("event_id", r(F.col("c.x.x")).alias("xx"), r(F.col("c.x.y")).alias("xy"), r(F.col("c.z.x")).alias("zx"))


# cameras: points of parts before a camera at the origin

_PTS = "pts AS (SELECT p_partkey, CAST(p_partkey % 41 - 20 AS DOUBLE) / 10 AS x, CAST(p_size % 31 - 15 AS DOUBLE) / 10 AS y, CAST(p_partkey % 17 AS DOUBLE) / 2 - 1 AS z FROM part)"


def _points(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", (((F.col("p_partkey") % 41) - 20).cast("double") / 10).alias("x"), (((F.col("p_size") % 31) - 15).cast("double") / 10).alias("y"), ((F.col("p_partkey") % 17).cast("double") / 2 - 1).alias("z"))


def _camera(k1=0.0, p1=0.0):
    return C.camera(C.intrinsic(500, 500, 320, 240, k1=k1, p1=p1, h=480, w=640))


_PROJ = f"""WITH {_PTS}, n AS (SELECT *, x / z AS a, y / z AS b, (x / z) * (x / z) + (y / z) * (y / z) AS r2 FROM pts WHERE z <> 0),
p AS (SELECT p_partkey, z, 500 * (a * (1 + 0.1 * r2) + 2 * 0.01 * a * b) + 320 AS u, 500 * (b * (1 + 0.1 * r2) + 0.01 * (r2 + 2 * b * b)) + 240 AS v FROM n)"""


@query("camera_project", f"{_PROJ} SELECT p_partkey, {rs('u + 1e-7', 5)} AS u, {rs('v + 1e-7', 5)} AS v, {rs('z')} AS depth, z >= 0.1 AND u >= 0 AND u < 640 AND v >= 0 AND v < 480 AS valid FROM p")
def camera_project(spark, sf):
    got = _points(spark, sf).where("z <> 0").withColumn("p", C.project(_camera(0.1, 0.01), _v("x", "y", "z")))
    return got.select("p_partkey", r(F.col("p.u") + 1e-7, 5).alias("u"), r(F.col("p.v") + 1e-7, 5).alias("v"), r(F.col("p.depth")).alias("depth"), F.col("p.valid").alias("valid"))


@query("camera_undistort", f"{_PROJ} SELECT n.p_partkey, {rs('500 * a + 320', 3)} AS u, {rs('500 * b + 240', 3)} AS v FROM n WHERE abs(a) < 0.5 AND abs(b) < 0.5")
def camera_undistort(spark, sf):
    """Distorted pixels go back to where the undistorted ones are."""
    pts = _points(spark, sf).where("z <> 0 AND abs(x / z) < 0.5 AND abs(y / z) < 0.5").withColumn("p", C.project(_camera(0.1, 0.01), _v("x", "y", "z")))
    got = pts.withColumn("q", C.undistort_point(_camera(0.1, 0.01)["intrinsic"], F.col("p.u"), F.col("p.v"), 25))
    return got.select("p_partkey", r(F.col("q.u"), 3).alias("u"), r(F.col("q.v"), 3).alias("v"))


@query("camera_visibility", f"WITH {_PTS} SELECT p_partkey, abs(atan2(x, z)) < atan(320 / 500.0::DOUBLE) AND abs(atan2(-y, z)) < atan(240 / 500.0::DOUBLE) AND z >= 0 AND z <= 6 AS visible FROM pts")
def camera_visibility(spark, sf):
    return _points(spark, sf).select("p_partkey", C.visible(_camera(), _v("x", "y", "z"), 0, 6).alias("visible"))


@query(
    "object_bbox",
    f"""{_PROJ}, o AS (SELECT p_partkey % 20 AS obj, p.* FROM p WHERE u >= 0 AND u < 640 AND v >= 0 AND v < 480),
a AS (SELECT obj, CAST(trunc(greatest(0, min(u))) AS BIGINT) AS x0, CAST(trunc(least(639, max(u))) AS BIGINT) AS x1, CAST(trunc(greatest(0, min(v))) AS BIGINT) AS y0, CAST(trunc(least(479, max(v))) AS BIGINT) AS y1, median(u) AS mu, median(v) AS mv, median(z) AS depth FROM o GROUP BY obj)
SELECT obj, x0, y0, x1, y1, {rs("depth", 5)} AS depth FROM a WHERE mu BETWEEN 0 AND 640 AND mv >= 0 AND mv < 480 AND y1 - y0 >= 10 AND x1 - x0 >= 10 AND depth >= 0""",
)
def object_bbox(spark, sf):
    got = _points(spark, sf).where("z <> 0").withColumn("p", C.project(_camera(0.1, 0.01), _v("x", "y", "z"))).select((F.col("p_partkey") % 20).alias("obj"), "p.*")
    inside = got.where("u >= 0 AND u < 640 AND v >= 0 AND v < 480")
    whole = lambda c, n: c.cast("bigint").alias(n)
    a = inside.groupBy("obj").agg(
        whole(F.greatest(F.lit(0.0), F.min("u")), "x0"), whole(F.greatest(F.lit(0.0), F.min("v")), "y0"), whole(F.least(F.lit(639.0), F.max("u")), "x1"), whole(F.least(F.lit(479.0), F.max("v")), "y1"),
        F.median("u").alias("mu"), F.median("v").alias("mv"), F.median("depth").alias("d"),
    )
    ok = F.col("mu").between(0, 640) & (F.col("mv") >= 0) & (F.col("mv") < 480) & (F.col("y1") - F.col("y0") >= 10) & (F.col("x1") - F.col("x0") >= 10) & (F.col("d") >= 0)
    return a.where(ok).select("obj", "x0", "y0", "x1", "y1", r(F.col("d"), 5).alias("depth"))


@query("median_depth", f"WITH {_PTS} SELECT p_partkey % 20 AS obj, {rs('median(z)', 5)} AS depth FROM pts GROUP BY 1")
def median_depth(spark, sf):
    return _points(spark, sf).groupBy((F.col("p_partkey") % 20).alias("obj")).agg(r(F.median("z"), 5).alias("depth"))


@query("discretized_projection", f"{_PROJ} SELECT CAST(floor(u / 4) AS BIGINT) AS cx, CAST(floor(v / 4) AS BIGINT) AS cy, {rs('min(z)', 5)} AS depth FROM p WHERE u >= 0 AND u < 640 AND v >= 0 AND v < 480 GROUP BY 1, 2")
def discretized_projection(spark, sf):
    """The nearest depth of each cell of the image."""
    got = _points(spark, sf).where("z <> 0").select(C.project(_camera(0.1, 0.01), _v("x", "y", "z")).alias("p")).select("p.*").where("u >= 0 AND u < 640 AND v >= 0 AND v < 480")
    return got.groupBy(F.floor(F.col("u") / 4).alias("cx"), F.floor(F.col("v") / 4).alias("cy")).agg(r(F.min("depth"), 5).alias("depth"))


@query("stereo_depth", f"SELECT s_suppkey, {rs('718.856 * 0.54 / (s_suppkey % 64 + 1)', 5)} AS depth, {rs('(185.2157 - s_suppkey % 300) / (-(s_suppkey % 64 + 1) / 0.54::DOUBLE)', 5)} AS y FROM supplier")
def stereo_depth(spark, sf):
    k = C.intrinsic(718.856, 718.856, 607.1928, 185.2157, h=376, w=1241)
    d, v = (F.col("s_suppkey") % 64 + 1).cast("double"), (F.col("s_suppkey") % 300).cast("double")
    got = table(spark, sf, "supplier").select("s_suppkey", C.depth_from_disparity(k["fx"], F.lit(0.54), d).alias("depth"), C.reconstruct_disparity(k, F.lit(0.54), F.lit(100.0), v, d).alias("p"))
    return got.select("s_suppkey", r(F.col("depth"), 5).alias("depth"), r(F.col("p.y"), 5).alias("y"))


@query("plane_disparity", f"SELECT event_id, {rs('718.856 * 0.54 / (1.65 * 718.856 / (event_id % 376 - 185.2157 + 1e-9))', 5)} AS disparity FROM events")
def plane_disparity(spark, sf):
    """The ground plane's disparity in the image row of each event."""
    k = C.intrinsic(718.856, 718.856, 607.1928, 185.2157, h=376, w=1241)
    return table(spark, sf, "events").select("event_id", r(C.disparity_of_plane(k, F.lit(0.54), F.col("event_id") % 376, F.lit(1.65)), 5).alias("disparity"))


@query("calib_range_join", "WITH c(lo, hi, fx, cx, cy) AS (VALUES (0, 2, 718.856::DOUBLE, 607.1928::DOUBLE, 185.2157::DOUBLE), (3, 3, 721.5377, 609.5593, 172.854), (4, 12, 707.0912, 601.8873, 183.1104)) SELECT s_suppkey, fx * 0.5 AS fx, cx * 0.5 AS cx, cy * 0.5 AS cy FROM supplier LEFT JOIN c ON s_suppkey % 15 BETWEEN lo AND hi")
def calib_range_join(spark, sf):
    from orrery.operators import zips
    from orrery.sources.calibration import stereo_calibrations

    s = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_suppkey") % 15).alias("seq"))
    got = zips.range_lookup(s, "seq", stereo_calibrations(spark))
    return got.select("s_suppkey", *[(F.col(c) * 0.5).alias(c) for c in ("fx", "cx", "cy")])


# two views: the second camera is moved along x and turned about y

_F2 = [[0.0, -1e-6, 2e-3], [1.5e-6, 0.0, -3e-3], [-2.5e-3, 3.2e-3, 0.1]]
_UV = "m AS (SELECT event_id, CAST(event_id % 640 AS DOUBLE) AS u1, CAST(event_id % 480 AS DOUBLE) AS v1, CAST(event_id % 640 AS DOUBLE) + value / 50 AS u2, CAST(event_id % 480 AS DOUBLE) + value / 200 AS v2 FROM events)"


def _f_sql(u: str, v: str) -> list[str]:
    return [f"({a} * {u} + {b} * {v} + {c})" for a, b, c in _F2]


_FA, _FB = _f_sql("u1", "v1"), _f_sql("u2", "v2")
_SAMPSON = f"power(u1 * {_FB[0]} + v1 * {_FB[1]} + {_FB[2]}, 2) / (power({_FA[0]}, 2) + power({_FA[1]}, 2) + power({_FB[0]}, 2) + power({_FB[1]}, 2))"


def _matches(spark, sf):
    e = table(spark, sf, "events")
    u, v = (F.col("event_id") % 640).cast("double"), (F.col("event_id") % 480).cast("double")
    one = F.lit(1.0)
    return e.select("event_id", F.array(u, v, one).alias("a"), F.array(u + F.col("value") / 50, v + F.col("value") / 200, one).alias("b"))


@query("sampson_filter", f"WITH {_UV} SELECT event_id, {rs(_SAMPSON, 2)} AS err FROM m WHERE abs({_SAMPSON}) < 4000")
def sampson_filter(spark, sf):
    got = _matches(spark, sf).withColumn("err", C.sampson(vec.matrix(_F2), F.col("a"), F.col("b")))
    return got.where(F.abs("err") < 4000).select("event_id", r(F.col("err"), 2).alias("err"))


_LINE = [f"({e} / sqrt(power({_FA[0]}, 2) + power({_FA[1]}, 2)))" for e in _FA]


@query("epipolar_lines", f"WITH {_UV} SELECT event_id, {rs(_LINE[0], 5)} AS a, {rs(_LINE[1], 5)} AS b, {rs(_LINE[2], 3)} AS c FROM m")
def epipolar_lines(spark, sf):
    got = _matches(spark, sf).withColumn("l", C.epipolar_line(vec.matrix(_F2), F.col("a")))
    return got.select("event_id", r(F.col("l")[0], 5).alias("a"), r(F.col("l")[1], 5).alias("b"), r(F.col("l")[2], 3).alias("c"))


@query("two_view_triangulation", f"WITH {_PTS} SELECT p_partkey, {', '.join(f'{rs(f'CASE WHEN z > 0.5 THEN {k} END', 4)} AS {k}' for k in 'xyz')}, CASE WHEN z > 0.5 THEN true END AS agrees FROM pts")
def two_view_triangulation(spark, sf):
    """Points come back from their two projections, and the fundamental matrix agrees with them; null for points too near or
    behind the cameras."""
    pts = _points(spark, sf)
    right = C.camera(_camera()["intrinsic"], P.pose(euler.to_quat(F.lit(0.0), F.lit(0.05), F.lit(0.0)), vec.vec3(-0.5, 0, 0)))
    # plain columns: each use would make projections and matrices again otherwise
    mats = L.held(pts, a=C.project(_camera(), _v("x", "y", "z")), b=C.project(right, _v("x", "y", "z")), pa=C.projection_matrix(_camera()), pb=C.projection_matrix(right))
    got = L.held(mats, deal=False, f=C.fundamental(F.col("pa"), F.col("pb"))).withColumn("t", L.triangulate(F.col("pa"), F.array("a.u", "a.v"), F.col("pb"), F.array("b.u", "b.v")))
    line = C.epipolar_line(F.col("f"), F.array(F.col("a.u"), F.col("a.v"), F.lit(1.0)))
    off = F.abs(vec.array_dot(line, F.array(F.col("b.u"), F.col("b.v"), F.lit(1.0))))
    seen = F.col("z") > 0.5
    return got.select("p_partkey", *[r(F.when(seen, F.col("t")[i]), 4).alias(k) for i, k in enumerate("xyz")], F.when(seen, off < 1e-3).alias("agrees"))


@query("frustum_containment", f"WITH {_PTS} SELECT p_partkey, CASE WHEN abs(abs(x) - 0.638 * z) > 1e-6 AND abs(abs(y) - 0.478 * z) > 1e-6 THEN z >= 0.5 AND z <= 5 AND abs(x) <= 0.638 * z AND abs(y) <= 0.478 * z END AS inside FROM pts")
def frustum_containment(spark, sf):
    edge = (F.abs(F.abs("x") - 0.638 * F.col("z")) > 1e-6) & (F.abs(F.abs("y") - 0.478 * F.col("z")) > 1e-6)
    got = _points(spark, sf).withColumn("planes", C.frustum_planes(C.frustum(P.identity(), 0.5, 5.0)))
    # on an edge rounding decides
    return got.select("p_partkey", F.when(edge, C.inside_planes(F.col("planes"), _v("x", "y", "z"))).alias("inside"))


_TURN = ", ".join(f"{e} AS {k}" for e, k in zip(multiply_sql("n.q", "l.q", -1), "xyzw", strict=True))


@query(
    "keyframe_sample",
    f"""WITH RECURSIVE {POSES}, few AS (SELECT * FROM poses),
walk AS (SELECT traj_id, idx, idx AS last FROM few WHERE idx = 0
 UNION ALL SELECT traj_id, idx, CASE WHEN d < 120 AND abs(atan2(2 * (x * w - y * z), 1 - 2 * (x * x + y * y))) < 0.6123 AND abs(asin(greatest(-1.0, least(1.0, 2 * (x * z + y * w))))) < 0.6123
   AND abs(atan2(2 * (z * w - x * y), 1 - 2 * (y * y + z * z))) < 0.6123 THEN last ELSE idx END
 FROM (SELECT n.traj_id, n.idx, k.last, sqrt(power(n.tx - l.tx, 2) + power(n.ty - l.ty, 2) + power(n.tz - l.tz, 2)) AS d, {_TURN}
   FROM walk k JOIN few n ON n.traj_id = k.traj_id AND n.idx = k.idx + 1 JOIN few l ON l.traj_id = k.traj_id AND l.idx = k.last) s)
SELECT traj_id, idx FROM walk WHERE idx = last""",
)
def keyframe_sample(spark, sf):
    """Gates by distance and turn from the last accepted pose."""
    few = PO.flat(poses(spark, sf)).drop("event_id")
    return PO.sample_poses(few, ["traj_id"], "idx", displacement=120.0, theta=0.6123, history=1).select("traj_id", "idx")


_HX, _HY, _HZ, _HW = multiply_sql("n.q", "h.q", -1)
_HROLL, _HPITCH, _HYAW = f"atan2(2 * ({_HX} * {_HW} - {_HY} * {_HZ}), 1 - 2 * ({_HX} * {_HX} + {_HY} * {_HY}))", f"asin(greatest(-1.0, least(1.0, 2 * ({_HX} * {_HZ} + {_HY} * {_HW}))))", f"atan2(2 * ({_HZ} * {_HW} - {_HX} * {_HY}), 1 - 2 * ({_HY} * {_HY} + {_HZ} * {_HZ}))"
_NEAR_PAST = f"sqrt(power(n.tx - h.tx, 2) + power(n.ty - h.ty, 2) + power(n.tz - h.tz, 2)) < 60 AND abs({_HROLL}) < radians(40) AND abs({_HPITCH}) < radians(40) AND abs({_HYAW}) < radians(40)"
_PAST = ", ".join(f"'{k}': {{0}}{k}" for k in ("tx", "ty", "tz", "qx", "qy", "qz", "qw"))


@query(
    "keyframe_sample_history",
    f"""WITH RECURSIVE {POSES}, few AS (SELECT * FROM poses),
walk AS (SELECT traj_id, idx, true AS kept, [{{{_PAST.format("")}}}] AS past FROM few WHERE idx = 0
 UNION ALL SELECT traj_id, idx, near = 0, CASE WHEN near = 0 THEN list_append(CASE WHEN len(past) >= 10 THEN past[2:] ELSE past END, item) ELSE past END
 FROM (SELECT n.traj_id, n.idx, k.past, {{{_PAST.format("n.")}}} AS item, len(list_filter(k.past, lambda h: {_NEAR_PAST})) AS near FROM walk k JOIN few n ON n.traj_id = k.traj_id AND n.idx = k.idx + 1) s)
SELECT traj_id, idx FROM walk WHERE kept""",
)
def keyframe_sample_history(spark, sf):
    few = PO.flat(poses(spark, sf)).drop("event_id")
    return PO.sample_poses(few, ["traj_id"], "idx", displacement=60.0, theta=math.radians(40), history=10).select("traj_id", "idx")


@query("noise_zero_identity", f"{_ONE} SELECT traj_id, idx, {', '.join(f'{rs(f't{k}', 4)} AS t{k}' for k in 'xyz')} FROM poses")
def noise_zero_identity(spark, sf):
    """Noise of no spread gives the trajectory back."""
    got = PO.inject_noise(PO.flat(poses(spark, sf)).drop("event_id"), ["traj_id"], "idx", [0.0, 0.0])
    return got.select("traj_id", "idx", *[r(F.col(f"t{k}"), 4).alias(f"t{k}") for k in "xyz"])


@query("point_alignment", f"WITH {FRAMES} SELECT traj_id, {rs('1.5', 4)} AS tx, {rs('-2.0', 4)} AS ty, {rs('0.25', 4)} AS tz, {rs('cos(0.3)', 4)} AS c, {rs('0', 4)} AS rmse FROM frames GROUP BY traj_id HAVING count(*) > 10")
def point_alignment(spark, sf):
    """A known motion comes back from pairs of points."""
    f = frames(spark, sf)
    q = quat.from_angle_axis(F.lit(0.3), vec.vec3(0, 0, 1))
    m = vec.add(quat.rotate(q, _v("tx", "ty", "tz")), vec.vec3(1.5, -2, 0.25))
    pairs = f.withColumn("m", m).select("traj_id", F.col("tx").alias("ax"), F.col("ty").alias("ay"), F.col("tz").alias("az"), F.col("m.x").alias("bx"), F.col("m.y").alias("by_"), F.col("m.z").alias("bz"))
    big = f.groupBy("traj_id").agg(F.count("*").alias("n")).where("n > 10").select("traj_id")
    got = PO.align(pairs.join(big, "traj_id"), ["traj_id"])
    return got.select("traj_id", *[r(F.col("t")[i], 4).alias(f"t{k}") for i, k in enumerate("xyz")], r(F.col("r")[0], 4).alias("c"), r(F.round(F.col("rmse"), 3), 4).alias("rmse"))


@query("pose_interpolate_at", f"{_ONE} SELECT a.traj_id, a.idx * 2 + 1 AS ts, {', '.join(f'{rs(f'(a.t{k} + b.t{k}) / 2', 5)} AS t{k}' for k in 'xyz')} FROM poses a JOIN poses b ON b.traj_id = a.traj_id AND b.idx = a.idx + 1")
def pose_interpolate_at(spark, sf):
    """Half way between each pose and the next."""
    p = poses(spark, sf)
    track = p.select("traj_id", (F.col("idx") * 2).alias("ts"), "pose")
    times = p.select("traj_id", (F.col("idx") * 2 + 1).alias("ts"))
    got = PO.interpolate_at(times, track, ["traj_id"], "ts").where("pose IS NOT NULL")
    return got.select("traj_id", "ts", *[r(F.col(f"pose.t.{k}"), 5).alias(f"t{k}") for k in "xyz"])


@query("matrix_builders", f"WITH {FRAMES} SELECT event_id, {rs('1 + 2 * cos(roll)', 5)} AS turn, {rs('1', 5)} AS mirror, {rs('2', 5)} AS plane, {rs('tan(pitch)', 4)} AS shear FROM frames WHERE abs(pitch) < 1.2")
def matrix_builders(spark, sf):
    """Traces and entries of turns, mirrors, projections and shears."""
    f = frames(spark, sf).where(F.abs("pitch") < 1.2)
    axis, at = vec.vec3(1, 2, 2), _v("tx", "ty", "tz")
    m = f.select("event_id", P.rotation_matrix(F.col("roll"), axis, at).alias("a"), P.reflection_matrix(at, axis).alias("b"), P.projection_matrix(at, axis).alias("c"), P.shear_matrix(F.col("pitch"), vec.vec3(1, 0, 0), at, vec.vec3(0, 1, 0)).alias("d"))
    trace = lambda c: F.col(c)[0][0] + F.col(c)[1][1] + F.col(c)[2][2]
    return m.select("event_id", r(trace("a"), 5).alias("turn"), r(trace("b"), 5).alias("mirror"), r(trace("c"), 5).alias("plane"), r(F.col("d")[0][1], 4).alias("shear"))
