"""Camera queries: matrices, their factors, two-view geometry and stereo, each against its formula."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import camera as C
from orrery.functions import quat, vec
from orrery.functions import pose as P
from orrery.operators import linear as L
from orrery.plans.fixtures import FRAMES, POSES, frames, poses, r, rotate_sql, rs
from orrery.plans.registry import query

_IN = f"WITH {POSES}"
#: The camera's centre: the shift turned back.
_CENTRE = tuple(f"(-{e})" for e in rotate_sql("q", ("tx", "ty", "tz"), -1))
#: Entries of the rotation by a pose's quaternion, row by row.
_R = [rotate_sql("q", tuple("1" if i == j else "0" for j in range(3))) for i in range(3)]
_ROT = [[_R[j][i] for j in range(3)] for i in range(3)]


def _k():
    return C.intrinsic(500, 510, 320, 240, h=480, w=640)


def _cameras(spark, sf):
    return poses(spark, sf).withColumn("cam", C.camera(_k(), F.col("pose")))


@query("camera_intrinsics", f"WITH {FRAMES} SELECT event_id, {rs('400 + tx', 4)} AS fx, {rs('ty', 4)} AS skew, {rs('(400 + tx) / 2', 4)} AS half, CAST(240 AS INTEGER) AS h, {rs('0.1', 4)} AS k1, {rs('(400 + tx) * 0.54', 4)} AS px FROM frames")
def camera_intrinsics(spark, sf):
    """K, distortion, half the size, and the base line in pixels."""
    k = C.intrinsic(F.col("tx") + 400, 510, 320, 240, k1=0.1, h=480, w=640, skew=F.col("ty"))
    f = frames(spark, sf).withColumn("k", k).withColumn("m", C.K(F.col("k"))).withColumn("s", C.scaled(F.col("k"), 0.5)).withColumn("d", C.D(F.col("k")))
    return f.select("event_id", r(F.col("m")[0][0], 4).alias("fx"), r(F.col("m")[0][1], 4).alias("skew"), r(F.col("s.fx"), 4).alias("half"), F.col("s.h").alias("h"), r(F.col("d")[0], 4).alias("k1"), r(C.baseline_px(F.col("k.fx"), F.lit(0.54)), 4).alias("px"))


@query("camera_centres", f"{_IN} SELECT event_id, {', '.join(f'{rs(e, 4)} AS {k}' for e, k in zip(_CENTRE, 'xyz', strict=True))} FROM poses")
def camera_centres(spark, sf):
    got = _cameras(spark, sf).withColumn("c", C.center(F.col("cam")))
    return got.select("event_id", *[r(F.col(f"c.{k}"), 4).alias(k) for k in "xyz"])


@query("camera_factors", f"{_IN} SELECT event_id, {rs('500')} AS fx, {rs('510')} AS fy, {rs('320')} AS cx, {', '.join(f'{rs(_ROT[i][j], 5)} AS r{i}{j}' for i in range(3) for j in range(3))}, {', '.join(f'{rs(k, 4)} AS {k}' for k in ('tx', 'ty', 'tz'))} FROM poses")
def camera_factors(spark, sf):
    """A 3x4 projection falls apart into the matrices that it was made of."""
    got = L.held(_cameras(spark, sf), m=C.projection_matrix(F.col("cam"))).select("event_id", L.factor_projection(F.col("m")).alias("f"))
    turn = [r(F.col("f.r")[i][j], 5).alias(f"r{i}{j}") for i in range(3) for j in range(3)]
    return got.select("event_id", r(F.col("f.k")[0][0]).alias("fx"), r(F.col("f.k")[1][1]).alias("fy"), r(F.col("f.k")[0][2]).alias("cx"), *turn, *[r(F.col("f.t")[i], 4).alias(f"t{k}") for i, k in enumerate("xyz")])


_FAR = "abs(tx) + abs(ty) + abs(tz) > 1"


@query("essential_parts", f"{_IN} SELECT event_id, CASE WHEN {_FAR} THEN true END AS turn, {', '.join(f'{rs(f'CASE WHEN {_FAR} THEN abs({k}) / sqrt(tx * tx + ty * ty + tz * tz) END', 5)} AS {k}' for k in ('tx', 'ty', 'tz'))} FROM poses")
def essential_parts(spark, sf):
    """Of the two turns of an essential matrix one is the pose's; the step is known up to its length and sign, and unknown where
    there is hardly one."""
    far = F.expr("abs(pose.t.x) + abs(pose.t.y) + abs(pose.t.z) > 1")
    got = L.held(_cameras(spark, sf).withColumn("far", far), e=C.essential(F.col("cam")), rot=quat.to_matrix(F.col("pose.q"))).withColumn("d", L.decompose_essential(F.col("e")))
    is_turn = lambda c: F.forall(F.zip_with(F.flatten(F.col(c)), F.flatten("rot"), lambda a, b: F.abs(a - b) < 1e-6), lambda x: x)
    return got.select("event_id", F.when(F.col("far"), is_turn("d.r1") | is_turn("d.r2")).alias("turn"), *[r(F.when(F.col("far"), F.abs(F.col("d.t")[i])), 5).alias(f"t{k}") for i, k in enumerate("xyz")])


@query("epipoles", f"{_IN}, c AS (SELECT event_id, {', '.join(f'{e} AS {k}' for e, k in zip(_CENTRE, 'xyz', strict=True))} FROM poses) SELECT event_id, {rs('CASE WHEN abs(z) > 20 THEN 500 * x / z + 320 END', 2)} AS u, {rs('CASE WHEN abs(z) > 20 THEN 510 * y / z + 240 END', 2)} AS v FROM c")
def epipoles(spark, sf):
    """Where the first camera sees the centre of the second: the null vector of their fundamental matrix. Null for centres near
    the first camera's own plane, which it sees far outside or nowhere."""
    got = _cameras(spark, sf).withColumn("c", C.center(F.col("cam")))
    both = got.withColumn("p", C.projection_matrix(C.camera(_k()))).withColumn("q", C.projection_matrix(F.col("cam")))
    e = L.held(both, f=C.fundamental(F.col("p"), F.col("q"))).select("event_id", F.col("c.z").alias("z"), L.epipole(F.col("f")).alias("e"))
    return e.select("event_id", *[r(F.when(F.abs("z") > 20, F.col("e")[i]), 2).alias(n) for i, n in enumerate("uv")])


@query("frames_from_vectors", f"WITH {FRAMES} SELECT event_id, {rs('tx / sqrt(tx * tx + ty * ty + 1)', 5)} AS xx, {rs('ty / sqrt(tx * tx + ty * ty + 1)', 5)} AS xy, {rs('1 / sqrt(1 + ty * ty)', 5)} AS zy, {rs('-ty / sqrt(1 + ty * ty)', 5)} AS zz, {rs('0')} AS across FROM frames")
def frames_from_vectors(spark, sf):
    """x along (tx, ty, 1), z across it and the x axis reversed, y across both."""
    f = frames(spark, sf).withColumn("p", P.from_triad(vec.vec3(F.col("tx"), F.col("ty"), F.col("tz")), vec.vec3(F.col("tx"), F.col("ty"), 1.0), vec.vec3(-1.0, 0.0, 0.0)))
    m = f.withColumn("m", quat.to_matrix(F.col("p.q")))
    entry = lambda i, j: F.col("m")[i][j]
    across = F.abs(sum(entry(i, 0) * entry(i, 1) for i in range(3)))
    return m.select("event_id", r(entry(0, 0), 5).alias("xx"), r(entry(1, 0), 5).alias("xy"), r(-entry(1, 2), 5).alias("zy"), r(-entry(2, 2), 5).alias("zz"), r(across, 5).alias("across"))


@query("body_to_camera", f"WITH {FRAMES} SELECT event_id, {rs('-ty', 4)} AS x, {rs('-tz', 4)} AS y, {rs('tx + 1.65', 4)} AS z FROM frames")
def body_to_camera(spark, sf):
    """Places ahead, left and up of a body as a camera has them."""
    f = frames(spark, sf)
    v = P.apply(P.inverse(P.body_to_camera(0.0)), vec.vec3(F.col("tx"), F.col("ty"), F.col("tz")))
    return f.withColumn("v", v).select("event_id", r(F.col("v.x"), 4).alias("x"), r(F.col("v.y"), 4).alias("y"), r(F.col("v.z") + 1.65, 4).alias("z"))
