"""Queries of forms that larger ones are built of: parts of quaternions and poses, matrices, lines, bounds, pixels, times."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from orrery.functions import camera as C
from orrery.functions import pose as P
from orrery.functions import quat, text, vec
from orrery.operators import imaging
from orrery.operators import linear as L
from orrery.plans.fixtures import FRAMES, POSES, frames, poses, r, rotate_sql, rs, table
from orrery.plans.registry import query

_ROT = [[rotate_sql("q", tuple("1" if k == j else "0" for k in range(3)))[i] for j in range(3)] for i in range(3)]


@query("quaternion_parts", f"WITH {POSES} SELECT traj_id, idx, {', '.join(f'{rs(f'q{k}')} AS {k}' for k in 'xyzw')}, {rs('1')} AS size FROM poses")
def quaternion_parts(spark, sf):
    p = poses(spark, sf)
    return p.select("traj_id", "idx", *[r(F.col(f"pose.q.{k}")).alias(k) for k in "xyzw"], r(quat.norm(F.col("pose.q"))).alias("size"))


@query("pose_angles", f"WITH {FRAMES} SELECT event_id, {rs('roll', 5)} AS roll, {rs('pitch', 5)} AS pitch, {rs('yaw', 5)} AS yaw, {rs('tx', 5)} AS tx, {rs('sqrt(tx * tx + ty * ty + tz * tz)', 5)} AS distance FROM frames")
def pose_angles(spark, sf):
    """The three angles and the place that a pose was made of, and how far it is."""
    p = poses(spark, sf).select("event_id", P.to_rpyxyz(F.col("pose")).alias("a"), P.turn_and_step(F.col("pose")).alias("s"))
    return p.select("event_id", *[r(F.col("a")[i], 5).alias(n) for i, n in enumerate(("roll", "pitch", "yaw", "tx"))], r(F.col("s.distance"), 5).alias("distance"))


_U = "u AS (SELECT event_id, (event_id % 97) / 97.0::DOUBLE AS r1, (event_id % 89) / 89.0::DOUBLE AS r2, (event_id % 83) / 83.0::DOUBLE AS r3 FROM events)"


@query("uniform_rotations", f"WITH {_U} SELECT event_id, {rs(f'sin(2 * {math.pi!r}::DOUBLE * r2) * sqrt(1 - r1)', 5)} AS x, {rs(f'cos(2 * {math.pi!r}::DOUBLE * r2) * sqrt(1 - r1)', 5)} AS y, {rs(f'sin(2 * {math.pi!r}::DOUBLE * r3) * sqrt(r1)', 5)} AS z, {rs(f'cos(2 * {math.pi!r}::DOUBLE * r3) * sqrt(r1)', 5)} AS w FROM u")
def uniform_rotations(spark, sf):
    """Rotations from three numbers each."""
    part = lambda n: (F.col("event_id") % n) / float(n)
    q = table(spark, sf, "events").select("event_id", quat.uniform(part(97), part(89), part(83)).alias("q"))
    return q.select("event_id", *[r(F.col(f"q.{k}"), 5).alias(k) for k in "xyzw"])


_CLIP = "b AS (SELECT event_id, -1.0::DOUBLE - event_id % 3 AS l, 2.0::DOUBLE + event_id % 5 AS r, 0.5::DOUBLE + event_id % 7 AS n, 20.0::DOUBLE + event_id % 11 AS f FROM events)"


@query("clip_matrices", f"WITH {_CLIP} SELECT event_id, {rs('-2 * n / (r - l)')} AS p00, {rs('(r + l) / (r - l)')} AS p02, {rs('-(f + n) / (f - n)')} AS p22, {rs('2 * f * n / (f - n)')} AS p23, {rs('2 / (r - l)')} AS o00, {rs('(r + l) / (l - r)')} AS o03, {rs('(f + n) / (n - f)')} AS o23 FROM b")
def clip_matrices(spark, sf):
    """Frustums, in perspective and orthographic."""
    e = F.col("event_id")
    sides = (-1.0 - e % 3, 2.0 + e % 5, F.lit(-1.0), F.lit(1.0), 0.5 + e % 7, 20.0 + e % 11)
    m = table(spark, sf, "events").select("event_id", P.clip_matrix(*sides, perspective=True).alias("p"), P.clip_matrix(*sides).alias("o"))
    return m.select("event_id", *[r(F.col(c)[i][j]).alias(f"{c}{i}{j}") for c, i, j in (("p", 0, 0), ("p", 0, 2), ("p", 2, 2), ("p", 2, 3), ("o", 0, 0), ("o", 0, 3), ("o", 2, 3))])


_CELL = "c AS (SELECT event_id, 10 + event_id % 5 AS a, 12.0::DOUBLE AS b, 15.0::DOUBLE AS c, radians(80 + event_id % 20) AS al, radians(85 + event_id % 9) AS be, radians(95.0::DOUBLE) AS ga FROM events), k AS (SELECT *, (cos(al) * cos(be) - cos(ga)) / (sin(al) * sin(be)) AS co FROM c)"


@query("cell_matrices", f"WITH {_CELL} SELECT event_id, {rs('a * sin(be) * sqrt(1 - co * co)')} AS m00, {rs('-a * sin(be) * co')} AS m10, {rs('b * sin(al)')} AS m11, {rs('a * cos(be)')} AS m20, {rs('b * cos(al)')} AS m21, {rs('c')} AS m22 FROM k")
def cell_matrices(spark, sf):
    """Crystal cells made orthogonal."""
    e = F.col("event_id")
    deg = lambda c: c.cast("double")
    m = table(spark, sf, "events").select("event_id", P.cell_matrix((10 + e % 5).cast("double"), F.lit(12.0), F.lit(15.0), deg(80 + e % 20), deg(85 + e % 9), F.lit(95.0)).alias("m"))
    return m.select("event_id", *[r(F.col("m")[i][j]).alias(f"m{i}{j}") for i, j in ((0, 0), (1, 0), (1, 1), (2, 0), (2, 1), (2, 2))])


@query("same_transforms", f"WITH {POSES} SELECT event_id, event_id % 3 <> 1 AS same FROM poses")
def same_transforms(spark, sf):
    """Matrices are the same up to a factor; a moved one isn't."""
    p = poses(spark, sf)
    m = P.to_matrix(F.col("pose"))
    factor, shift = F.when(F.col("event_id") % 3 == 2, 2.5).otherwise(1.0), F.when(F.col("event_id") % 3 == 1, 0.01).otherwise(0.0)
    other = F.transform(m, lambda row, i: F.transform(row, lambda v, j: (v + F.when((i == 0) & (j == 1), shift).otherwise(0.0)) * factor))
    return p.select("event_id", vec.same_transform(m, other).alias("same"))


@query("line_ends", f"WITH l AS (SELECT event_id, event_id % 7 - 3 AS a, 1 + event_id % 5 AS b, value AS c FROM events) SELECT event_id, {rs('-c / b', 5)} AS y0, {rs('(-c - a * 640) / b', 5)} AS y1 FROM l")
def line_ends(spark, sf):
    """Where lines cross an image's left and right edge."""
    e = F.col("event_id")
    line = F.array((e % 7 - 3).cast("double"), (1 + e % 5).cast("double"), F.col("value"))
    got = table(spark, sf, "events").select("event_id", C.line_ends(line, F.lit(640)).alias("l"))
    return got.select("event_id", r(F.col("l.y0"), 5).alias("y0"), r(F.col("l.y1"), 5).alias("y1"))


@query("stereo_reprojection", f"SELECT s_suppkey, {rs('CAST(320 AS DOUBLE)')} AS cx, {rs('-(500 + s_suppkey)')} AS fx, {rs('-1 / (0.1::DOUBLE + s_nationkey)')} AS inverse FROM supplier")
def stereo_reprojection(spark, sf):
    """The matrix from disparities to places."""
    k = C.intrinsic((500 + F.col("s_suppkey")).cast("double"), F.lit(510.0), F.lit(320.0), F.lit(240.0), h=480, w=640)
    q = table(spark, sf, "supplier").select("s_suppkey", C.Q(k, F.col("s_nationkey") + 0.1).alias("q"))
    return q.select("s_suppkey", r(F.col("q")[0][3]).alias("cx"), r(F.col("q")[2][3]).alias("fx"), r(F.col("q")[3][2]).alias("inverse"))


@query("finite_pixels", "SELECT event_id, event_id % 5 <> 0 AND event_id % 7 <> 0 AND value < 100 AND event_id % 50 < 40 AS ok FROM events")
def finite_pixels(spark, sf):
    """Places that are numbers and inside the image; not a number and null are outside."""
    e = F.col("event_id")
    u = F.when(e % 5 == 0, float("nan")).when(e % 7 == 0, F.lit(None)).otherwise(F.col("value"))
    return table(spark, sf, "events").select("event_id", C.finite_in_bounds(u, (e % 50).cast("double"), F.lit(40), F.lit(100)).alias("ok"))


_FM = [[1e-6, -2e-5, 3e-3], [4e-5, 5e-6, -6e-3], [-7e-3, 8e-3, 0.9]]
_KM = [["(500 + s_suppkey)", "0", "320"], ["0", "510", "240"], ["0", "0", "1"]]
_e_sql = lambda i, j: " + ".join(f"{_KM[a][i]} * ({_FM[a][b]!r}::DOUBLE) * {_KM[b][j]}" for a in range(3) for b in range(3))


@query("essential_of_fundamental", f"SELECT s_suppkey, {', '.join(f'{rs(_e_sql(i, j), 4)} AS e{i}{j}' for i in range(3) for j in range(3))} FROM supplier")
def essential_of_fundamental(spark, sf):
    k = C.K(C.intrinsic((500 + F.col("s_suppkey")).cast("double"), F.lit(510.0), F.lit(320.0), F.lit(240.0), h=480, w=640))
    m = table(spark, sf, "supplier").select("s_suppkey", C.essential_from_fundamental(vec.matrix(_FM), k).alias("e"))
    return m.select("s_suppkey", *[r(F.col("e")[i][j], 4).alias(f"e{i}{j}") for i in range(3) for j in range(3)])


@query("essential_of_poses", f"WITH {POSES} SELECT event_id, {', '.join(f'{rs(f'-tz * {_ROT[1][j]} + ty * {_ROT[2][j]}', 4)} AS e0{j}' for j in range(3))} FROM poses")
def essential_of_poses(spark, sf):
    """The first row of a pose's essential matrix."""
    cam = C.camera(C.intrinsic(500, 510, 320, 240, h=480, w=640), F.col("pose"))
    m = poses(spark, sf).select("event_id", C.essential(cam).alias("e"))
    return m.select("event_id", *[r(F.col("e")[0][j], 4).alias(f"e0{j}") for j in range(3)])


@query("fundamental_of_matches", "SELECT p_partkey % 20 AS views, CAST(count(*) AS BIGINT) AS inliers, CAST(count(*) AS BIGINT) AS near FROM part GROUP BY ALL HAVING count(*) >= 8")
def fundamental_of_matches(spark, sf):
    """Views of points in space by two cameras: the matrix found explains all matches of each pair of views."""
    k = F.col("p_partkey")
    x, y, z = (k * 37 % 101) / 10.0 - 5, (k * 53 % 89) / 10.0 - 4, 8 + (k * 71 % 67) / 10.0 + F.col("p_size") / 20
    turn, shift = 0.1, 1 + (k % 20) / 10.0
    x2, z2 = math.cos(turn) * x + math.sin(turn) * z + shift, -math.sin(turn) * x + math.cos(turn) * z
    p = table(spark, sf, "part").select((k % 20).alias("views"), (500 * x / z + 320).alias("u1"), (500 * y / z + 240).alias("v1"), (500 * x2 / z2 + 320).alias("u2"), (500 * y / z2 + 240).alias("v2"))
    f = L.fundamental(p, ["views"], method="eight point")
    a, b = F.array("u1", "v1", F.lit(1.0)), F.array("u2", "v2", F.lit(1.0))
    near = p.join(f, "views").groupBy("views", "inliers").agg(F.count_if(C.sampson(F.col("f"), b, a) < 1e-6).alias("near"))
    return near.select("views", "inliers", "near")


@F.pandas_udf(imaging.IMAGE)
def _plain(b: pd.Series, g: pd.Series, red: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([imaging.encode(np.tile(np.array(c, np.uint8), (3, 4, 1))) for c in zip(b, g, red, strict=True)], columns=imaging.IMAGE.names)


_pixel = lambda c, n: F.conv(F.hex(F.substring(f"{c}.data", n, 1)), 16, 10).cast("int")


@query("grey_images", "SELECT s_suppkey, 1 AS channels, CAST(round(0.114::DOUBLE * (s_suppkey % 200) + 0.587::DOUBLE * (s_nationkey * 9) + 0.299::DOUBLE * 77) AS INT) AS grey, 77 AS flipped FROM supplier")
def grey_images(spark, sf):
    """Images in grey, and with their channels the other way round."""
    s = table(spark, sf, "supplier").select("s_suppkey", _plain((F.col("s_suppkey") % 200).cast("int"), (F.col("s_nationkey") * 9).cast("int"), F.lit(77)).alias("image"))
    got = imaging.apply(imaging.apply(s, imaging.gray_levels, name="grey"), imaging.flip_channels, name="back")
    return got.select("s_suppkey", F.col("grey.c").alias("channels"), _pixel("grey", 12).alias("grey"), _pixel("back", 1).alias("flipped"))


@query("human_times", "SELECT event_id, CASE WHEN value + 0.001 > 60 THEN printf('%4.2f min', (value + 0.001) / 60) ELSE printf('%4.2f s', value + 0.001) END AS told FROM events")
def human_times(spark, sf):
    return table(spark, sf, "events").select("event_id", text.human_time(F.col("value") + 0.001).alias("told"))
