"""Queries of meshes, clouds with texture, dragging over a ball, key points and small losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import arcball, quat, vec
from orrery.functions import camera as C
from orrery.operators import imaging as I
from orrery.operators import metrics as M
from orrery.operators import tracks as T
from orrery.plans.fixtures import r, rs, table
from orrery.plans.q_images import PIXELS, images
from orrery.plans.registry import query

_PLACES = "pts AS (SELECT s_suppkey // 25 AS picture, s_suppkey AS track_id, CAST(s_suppkey * 7919 % 1009 AS DOUBLE) AS x, CAST(s_suppkey * 104729 % 997 AS DOUBLE) AS y FROM supplier)"
#: Triples of a picture whose circumcircle holds no other place.
_TRIANGLES = (
    _PLACES
    + """,
triple AS (SELECT a.picture, a.track_id AS a, b.track_id AS b, c.track_id AS c, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, c.x AS cx, c.y AS cy,
  2 * (a.x * (b.y - c.y) + b.x * (c.y - a.y) + c.x * (a.y - b.y)) AS d
  FROM pts a JOIN pts b ON a.picture = b.picture AND a.track_id < b.track_id JOIN pts c ON c.picture = a.picture AND b.track_id < c.track_id),
circle AS (SELECT *, ((ax * ax + ay * ay) * (by_ - cy) + (bx * bx + by_ * by_) * (cy - ay) + (cx * cx + cy * cy) * (ay - by_)) / d AS ox,
  ((ax * ax + ay * ay) * (cx - bx) + (bx * bx + by_ * by_) * (ax - cx) + (cx * cx + cy * cy) * (bx - ax)) / d AS oy FROM triple WHERE d <> 0),
triangles AS (SELECT picture, a, b, c FROM circle k WHERE NOT EXISTS (SELECT 1 FROM pts p WHERE p.picture = k.picture AND p.track_id NOT IN (k.a, k.b, k.c)
  AND power(p.x - ox, 2) + power(p.y - oy, 2) < (power(ax - ox, 2) + power(ay - oy, 2)) * (1 - 1e-9)))"""
)


def _mesh(spark, sf):
    s, key = table(spark, sf, "supplier"), F.col("s_suppkey")
    pts = s.select(F.floor(key / 25).alias("picture"), key.alias("track_id"), (key * 7919 % 1009).cast("double").alias("x"), (key * 104729 % 997).cast("double").alias("y"))
    return T.mesh(pts, ["picture"])


@query("mesh_triangles", f"WITH {_TRIANGLES} SELECT picture, a, b, c FROM triangles")
def mesh_triangles(spark, sf):
    return _mesh(spark, sf)


@query("mesh_edges", f"WITH {_TRIANGLES} SELECT picture, a, b FROM triangles UNION SELECT picture, a, c FROM triangles UNION SELECT picture, b, c FROM triangles")
def mesh_edges(spark, sf):
    return T.mesh_edges(_mesh(spark, sf), ["picture"])


@query(
    "mesh_neighbours",
    f"WITH {_TRIANGLES}, e AS (SELECT picture, unnest([a, b, a, c, b, c]) AS track, unnest([b, a, c, a, c, b]) AS n FROM triangles) SELECT picture, track, array_to_string(list_sort(list(DISTINCT n)), ',') AS near FROM e GROUP BY ALL",
)
def mesh_neighbours(spark, sf):
    got = T.mesh_neighbours(_mesh(spark, sf), ["picture"])
    return got.select("picture", "track", F.array_join(F.transform("near", lambda x: x.cast("string")), ",").alias("near"))


@query(
    "depth_mesh",
    f"WITH {PIXELS} SELECT vec_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, {rs('(x - 3.5) / 5 * value')} AS px, {rs('(y - 3.5) / 5 * value')} AS py, value AS pz FROM pix WHERE x % 2 = 0 AND y % 2 = 0",
)
def depth_mesh(spark, sf):
    got = I.depth_mesh(I.pixels(images(spark, sf), ["vec_id"]), C.intrinsic(5, 5, 3.5, 3.5), 2)
    return got.select("vec_id", "x", "y", r(F.col("point.x")).alias("px"), r(F.col("point.y")).alias("py"), F.col("point.z").alias("pz"))


@query(
    "textured_points",
    f"WITH {PIXELS} SELECT vec_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, {rs('(x - 3.5) * 0.5 / (value + 1)')} AS px, {rs('(y - 3.5) * 0.5 / (value + 1)')} AS py, {rs('5 * 0.5 / (value + 1)')} AS pz, value AS texture FROM pix WHERE x % 2 = 0 AND y % 2 = 0",
)
def textured_points(spark, sf):
    """The picture as disparities (one more) and as texture."""
    both = images(spark, sf).select("vec_id", F.col("image").alias("disparity"), F.col("image").alias("texture"))
    got = I.textured_images(both, ["vec_id"], C.intrinsic(5, 5, 3.5, 3.5), F.lit(0.5), step=2, offset=1.0)
    return got.select("vec_id", "x", "y", *[r(F.col(f"point.{k}")).alias(f"p{k}") for k in "xyz"], "texture")


_BALL = """e AS (SELECT event_id, (value - 250) / 200 AS x, (200 - event_id % 400) / 200.0 AS y FROM events),
n AS (SELECT *, sqrt(x * x + y * y) AS n FROM e),
b AS (SELECT event_id, CASE WHEN n > 1 THEN x / n ELSE x END AS bx, CASE WHEN n > 1 THEN y / n ELSE y END AS by_, CASE WHEN n > 1 THEN 0 ELSE sqrt(1 - n * n) END AS bz FROM n)"""


def _ball(spark, sf):
    return table(spark, sf, "events").select("event_id", arcball.on_ball(F.col("value"), (F.col("event_id") % 400).cast("double"), 250.0, 200.0, 200.0).alias("b"))


@query("arcball_points", f"WITH {_BALL} SELECT event_id, {rs('bx')} AS x, {rs('by_')} AS y, {rs('bz')} AS z FROM b")
def arcball_points(spark, sf):
    return _ball(spark, sf).select("event_id", *[r(F.col(f"b.{k}")).alias(k) for k in "xyz"])


@query("arcball_drag", f"WITH {_BALL} SELECT event_id, {rs('-by_', 5)} AS qx, {rs('bx', 5)} AS qy, {rs('0')} AS qz, {rs('CASE WHEN bx * bx + by_ * by_ < 1e-15 THEN 1 ELSE bz END', 5)} AS qw FROM b")
def arcball_drag(spark, sf):
    """From the middle of the ball to each place."""
    q = arcball.drag(vec.vec3(0, 0, 1), F.col("b"), quat.identity())
    got = _ball(spark, sf).withColumn("q", q)
    return got.select("event_id", *[r(F.col(f"q.{k}"), 5).alias(f"q{k}") for k in "xyzw"])


@query("arcball_constrained", f"WITH {_BALL} SELECT event_id, {rs('CASE WHEN by_ * by_ + bz * bz > 1e-20 THEN 0 ELSE 0 END')} AS x, {rs('by_ / sqrt(by_ * by_ + bz * bz)', 5)} AS y, {rs('bz / sqrt(by_ * by_ + bz * bz)', 5)} AS z FROM b WHERE by_ * by_ + bz * bz > 1e-12")
def arcball_constrained(spark, sf):
    """Across the x axis."""
    got = _ball(spark, sf).where("b.y * b.y + b.z * b.z > 1e-12").withColumn("c", arcball.constrained(F.col("b"), vec.vec3(1, 0, 0)))
    return got.select("event_id", *[r(F.col(f"c.{k}"), 5).alias(k) for k in "xyz"])


@query("keypoints_roundtrip", "SELECT event_id, CAST(value AS FLOAT) AS x, CAST(event_id % 50 AS FLOAT) AS y FROM events")
def keypoints_roundtrip(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("value").alias("x"), (F.col("event_id") % 50).alias("y"))
    return I.keypoint_places(I.keypoints(e, 3.0))


@query("model_losses", f"SELECT event_type, {rs('avg(value)', 4)} AS identity, {rs('avg(1 - 1 / (1 + exp(-(value / 100 - 1))))', 6)} AS ranking FROM events GROUP BY event_type")
def model_losses(spark, sf):
    """The mean of a model's own loss, and of ranking losses."""
    e = table(spark, sf, "events")
    return e.groupBy("event_type").agg(r(M.identity_loss(F.col("value")), 4).alias("identity"), r(F.avg(M.bpr(F.col("value") / 100, F.lit(1.0)))).alias("ranking"))
