"""Spark types of the engine's values."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*names: str, of: T.DataType | None = None) -> T.StructType:
    return T.StructType([T.StructField(n, of or T.DoubleType()) for n in names])


VEC3 = _struct("x", "y", "z")
QUAT = _struct("x", "y", "z", "w")
POSE = T.StructType([T.StructField("q", QUAT), T.StructField("t", VEC3)])
SIM3 = T.StructType([*POSE.fields, T.StructField("s", T.DoubleType())])
DUAL_QUAT = T.StructType([T.StructField("real", QUAT), T.StructField("dual", QUAT)])
INTRINSIC = T.StructType([*_struct("fx", "fy", "cx", "cy", "skew", "k1", "k2", "p1", "p2", "k3").fields, T.StructField("h", T.IntegerType()), T.StructField("w", T.IntegerType())])
CAMERA = T.StructType([T.StructField("intrinsic", INTRINSIC), T.StructField("pose", POSE)])
STEREO = T.StructType([T.StructField("left", CAMERA), T.StructField("right", CAMERA), T.StructField("baseline", T.DoubleType())])
BOX = _struct("x1", "y1", "x2", "y2")
OBSERVATION = T.StructType([T.StructField("track_id", T.LongType()), T.StructField("tick", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])

#: Viewer messages as rows of typed tables.
MESSAGES = {
    "pose": T.StructType([T.StructField("id", T.LongType()), T.StructField("utime", T.LongType()), T.StructField("pose", POSE)]),
    "object": T.StructType([T.StructField("collection", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("pose", POSE)]),
    "points": T.StructType([T.StructField("collection", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("element_id", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("points", T.ArrayType(VEC3)), T.StructField("colors", T.ArrayType(_struct("r", "g", "b")))]),
    "covariance": T.StructType([T.StructField("collection", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("entries", T.ArrayType(T.DoubleType()))]),
    "text": T.StructType([T.StructField("collection", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("object_id", T.LongType()), T.StructField("text", T.StringType())]),
    "reset": T.StructType([T.StructField("utime", T.LongType())]),
}
