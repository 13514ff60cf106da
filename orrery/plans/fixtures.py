"""Derived inputs of the queries, as DataFrames and as the same SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions import pose as P

BOX_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]

BOXES = """boxes AS (SELECT l_orderkey % 500 AS image_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey % 500 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS BIGINT) AS box_id,
  CAST(l_partkey % 100 AS DOUBLE) AS x1, CAST(l_suppkey % 60 AS DOUBLE) AS y1, l_partkey % 100 + 20 + l_quantity AS x2,
  CAST(l_suppkey % 60 + 20 + l_linenumber * 10 AS DOUBLE) AS y2, l_discount AS score, l_returnflag AS label FROM lineitem),
truth AS (SELECT * FROM boxes WHERE box_id % 2 = 0), test AS (SELECT * FROM boxes WHERE box_id % 2 = 1)"""

K_SQL = "CAST(json_extract(props, '$.k') AS DOUBLE)"

FRAMES = f"""frames AS (SELECT user_id AS traj_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS idx, event_id,
  value AS tx, CAST(event_id % 50 AS DOUBLE) AS ty, CAST(event_id % 7 AS DOUBLE) AS tz,
  radians({K_SQL}) AS roll, radians({K_SQL} / 3) AS pitch, radians({K_SQL} - 50) AS yaw FROM events)"""

POSES = (
    FRAMES
    + """,
poses AS (SELECT traj_id, idx, event_id, tx, ty, tz,
  sin(roll/2)*cos(pitch/2)*cos(yaw/2) + cos(roll/2)*sin(pitch/2)*sin(yaw/2) AS qx,
  cos(roll/2)*sin(pitch/2)*cos(yaw/2) - sin(roll/2)*cos(pitch/2)*sin(yaw/2) AS qy,
  sin(roll/2)*sin(pitch/2)*cos(yaw/2) + cos(roll/2)*cos(pitch/2)*sin(yaw/2) AS qz,
  cos(roll/2)*cos(pitch/2)*cos(yaw/2) - sin(roll/2)*sin(pitch/2)*sin(yaw/2) AS qw FROM frames)"""
)


def rotate_sql(q: str, v: tuple[str, str, str], sign: int = 1) -> tuple[str, str, str]:
    """SQL of q v q*, with parts named {q}x etc.; sign -1 turns back."""
    x, y, z, w = (f"({sign} * {q}x)", f"({sign} * {q}y)", f"({sign} * {q}z)", f"{q}w")
    a, b, c = v
    return (
        f"((1 - 2*({y}*{y} + {z}*{z}))*{a} + 2*({x}*{y} - {z}*{w})*{b} + 2*({x}*{z} + {y}*{w})*{c})",
        f"(2*({x}*{y} + {z}*{w})*{a} + (1 - 2*({x}*{x} + {z}*{z}))*{b} + 2*({y}*{z} - {x}*{w})*{c})",
        f"(2*({x}*{z} - {y}*{w})*{a} + 2*({y}*{z} + {x}*{w})*{b} + (1 - 2*({x}*{x} + {y}*{y}))*{c})",
    )


def multiply_sql(a: str, b: str, sign: int = 1) -> tuple[str, str, str, str]:
    """SQL of the product a b, with a's vector part times sign."""
    ax, ay, az, aw = (f"({sign}*{a}x)", f"({sign}*{a}y)", f"({sign}*{a}z)", f"{a}w")
    return (
        f"({aw}*{b}x + {ax}*{b}w + {ay}*{b}z - {az}*{b}y)",
        f"({aw}*{b}y - {ax}*{b}z + {ay}*{b}w + {az}*{b}x)",
        f"({aw}*{b}z + {ax}*{b}y - {ay}*{b}x + {az}*{b}w)",
        f"({aw}*{b}w - {ax}*{b}x - {ay}*{b}y - {az}*{b}z)",
    )


def r(c: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def rs(sql: str, digits: int = 6) -> str:
    return f"round(CAST({sql} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE)"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    l_ = table(spark, sf, "lineitem")
    image = F.col("l_orderkey") % 500
    return l_.select(
        image.alias("image_id"),
        F.row_number().over(Window.partitionBy(image).orderBy(*BOX_ORDER)).cast("bigint").alias("box_id"),
        (F.col("l_partkey") % 100).cast("double").alias("x1"),
        (F.col("l_suppkey") % 60).cast("double").alias("y1"),
        (F.col("l_partkey") % 100 + 20 + F.col("l_quantity")).alias("x2"),
        (F.col("l_suppkey") % 60 + 20 + F.col("l_linenumber") * 10).cast("double").alias("y2"),
        F.col("l_discount").alias("score"),
        F.col("l_returnflag").alias("label"),
    )


def truth(spark: SparkSession, sf: str) -> DataFrame:
    return boxes(spark, sf).where("box_id % 2 = 0")


def test(spark: SparkSession, sf: str) -> DataFrame:
    return boxes(spark, sf).where("box_id % 2 = 1")


def frames(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    k = F.from_json("props", "k INT")["k"].cast("double")
    return e.select(
        F.col("user_id").alias("traj_id"),
        (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("bigint").alias("idx"),
        "event_id",
        F.col("value").alias("tx"),
        (F.col("event_id") % 50).cast("double").alias("ty"),
        (F.col("event_id") % 7).cast("double").alias("tz"),
        F.radians(k).alias("roll"),
        F.radians(k / 3).alias("pitch"),
        F.radians(k - 50).alias("yaw"),
    )


def poses(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf)
    return f.withColumn("pose", P.from_rpyxyz(F.col("roll"), F.col("pitch"), F.col("yaw"), F.col("tx"), F.col("ty"), F.col("tz"))).select("traj_id", "idx", "event_id", "pose")


def tracks(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("track_id"), F.col("event_id").alias("tick"), F.col("value").alias("x"), (F.col("event_id") % 50).cast("double").alias("y"))


TRACKS = "tracks AS (SELECT user_id AS track_id, event_id AS tick, value AS x, CAST(event_id % 50 AS DOUBLE) AS y FROM events)"


def ranked(spark: SparkSession, sf: str) -> DataFrame:
    """labels with documents: y = quality, p = toxic, score = n_chars."""
    return table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id").select("doc_id", F.col("quality").alias("y"), F.col("toxic").alias("p"), F.col("n_chars").alias("score"))


RANKED = "ranked AS (SELECT doc_id, quality AS y, toxic AS p, n_chars AS score FROM labels JOIN documents USING (doc_id))"
