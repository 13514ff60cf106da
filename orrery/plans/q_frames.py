"""Queries that write given rows as frame files and read them back through the frame source."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery import shared
from orrery.plans.fixtures import table
from orrery.plans.registry import query
from orrery.sources import frames

_POINTS = "WITH p AS (SELECT l_orderkey % 97 AS idx, row_number() OVER (PARTITION BY l_orderkey % 97 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS pt_idx, CAST(CAST(l_quantity AS FLOAT) AS DOUBLE) AS x, CAST(CAST(l_extendedprice AS FLOAT) AS DOUBLE) AS y, CAST(CAST(l_discount AS FLOAT) AS DOUBLE) AS z, CAST(CAST(l_tax AS FLOAT) AS DOUBLE) AS reflectance FROM lineitem)"


def _sweeps(spark, sf) -> str:
    """lineitem as 97 sweeps of points, a file each."""
    from pyspark.sql import Window

    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
    rows = table(spark, sf, "lineitem").withColumn("idx", F.col("l_orderkey") % 97)
    rows = rows.withColumn("pt_idx", F.row_number().over(Window.partitionBy("idx").orderBy(*order))).select("idx", "pt_idx", *[F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")])
    folder = shared.fresh(spark, "sweeps")
    frames.write(rows, folder, "idx", frames.lidar_content("pt_idx", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])).count()
    return folder


@query("frame_source_sweeps", f"{_POINTS} SELECT idx, CAST(pt_idx AS BIGINT) AS pt_idx, x, y, z, reflectance FROM p")
def frame_source_sweeps(spark, sf):
    """All points of all sweeps."""
    return frames.scan(spark, _sweeps(spark, sf), "lidar", size=1 << 18)


@query("frame_source_stride", f"{_POINTS} SELECT idx, count(*) AS n, max(y) AS top FROM p WHERE idx >= 5 AND (idx - 5) % 4 = 0 AND idx < 80 AND idx >= 20 GROUP BY idx")
def frame_source_stride(spark, sf):
    """Every fourth sweep from the fifth, and a filter that the source takes: no other file is opened."""
    return frames.scan(spark, _sweeps(spark, sf), "lidar", start=5, every=4, stop=80).where("idx >= 20").groupBy("idx").agg(F.count("*").alias("n"), F.max("y").alias("top"))


@query(
    "frame_source_stream",
    f"{_POINTS} SELECT idx, count(*) AS n, min(x) AS low, max(y) AS top FROM p GROUP BY idx",
)
def frame_source_stream(spark, sf):
    """The same sweeps taken as a stream of frames, summed by sweep."""
    folder, out = _sweeps(spark, sf), shared.fresh(spark, "stream")
    stream = frames.follow(spark, folder, "lidar")
    stream.writeStream.format("parquet").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start(f"{out}/rows").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows").groupBy("idx").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("y").alias("top"))


@query(
    "raw_frame_digests",
    "SELECT page_id AS idx, CAST(strlen(html) AS BIGINT) AS bytes, sha256(html) AS digest FROM pages",
)
def raw_frame_digests(spark, sf):
    """Pages written as numbered files and read whole."""
    folder = shared.fresh(spark, "raw")
    rows = table(spark, sf, "pages").select(F.col("page_id").alias("idx"), F.encode("html", "UTF-8").alias("html"))
    frames.write(rows, folder, "idx", lambda t: t.column("html")[0].as_py(), "page-%i.html").count()
    got = frames.scan(spark, folder, "raw", "page-%i.html")
    return got.select("idx", F.length("content").cast("bigint").alias("bytes"), F.sha2("content", 256).alias("digest"))


@query(
    "video_frames",
    """WITH f AS (SELECT p_partkey % 20 AS clip, p_partkey // 20 AS idx, p_size FROM part)
SELECT clip, CAST(row_number() OVER (PARTITION BY clip ORDER BY idx) - 1 AS BIGINT) AS idx, 6 AS h, 8 AS w, CAST(48 * (p_size % 200) + 24 * 7 * 8 // 8 AS BIGINT) AS light FROM f""",
)
def video_frames(spark, sf):
    """Clips of grey images written as video files, and each frame read by its place."""
    h, w = 6, 8
    level = (F.col("p_size") % 200).cast("int")
    # even places are the level, odd ones seven more
    data = F.unhex(F.array_join(F.flatten(F.array_repeat(F.array(F.lpad(F.hex(level), 2, "0"), F.lpad(F.hex(level + 7), 2, "0")), h * w // 2)), ""))
    rows = table(spark, sf, "part").select((F.col("p_partkey") % 20).alias("clip"), F.floor(F.col("p_partkey") / 20).alias("at"), F.struct(F.lit(h).alias("h"), F.lit(w).alias("w"), F.lit(1).alias("c"), data.alias("data")).alias("image"))
    folder = shared.fresh(spark, "clips")
    frames.write(rows, folder, "clip", frames.video_content("at"), "clip-%03d.y4m").count()
    got = frames.scan(spark, folder, "video", size=4096)
    pixels = F.hex("image.data")
    light = F.aggregate(F.sequence(F.lit(0), F.lit(h * w - 1)), F.lit(0).cast("bigint"), lambda a, i: a + F.conv(F.substring(pixels, (2 * i + 1).cast("int"), F.lit(2)), 16, 10).cast("bigint"))
    return got.select(F.regexp_extract("video", r"clip-(\d+)", 1).cast("bigint").alias("clip"), "idx", F.col("image.h").alias("h"), F.col("image.w").alias("w"), light.alias("light"))
