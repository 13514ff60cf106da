"""Queries of dense motion, its pictures, and regions of images."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.operators import denseflow, imaging, proposals
from orrery.plans.fixtures import table
from orrery.plans.registry import query

H, W = 40, 56


def _dealt(keys, by):
    """Keys of a small file over many tasks, before images are made of them."""
    session = keys.sparkSession
    return keys.repartition(max(session.sparkContext.defaultParallelism * 4, int(session.conf.get("spark.sql.shuffle.partitions"))), by)


@F.pandas_udf(imaging.IMAGE)
def _scene(key: pd.Series, dx: pd.Series, dy: pd.Series) -> pd.DataFrame:
    """A smooth pattern of each key, moved."""
    y, x = np.mgrid[:H, :W].astype(float)
    rows = []
    for k, u, v in zip(key, dx, dy, strict=True):
        rng = np.random.default_rng(int(k))
        a, b, c = rng.uniform(-0.5, 0.5, 10), rng.uniform(-0.5, 0.5, 10), rng.uniform(0, 7, 10)
        rows.append(imaging.encode(128 + 11 * sum(np.sin(a[i] * (x - u) + b[i] * (y - v) + c[i]) for i in range(10))))
    return pd.DataFrame(rows, columns=imaging.IMAGE.names)


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in ("dx", "dy")]))
def _median(f: pd.DataFrame) -> pd.DataFrame:
    inner = [np.nanmedian(denseflow.decode(r)[8:-8, 8:-8], (0, 1)) for r in f.to_dict("records")]
    return pd.DataFrame(np.rint(inner).astype(np.int64), columns=["dx", "dy"])


@query("dense_flow_steps", "SELECT s_suppkey, CAST(t AS BIGINT) AS t, CAST(s_suppkey % 7 - 3 AS BIGINT) AS dx, CAST(s_suppkey % 5 - 2 AS BIGINT) AS dy FROM supplier, range(2) r(t)")
def dense_flow_steps(spark, sf):
    """Each supplier's pattern moves by its own step from frame to frame; the median of the dense motion is the step."""
    s = _dealt(table(spark, sf, "supplier").select("s_suppkey"), "s_suppkey").select("s_suppkey", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))).alias("t"))
    step = lambda n: F.col("t") * (F.col("s_suppkey") % n - n // 2)
    frames = s.withColumn("image", _scene("s_suppkey", step(7).cast("double"), step(5).cast("double")))
    got = denseflow.between_frames(frames, ["s_suppkey"], "t", levels=2).where("flow IS NOT NULL")
    return got.select("s_suppkey", "t", _median("flow").alias("m")).select("s_suppkey", "t", "m.dx", "m.dy")


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in ("blue", "green", "red")]))
def _colour(dx: pd.Series, dy: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(denseflow.colours(np.stack([dx, dy], -1)[:, None, :])[:, 0].astype(np.int64), columns=["blue", "green", "red"])


_CH = lambda e: f"CAST(round(greatest(least({e}, 1), 0) * v) AS BIGINT)"


@query(
    "flow_colours",
    f"""WITH f AS (SELECT event_id, value / 10 - 5.0037 AS dx, CAST(event_id % 41 - 20 AS DOUBLE) AS dy FROM events), h AS (SELECT event_id, (degrees(atan2(dy, dx)) + 180) / 60 AS s, least(sqrt(dx * dx + dy * dy) * 4, 255) AS v FROM f)
SELECT event_id, {_CH('2 - abs((s + 5) % 6 - 3)')} AS blue, {_CH('2 - abs((s + 1) % 6 - 3)')} AS green, {_CH('abs(s % 6 - 3) - 1')} AS red FROM h""",
)
def flow_colours(spark, sf):
    """Motions as colours: hue by direction, light by length."""
    e = table(spark, sf, "events").select("event_id", (F.col("value") / 10 - 5.0037).alias("dx"), (F.col("event_id") % 41 - 20).cast("double").alias("dy"))
    return e.select("event_id", _colour("dx", "dy").alias("c")).select("event_id", "c.*")


@F.pandas_udf(imaging.IMAGE)
def _poster(x: pd.Series, y: pd.Series, w: pd.Series, h: pd.Series, level: pd.Series) -> pd.DataFrame:
    """A plain field with one plain box in it."""
    rows = []
    for a, b, c, d, v in zip(x, y, w, h, level, strict=True):
        image = np.full((H, W), 60, np.uint8)
        image[b : b + d, a : a + c] = v
        rows.append(imaging.encode(image))
    return pd.DataFrame(rows, columns=imaging.IMAGE.names)


_POSTER = "p AS (SELECT p_partkey, p_partkey % 30 AS x, p_partkey % 17 AS y, 8 + p_size % 15 AS w, 7 + p_partkey % 13 AS h FROM part)"


@query(
    "region_proposals",
    f"""WITH {_POSTER} SELECT p_partkey, CAST(CASE WHEN x = 0 AND y = 0 THEN 0 ELSE 1 END AS BIGINT) AS place, CAST(x AS BIGINT) AS x1, CAST(y AS BIGINT) AS y1, CAST(x + w AS BIGINT) AS x2, CAST(y + h AS BIGINT) AS y2, CAST(w * h AS BIGINT) AS size FROM p
UNION ALL SELECT p_partkey, CASE WHEN x = 0 AND y = 0 THEN 1 ELSE 0 END, 0, 0, {W}, {H}, {W * H} - w * h FROM p""",
)
def region_proposals(spark, sf):
    """A box in a field: its region, and the field's, which the merged image repeats."""
    p = _dealt(table(spark, sf, "part").select("p_partkey", "p_size"), "p_partkey")
    x, y, w, h = F.col("p_partkey") % 30, F.col("p_partkey") % 17, 8 + F.col("p_size") % 15, 7 + F.col("p_partkey") % 13
    images = p.select("p_partkey", _poster(x, y, w, h, 120 + F.col("p_partkey") % 100).alias("image"))
    return proposals.proposals(images, ["p_partkey"])
