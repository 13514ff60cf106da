"""Image queries: each embedding is seen as a grey image of 8 by 8 pixels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from orrery.operators import imaging as I
from orrery.plans.fixtures import r, rs, table
from orrery.plans.registry import query

PIXELS = """pix AS (SELECT vec_id, (i - 1) % 8 AS x, (i - 1) // 8 AS y, CAST(greatest(0, least(255, floor((v + 1) * 127.5))) AS DOUBLE) AS value
 FROM (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings))"""


def images(spark, sf):
    e = table(spark, sf, "embeddings")
    levels = F.transform("embedding", lambda v: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor((v.cast("double") + 1) * 127.5))))

    def run(batches):
        for whole in batches:
            for k in range(0, len(whole), I._AT_ONCE):
                pdf = whole.iloc[k : k + I._AT_ONCE]
                rows = [{"h": 8, "w": 8, "c": 1, "data": bytes(int(x) for x in v)} for v in pdf["v"]]
                yield pd.DataFrame({"vec_id": pdf["vec_id"].to_numpy(), "image": rows})

    return e.select("vec_id", levels.alias("v")).mapInPandas(run, f"vec_id bigint, image {I.IMAGE.simpleString()}")


@query("image_pixels", f"WITH {PIXELS} SELECT vec_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, value FROM pix")
def image_pixels(spark, sf):
    return I.pixels(images(spark, sf), ["vec_id"])


@query("image_masked_pixels", f"WITH {PIXELS} SELECT vec_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, value FROM pix WHERE value > 140")
def image_masked_pixels(spark, sf):
    """Pixels under a mask that lies over the image in the same row."""
    both = I.apply(images(spark, sf), lambda a: (a > 140).astype("uint8"), name="mask").withColumnRenamed("image", "value")
    return I.side_by_side(both, ["vec_id"], ["value"], where="mask")


@query("image_sample", f"WITH {PIXELS} SELECT vec_id, CAST(x // 2 AS INTEGER) AS x, CAST(y // 2 AS INTEGER) AS y, value FROM pix WHERE x % 2 = 0 AND y % 2 = 0")
def image_sample(spark, sf):
    return I.pixels(I.apply(images(spark, sf), I.sample), ["vec_id"])


@query("image_resize", f"WITH {PIXELS} SELECT vec_id, CAST(x // 2 AS INTEGER) AS x, CAST(y // 2 AS INTEGER) AS y, round_even(avg(value), 0) AS value FROM pix GROUP BY ALL")
def image_resize(spark, sf):
    """Halved by the mean of each two by two pixels."""
    return I.pixels(I.apply(images(spark, sf), lambda a: I.resize(a, scale=0.5)), ["vec_id"])


_NEAR = f"WITH {PIXELS}, near AS (SELECT p.vec_id, p.x, p.y, q.value AS v FROM pix p, range(-1, 2) i(dx), range(-1, 2) j(dy), pix q WHERE q.vec_id = p.vec_id AND q.x = p.x + dx AND q.y = p.y + dy AND p.x BETWEEN 1 AND 6 AND p.y BETWEEN 1 AND 6)"


@query("image_morphology", f"{_NEAR} SELECT vec_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, max(v) AS dilated, min(v) AS eroded, median(v) AS middle FROM near GROUP BY ALL")
def image_morphology(spark, sf):
    """Greatest, least and median of each pixel's neighbourhood, away from the border."""
    out = None
    for name, kernel in (("dilated", I.dilate), ("eroded", I.erode), ("middle", I.median_blur)):
        got = I.pixels(I.apply(images(spark, sf), kernel), ["vec_id"]).where("x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6").withColumnRenamed("value", name)
        out = got if out is None else out.join(got, ["vec_id", "x", "y"])
    return out


@query("image_range", f"WITH {PIXELS} SELECT vec_id, {rs('max(value) - min(value)')} AS span FROM pix GROUP BY vec_id")
def image_range(spark, sf):
    return I.measure(images(spark, sf), lambda a: float(a.max()) - float(a.min()), name="span").select("vec_id", r(F.col("span")).alias("span"))


#: Neighbours of each pixel with their offsets; the border is mirrored without its own pixel.
_MIRROR = "7 - abs(7 - abs({}))"


def _around(source: str, name: str) -> str:
    x, y = _MIRROR.format("p.x + dx"), _MIRROR.format("p.y + dy")
    return f"{name} AS (SELECT p.vec_id, p.x, p.y, dx, dy, q.value AS v FROM {source} p, range(-1, 2) i(dx), range(-1, 2) j(dy), {source} q WHERE q.vec_id = p.vec_id AND q.x = {x} AND q.y = {y})"


_SLOPES = "sum(dx * (2 - abs(dy)) * v) AS gx, sum(dy * (2 - abs(dx)) * v) AS gy"


@query(
    "image_focus",
    f"""WITH {PIXELS}, {_around("pix", "near")}, k AS (SELECT vec_id, x, y, sum(CASE abs(dx) + abs(dy) WHEN 0 THEN -4 WHEN 1 THEN 1 ELSE 0 END * v) AS lap, {_SLOPES} FROM near GROUP BY ALL)
SELECT vec_id, {rs("var_pop(lap)")} AS laplacian, {rs("1e6 / (sum(gx * gx + gy * gy) / (count(*) + 1e-6))")} AS blur FROM k GROUP BY vec_id""",
)
def image_focus(spark, sf):
    """Sharpness measures of each image; the second a million times as large."""
    got = I.measure(I.measure(images(spark, sf), I.laplacian_variance, name="laplacian"), I.blur_measure, name="blur")
    return got.select("vec_id", r(F.col("laplacian")).alias("laplacian"), r(F.col("blur") * 1e6).alias("blur"))


_SIGMA = "(2 * 0.8::DOUBLE * 0.8::DOUBLE)"


@query(
    "image_edges",
    f"""WITH {PIXELS}, {_around("pix", "near")},
soft AS (SELECT vec_id, x, y, sum(v * exp(-(dx * dx + dy * dy) / {_SIGMA})) / sum(exp(-(dx * dx + dy * dy) / {_SIGMA})) AS value FROM near GROUP BY ALL), {_around("soft", "near2")},
k AS (SELECT vec_id, x, y, {_SLOPES} FROM near2 GROUP BY ALL)
SELECT vec_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CASE WHEN sqrt(gx * gx + gy * gy) > 150 THEN 255.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM k""",
)
def image_edges(spark, sf):
    return I.pixels(I.apply(images(spark, sf), lambda a: I.sobel_threshold(a, threshold=150)), ["vec_id"])


@query(
    "image_corners",
    f"""WITH {PIXELS}, {_around("pix", "near")}, k AS (SELECT vec_id, x, y, {_SLOPES} FROM near GROUP BY ALL),
xx AS (SELECT vec_id, x, y, gx * gx AS value FROM k), yy AS (SELECT vec_id, x, y, gy * gy AS value FROM k), xy AS (SELECT vec_id, x, y, gx * gy AS value FROM k),
{_around("xx", "n1")}, {_around("yy", "n2")}, {_around("xy", "n3")},
a AS (SELECT vec_id, x, y, sum(v) / 9 AS a FROM n1 GROUP BY ALL), b AS (SELECT vec_id, x, y, sum(v) / 9 AS b FROM n2 GROUP BY ALL), c AS (SELECT vec_id, x, y, sum(v) / 9 AS c FROM n3 GROUP BY ALL),
resp AS (SELECT vec_id, x, y, (a + b) / 2 - sqrt(power((a - b) / 2, 2) + c * c) AS value FROM a JOIN b USING (vec_id, x, y) JOIN c USING (vec_id, x, y)),
{_around("resp", "n4")}, top AS (SELECT vec_id, max(value) AS top FROM resp GROUP BY vec_id)
SELECT resp.vec_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, {rs("value", 2)} AS response FROM resp JOIN top USING (vec_id)
WHERE value > 0.01 * top AND value >= (SELECT max(v) - 1e-6 FROM n4 WHERE n4.vec_id = resp.vec_id AND n4.x = resp.x AND n4.y = resp.y)""",
)
def image_corners(spark, sf):
    """Local peaks of the corner response. Flat patches have none."""
    return I.corners(images(spark, sf), ["vec_id"]).select("vec_id", "x", "y", r(F.col("response"), 2).alias("response"))


@query(
    "image_mosaics",
    "SELECT g, part, CAST(ceil(n / ceil(sqrt(n))) * 8 AS INTEGER) AS h, CAST(ceil(sqrt(n)) * 8 AS INTEGER) AS w FROM (SELECT g, i // 100 AS part, count(*) AS n FROM (SELECT vec_id % 5 AS g, row_number() OVER (PARTITION BY vec_id % 5 ORDER BY vec_id) - 1 AS i FROM embeddings) GROUP BY ALL)",
)
def image_mosaics(spark, sf):
    got = I.mosaics(images(spark, sf).withColumn("g", F.col("vec_id") % 5), ["g"], "vec_id", 100, shape=(8, 8))
    return got.select("g", "part", F.col("image.h").alias("h"), F.col("image.w").alias("w"))


@query("dense_keypoints", "SELECT n_nationkey, CAST(l AS INTEGER) AS level, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y FROM nation, range(7) a(l), range(4, 61, 4) b(x), range(4, 45, 4) c(y)")
def dense_keypoints(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", F.lit(48).alias("h"), F.lit(64).alias("w"))
    return I.dense_grid(n, "h", "w").select("n_nationkey", "level", "x", "y")
