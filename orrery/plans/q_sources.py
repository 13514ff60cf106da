"""Queries of readers' logic on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import pose as P
from orrery.functions import text
from orrery.operators import sequence as S
from orrery.plans.fixtures import POSES, poses, r, rs, table
from orrery.plans.registry import query
from orrery.sources import readers, writers


@query("natural_sort_names", "SELECT p_partkey, CAST(row_number() OVER (ORDER BY p_partkey) AS BIGINT) AS place FROM part")
def natural_sort_names(spark, sf):
    """File names in natural order: img2 before IMG10."""
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("img"), F.col("p_partkey"), F.lit(".png"))).otherwise(F.concat(F.lit("IMG"), F.col("p_partkey"), F.lit(".PNG")))
    p = table(spark, sf, "part").select("p_partkey", text.natural_key(name).alias("k"))
    return S.rank_all(p, ["k"]).select("p_partkey", (F.col("idx") + 1).alias("place"))


@query("path_tree", "SELECT split_part(url, '/', 3) AS lvl2, split_part(url, '/', 4) AS lvl3, min(page_id) AS page_id FROM pages GROUP BY ALL")
def path_tree(spark, sf):
    t = readers.key_tree(table(spark, sf, "pages"), "url", "page_id", 4)
    return t.groupBy(F.coalesce("lvl2", F.lit("")).alias("lvl2"), F.coalesce("lvl3", F.lit("")).alias("lvl3")).agg(F.min("page_id").alias("page_id"))


@query("json_field_sum", "SELECT user_id, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY user_id")
def json_field_sum(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.sum(F.from_json("props", "k BIGINT")["k"]).alias("k"))


@query("pose_text_roundtrip", f"WITH {POSES} SELECT traj_id, idx, {', '.join(f'{rs(f't{k}', 5)} AS t{k}' for k in 'xyz')} FROM poses")
def pose_text_roundtrip(spark, sf):
    """Written as lines of twelve numbers and parsed again."""
    lines = poses(spark, sf).select("traj_id", "idx", text.pose_line(P.to_row(F.col("pose"))).alias("value"))
    back = lines.select("traj_id", "idx", P.from_row(text.floats(F.col("value"))).alias("p"))
    return back.select("traj_id", "idx", *[r(F.col(f"p.t.{k}"), 5).alias(f"t{k}") for k in "xyz"])


@query("disparity_scaling", f"SELECT p_partkey, {rs('CAST(p_size * 1000 / 256.0::DOUBLE AS FLOAT)', 4)} AS value FROM part")
def disparity_scaling(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 1000).cast("double").alias("value"))
    return readers.disparity(p).select("p_partkey", r(F.col("value"), 4).alias("value"))


@query("key_value_records", f"SELECT n_nationkey, n_name AS name, {rs('n_regionkey + 0.5')} AS second FROM nation")
def key_value_records(spark, sf):
    n = table(spark, sf, "nation")
    body = F.format_string("name = %s;\nsize = 3;\nvec = [1.0, %s.5, -2e1];\n", "n_name", F.col("n_regionkey").cast("string"))
    got = n.select("n_nationkey", text.key_values(body).alias("m"))
    return got.select("n_nationkey", F.col("m")["name"].alias("name"), r(text.bracket_numbers(F.col("m")["vec"])[1]).alias("second"))


@query("frame_template_index", "SELECT event_id AS idx, user_id FROM events")
def frame_template_index(spark, sf):
    """Indices out of names like frames/000107.png."""
    names = table(spark, sf, "events").select("user_id", F.format_string("frames/%06d.png", "event_id").alias("path"))
    return readers.frame_index(names).select("idx", "user_id")


@query("pose_lines_sink", f"WITH {POSES} SELECT traj_id, count(*) AS n FROM poses GROUP BY traj_id")
def pose_lines_sink(spark, sf):
    lines = writers.pose_lines(poses(spark, sf).withColumn("key", F.struct("traj_id", "idx")), "key")
    return lines.where(F.size(text.floats(F.col("value"))) == 12).groupBy("key.traj_id").agg(F.count("*").alias("n"))
