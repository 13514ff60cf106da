"""Track queries: track_id is a user, tick an event."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import tracks as T
from orrery.plans.fixtures import TRACKS, r, rs, table, tracks
from orrery.plans.registry import query


@query("track_lengths", f"WITH {TRACKS} SELECT track_id, max(tick) AS tick, max_by(x, tick) AS x, max_by(y, tick) AS y, count(*) AS length FROM tracks GROUP BY track_id")
def track_lengths(spark, sf):
    return T.latest(tracks(spark, sf))


_LAST = f"WITH {TRACKS}, n AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY tick DESC) AS rn FROM tracks)"


@query("track_flow", f"{_LAST} SELECT track_id, {rs('coalesce(max(x) FILTER (WHERE rn = 1) - max(x) FILTER (WHERE rn = 2), 0)')} AS dx, {rs('coalesce(max(y) FILTER (WHERE rn = 1) - max(y) FILTER (WHERE rn = 2), 0)')} AS dy FROM n GROUP BY track_id")
def track_flow(spark, sf):
    return T.flow(tracks(spark, sf)).select("track_id", r(F.col("dx")).alias("dx"), r(F.col("dy")).alias("dy"))


@query("track_steps", f"WITH {TRACKS} SELECT track_id, tick, {rs('coalesce(x - lag(x) OVER w, 0)')} AS dx, {rs('coalesce(y - lag(y) OVER w, 0)')} AS dy FROM tracks WINDOW w AS (PARTITION BY track_id ORDER BY tick)")
def track_steps(spark, sf):
    return T.lag_flow(tracks(spark, sf)).select("track_id", "tick", r(F.col("dx")).alias("dx"), r(F.col("dy")).alias("dy"))


@query("track_matches", f"{_LAST} SELECT track_id, max(x) FILTER (WHERE rn = 2) AS x_i, max(y) FILTER (WHERE rn = 2) AS y_i, max(x) FILTER (WHERE rn = 1) AS x_j, max(y) FILTER (WHERE rn = 1) AS y_j FROM n GROUP BY track_id HAVING count(*) > 2")
def track_matches(spark, sf):
    return T.matches(tracks(spark, sf))


@query("track_confident", f"WITH {TRACKS} SELECT track_id, max_by(x, tick) AS x, max_by(y, tick) AS y, count(*) AS length FROM tracks GROUP BY track_id HAVING count(*) >= 60")
def track_confident(spark, sf):
    return T.confident(tracks(spark, sf), least=60).select("track_id", "x", "y", "length")


@query("track_deaths", f"WITH {TRACKS} SELECT track_id, max(tick) AS last, count(*) AS length FROM tracks GROUP BY track_id HAVING max(tick) < (SELECT max(tick) FROM tracks) - 99")
def track_deaths(spark, sf):
    return T.deaths(tracks(spark, sf), gap=100)


@query("track_alive", f"WITH {TRACKS} SELECT track_id, max(tick) AS last, max(tick) < 500 AS dead FROM tracks WHERE tick <= 500 GROUP BY track_id")
def track_alive(spark, sf):
    return T.alive(tracks(spark, sf), 500)


@query("track_history", f"{_LAST} SELECT track_id, tick, x, y FROM n WHERE rn <= 4")
def track_history(spark, sf):
    return T.bounded_history(tracks(spark, sf), 4)


@query("track_assign_ids", f"WITH {TRACKS} SELECT p_partkey, CAST((SELECT max(track_id) FROM tracks) + row_number() OVER (ORDER BY p_size DESC, p_partkey) AS BIGINT) AS track_id FROM part")
def track_assign_ids(spark, sf):
    det = table(spark, sf, "part").select("p_partkey", "p_size")
    return T.assign_ids(det, tracks(spark, sf), [F.col("p_size").desc(), "p_partkey"]).select("p_partkey", "track_id")


@query("track_forward_backward", "SELECT event_id FROM events WHERE abs(value - (value + (event_id % 7) * 0.4)) < 1.5 AND abs(event_id % 50 - (event_id % 50 - (event_id % 3) * 0.9)) < 1.5")
def track_forward_backward(spark, sf):
    e = table(spark, sf, "events")
    y = (F.col("event_id") % 50).cast("double")
    e = e.select("event_id", F.col("value").alias("x0"), y.alias("y0"), (F.col("value") + (F.col("event_id") % 7) * 0.4).alias("xr"), (y - (F.col("event_id") % 3) * 0.9).alias("yr"))
    return T.forward_backward(e).select("event_id")


@query(
    "track_strongest_per_cell",
    """WITH p AS (SELECT event_id, value * 1.3 AS x, CAST(event_id % 480 AS DOUBLE) AS y, CAST((event_id * 7919) % 1000 AS DOUBLE) AS response FROM events WHERE value * 1.3 < 640)
SELECT event_id FROM p QUALIFY row_number() OVER (PARTITION BY floor(y * 12 / 480), floor(x * 10 / 640) ORDER BY response DESC, x, y) <= 10""",
)
def track_strongest_per_cell(spark, sf):
    e = table(spark, sf, "events")
    p = e.select("event_id", (F.col("value") * 1.3).alias("x"), (F.col("event_id") % 480).cast("double").alias("y"), ((F.col("event_id") * 7919) % 1000).cast("double").alias("response")).where("x < 640")
    return T.strongest_per_cell(p, [], 480, 640).select("event_id")


@query(
    "scene_flow",
    f"""WITH p AS (SELECT event_id AS src, CAST(event_id % 100 AS DOUBLE) AS x, CAST(event_id % 80 AS DOUBLE) AS y, event_id % 100 + value / 100 AS u, event_id % 80 + value / 200 AS v FROM events)
SELECT CAST(trunc(u) AS INTEGER) AS tx, CAST(trunc(v) AS INTEGER) AS ty, {rs("max_by(u - x, src)", 5)} AS dx, {rs("max_by(v - y, src)", 5)} AS dy FROM p GROUP BY 1, 2""",
)
def scene_flow(spark, sf):
    e = table(spark, sf, "events")
    x, y = (F.col("event_id") % 100).cast("double"), (F.col("event_id") % 80).cast("double")
    p = e.select(F.col("event_id").alias("src"), x.alias("x"), y.alias("y"), (x + F.col("value") / 100).alias("u"), (y + F.col("value") / 200).alias("v"))
    return T.scene_flow(p).select("tx", "ty", r(F.col("dx"), 5).alias("dx"), r(F.col("dy"), 5).alias("dy"))


@query("track_colours", f"WITH {TRACKS} SELECT track_id, CAST(track_id % 20 AS INTEGER) AS colour, count(*) AS n FROM tracks GROUP BY ALL")
def track_colours(spark, sf):
    return tracks(spark, sf).groupBy("track_id").agg(F.count("*").alias("n")).select("track_id", T.colour_index(F.col("track_id")).cast("int").alias("colour"), "n")
