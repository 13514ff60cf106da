"""Queries of collections kept by key in an append log."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery import shared
from orrery.functions import pose as P
from orrery.functions import quat, vec
from orrery.plans.fixtures import r, rs, table
from orrery.plans.registry import query
from orrery.sources import collections as C

#: Events as messages: the type is the channel, the user the element; some reset their channel, some take an element away, and one
#: resets all channels.
_MESSAGES = """m AS (SELECT event_type AS channel, event_id AS seq, user_id AS id, event_id % 311 = 310 AS reset, event_id % 17 = 5 AS deleted, value, CAST(event_id % 50 AS DOUBLE) AS y FROM events),
fence AS (SELECT max(event_id) // 3 AS mark FROM events), own AS (SELECT channel, max(seq) AS mark FROM m WHERE reset GROUP BY channel),
last AS (SELECT m.channel, m.id, arg_max({'seq': m.seq, 'deleted': m.deleted, 'x': m.value, 'y': m.y}, m.seq) AS e FROM m LEFT JOIN own ON own.channel = m.channel WHERE (own.mark IS NULL OR m.seq >= own.mark) AND m.seq > (SELECT mark FROM fence) GROUP BY ALL),
live AS (SELECT channel, id, e.seq AS seq, e.x AS x, e.y AS y FROM last WHERE NOT e.deleted)"""


def _store(spark, sf, compactions: tuple[int, ...]) -> C.Collections:
    """The messages in four appends, with a compaction after some; the third comes before the second."""
    e = table(spark, sf, "events")
    fence = e.agg(F.max("event_id")).first()[0] // 3
    turn = quat.quat(0.0, 0.0, F.sin(F.radians(F.col("event_id") % 360) / 2), F.cos(F.radians(F.col("event_id") % 360) / 2))
    m = e.select(F.col("event_type").alias("channel"), F.col("event_id").alias("seq"), F.col("user_id").alias("id"), (F.col("event_id") % 311 == 310).alias("reset"), (F.col("event_id") % 17 == 5).alias("deleted"), P.pose(turn, vec.vec3(F.col("value"), (F.col("event_id") % 50).cast("double"), F.lit(0.0))).alias("pose"))
    store = C.Collections(spark, shared.fresh(spark, "collections"), C.POSE_PAYLOAD)
    for k, part in enumerate((0, 2, 1, 3)):
        store.append(m.where(F.floor(F.col("seq") * 4 / (3 * fence + 3)) == part) if part < 3 else m.where(F.floor(F.col("seq") * 4 / (3 * fence + 3)) >= 3))
        if k == 1:
            store.append(spark.createDataFrame([(None, fence, True, None)], "channel string, seq bigint, reset boolean, id bigint"))
        if k in compactions:
            store.compact()
    return store


@query("collections_latest", f"WITH {_MESSAGES} SELECT channel, id, seq, x, y FROM live")
def collections_latest(spark, sf):
    """What is left of all messages, merged as it is read."""
    return _store(spark, sf, ()).elements().select("channel", "id", "seq", "pose.t.x", "pose.t.y")


@query("collections_compacted", f"WITH {_MESSAGES} SELECT channel, id, seq, x, y FROM live")
def collections_compacted(spark, sf):
    """The same with compactions in between, also before messages that come late."""
    return _store(spark, sf, (1, 2)).elements().select("channel", "id", "seq", "pose.t.x", "pose.t.y")


@query(
    "clouds_by_pose_ids",
    f"""WITH {_MESSAGES}, c AS (SELECT p_partkey AS id, (SELECT min(event_type) FROM events) AS frame, p_partkey % 300 AS element_id, CAST(p_size AS DOUBLE) AS px, CAST(p_partkey % 11 AS DOUBLE) AS py FROM part)
SELECT c.id, {rs('cos(radians(l.seq % 360)) * px - sin(radians(l.seq % 360)) * py + l.x', 5)} AS x, {rs('sin(radians(l.seq % 360)) * px + cos(radians(l.seq % 360)) * py + l.y', 5)} AS y FROM c LEFT JOIN live l ON l.channel = c.frame AND l.id = c.element_id""",
)
def clouds_by_pose_ids(spark, sf):
    """Points that are drawn in the pose whose id they name, as that pose is after all updates."""
    first = table(spark, sf, "events").agg(F.min("event_type")).first()[0]
    clouds = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.lit(first).alias("frame"), (F.col("p_partkey") % 300).alias("element_id"), F.array(vec.vec3(F.col("p_size").cast("double"), (F.col("p_partkey") % 11).cast("double"), F.lit(0.0))).alias("points"))
    got = C.moved_points(C.attached(clouds, _store(spark, sf, (2,)).elements()))
    return got.select("id", r(F.col("points")[0]["x"], 5).alias("x"), r(F.col("points")[0]["y"], 5).alias("y"))
