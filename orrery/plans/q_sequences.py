"""Sequence queries over events, in order of event_id."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import poses as PO
from orrery.operators import sequence as S
from orrery.operators import zips as Z
from orrery.plans.fixtures import FRAMES, POSES, frames, poses, r, rotate_sql, rs, table
from orrery.plans.registry import query


def events(spark, sf):
    return table(spark, sf, "events")


@query("seq_take", "SELECT event_id, value FROM events ORDER BY event_id LIMIT 25")
def seq_take(spark, sf):
    return S.take(events(spark, sf).select("event_id", "value"), ["event_id"], 25)


@query("seq_consume", "SELECT event_id FROM events ORDER BY event_id OFFSET 100")
def seq_consume(spark, sf):
    return S.consume(events(spark, sf).select("event_id"), ["event_id"], 100)


@query("seq_tabulate", "SELECT event_id + 5 AS x, (event_id + 5) * (event_id + 5) AS y FROM events")
def seq_tabulate(spark, sf):
    """A function at the places of the events, counted from 5."""
    at = events(spark, sf).select((F.col("event_id") + 5).alias("x"))
    return at.withColumn("y", F.col("x") * F.col("x"))


@query("seq_nth", "SELECT user_id, coalesce(max(CASE WHEN rn = 5 THEN value END), -1.0::DOUBLE) AS value FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS rn FROM events) GROUP BY user_id")
def seq_nth(spark, sf):
    return S.nth(events(spark, sf), ["user_id"], ["event_id"], "value", 5, -1.0)


@query("seq_quantify", "SELECT event_type, count(*) FILTER (WHERE value > 100) AS n FROM events GROUP BY event_type")
def seq_quantify(spark, sf):
    return S.quantify(events(spark, sf), ["event_type"], F.col("value") > 100)


@query("seq_stride", "SELECT event_id, value FROM events WHERE event_id >= 3 AND (event_id - 3) % 7 = 0")
def seq_stride(spark, sf):
    return S.stride(events(spark, sf).select("event_id", "value"), "event_id", 7, 3)


@query("seq_stride_reverse", "SELECT event_id, CAST(row_number() OVER (ORDER BY event_id DESC) - 1 AS BIGINT) AS pos FROM events WHERE event_id % 50 = 0")
def seq_stride_reverse(spark, sf):
    got = S.stride(events(spark, sf).select("event_id"), "event_id", 50)
    top = got.agg(F.max("event_id").alias("top"))
    return got.crossJoin(F.broadcast(top)).select("event_id", ((F.col("top") - F.col("event_id")) / 50).cast("bigint").alias("pos"))


@query("seq_by_indices", "SELECT CAST(p AS BIGINT) AS pos, event_id, value FROM (SELECT unnest([9, 3, 3, 42, 0]) AS i, unnest(range(5)) AS p) w JOIN events ON event_id = i")
def seq_by_indices(spark, sf):
    return S.by_indices(events(spark, sf).select("event_id", "value"), "event_id", [9, 3, 3, 42, 0]).select("pos", "event_id", "value")


@query("seq_pick", "SELECT event_id, event_type FROM events WHERE event_id IN (7, 27, 47, 67, 87)")
def seq_pick(spark, sf):
    return S.pick(events(spark, sf).select("event_id", "event_type"), "event_id", [7, 27, 47, 67, 87])


@query("seq_getitem", "SELECT event_id, user_id, value FROM events WHERE event_id = 123")
def seq_getitem(spark, sf):
    return events(spark, sf).where("event_id = 123").select("event_id", "user_id", "value")


@query("seq_padnone", f"WITH {FRAMES} SELECT u.traj_id, CAST(i AS BIGINT) AS idx, f.tx FROM (SELECT DISTINCT traj_id FROM frames) u CROSS JOIN range(80) r(i) LEFT JOIN frames f ON f.traj_id = u.traj_id AND f.idx = i")
def seq_padnone(spark, sf):
    return S.pad_none(frames(spark, sf).select("traj_id", "idx", "tx"), ["traj_id"], "idx", 80)


@query("seq_ncycles", "SELECT n_nationkey, CAST(c AS BIGINT) AS cycle FROM nation, range(3) t(c)")
def seq_ncycles(spark, sf):
    return S.ncycles(table(spark, sf, "nation").select("n_nationkey"), "n_nationkey", 3)


@query("seq_pairwise", "SELECT user_id, event_id, value, nxt AS next FROM (SELECT user_id, event_id, value, lead(value) OVER w AS nxt, lead(true) OVER w AS more FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE more")
def seq_pairwise(spark, sf):
    return S.pairwise(events(spark, sf).select("user_id", "event_id", "value"), ["user_id"], ["event_id"], "value")


@query("seq_lookahead", "SELECT user_id, event_id, value, nxt AS next FROM (SELECT user_id, event_id, value, lead(value, 3) OVER w AS nxt, lead(true, 3) OVER w AS more FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE more")
def seq_lookahead(spark, sf):
    return S.pairwise(events(spark, sf).select("user_id", "event_id", "value"), ["user_id"], ["event_id"], "value", 3)


@query("seq_global_pairs", f"SELECT event_id, value, {rs('value - lag(value) OVER (ORDER BY event_id)')} AS step FROM events")
def seq_global_pairs(spark, sf):
    """Neighbours over one global order, in blocks."""
    got = S.with_neighbours(events(spark, sf).select("event_id", "value"), "event_id", {"before": ("value", 1)}, block=4096)
    return got.select("event_id", "value", r(F.col("value") - F.col("before")).alias("step"))


@query("seq_global_index", "SELECT event_id, CAST(row_number() OVER (ORDER BY value, event_id) - 1 AS BIGINT) AS idx FROM events")
def seq_global_index(spark, sf):
    return S.index_all(events(spark, sf).select("event_id", "value"), "value", ["event_id"]).select("event_id", "idx")


@query("seq_global_total", f"SELECT event_id, {rs('sum(value) OVER (ORDER BY event_id)', 4)} AS acc FROM events")
def seq_global_total(spark, sf):
    return S.running_total(events(spark, sf).select("event_id", "value"), "event_id", "value", block=4096).select("event_id", r(F.col("acc"), 4).alias("acc"))


@query("seq_chunks", "SELECT event_id // 16 AS chunk, sha256(string_agg(event_type, ',' ORDER BY event_id)) AS items, count(*) AS n FROM events GROUP BY 1")
def seq_chunks(spark, sf):
    got = S.chunks(events(spark, sf), [], "event_id", "event_type", 16)
    return got.select("chunk", F.sha2(F.array_join("items", ","), 256).alias("items"), F.size("items").cast("bigint").alias("n"))


@query("seq_grouper", f"WITH {FRAMES} SELECT traj_id, idx // 8 AS chunk, array_to_string(list_concat(list(event_id ORDER BY idx), [-1 FOR x IN range(8 - count(*))]), ',') AS items FROM frames GROUP BY ALL")
def seq_grouper(spark, sf):
    got = S.grouper(frames(spark, sf), ["traj_id"], "idx", "event_id", 8, -1)
    return got.select("traj_id", "chunk", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


@query(
    "seq_roundrobin",
    "SELECT event_id, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS src, CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS BIGINT) AS turn FROM events",
)
def seq_roundrobin(spark, sf):
    return S.roundrobin_by(events(spark, sf).select("event_type", "event_id"), "event_type", ["event_id"]).select("event_id", "src", "turn")


@query(
    "seq_powerset",
    "SELECT array_to_string(list_filter(['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST'], lambda x, i: (m >> (i - 1)) & 1 = 1), ',') AS items FROM range(32) t(m)",
)
def seq_powerset(spark, sf):
    names = table(spark, sf, "region").agg(F.array_sort(F.collect_list("r_name")).alias("r"))
    return names.select(F.explode(S.powerset(F.col("r"))).alias("s")).select(F.array_join("s", ",").alias("items"))


@query("seq_everseen", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def seq_everseen(spark, sf):
    return S.unique_everseen(events(spark, sf).select("user_id", "event_type", "event_id"), ["user_id", "event_type"], ["event_id"])


@query("seq_justseen", "SELECT user_id, event_id, event_type FROM (SELECT user_id, event_id, event_type, row_number() OVER w AS rn, lag(event_type) OVER w AS prev FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE rn = 1 OR event_type IS DISTINCT FROM prev")
def seq_justseen(spark, sf):
    return S.unique_justseen(events(spark, sf).select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"], "event_type")


@query(
    "seq_accumulate",
    f"SELECT user_id, event_id, {rs('sum(value) OVER w', 4)} AS acc, max(value) OVER w AS top, {rs('exp(sum(ln(1 + value / 1000)) OVER w)', 6)} AS grown FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)",
)
def seq_accumulate(spark, sf):
    e = events(spark, sf).select("user_id", "event_id", "value", (1 + F.col("value") / 1000).alias("g"))
    e = S.accumulate(e, ["user_id"], ["event_id"], "value")
    e = S.accumulate(e, ["user_id"], ["event_id"], "value", "max", "top")
    e = S.accumulate(e, ["user_id"], ["event_id"], "g", "product", "grown")
    return e.select("user_id", "event_id", r(F.col("acc"), 4).alias("acc"), "top", r(F.col("grown"), 6).alias("grown"))


@query(
    "seq_moving_average",
    f"SELECT user_id, event_id, {rs('avg', 5)} AS avg FROM (SELECT user_id, event_id, avg(value) OVER (w ROWS 2 PRECEDING) AS avg, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE rn >= 3",
)
def seq_moving_average(spark, sf):
    return S.moving_average(events(spark, sf).select("user_id", "event_id", "value"), ["user_id"], ["event_id"], "value").select("user_id", "event_id", r(F.col("avg"), 5).alias("avg"))


@query(
    "seq_unwrap",
    f"""WITH {FRAMES}, d AS (SELECT traj_id, idx, yaw * 4 AS a, yaw * 4 - lag(yaw * 4) OVER (PARTITION BY traj_id ORDER BY idx) AS d FROM frames),
w AS (SELECT *, (d + pi()) - floor((d + pi()) / (2 * pi())) * 2 * pi() - pi() AS m FROM d),
f AS (SELECT *, CASE WHEN abs(d) >= pi() THEN (CASE WHEN m = -pi() AND d > 0 THEN pi() ELSE m END) - d ELSE 0 END AS fix FROM w)
SELECT traj_id, idx, {rs("a + coalesce(sum(fix) OVER (PARTITION BY traj_id ORDER BY idx), 0)", 4)} AS unwrapped FROM f""",
)
def seq_unwrap(spark, sf):
    got = S.unwrap(frames(spark, sf).select("traj_id", "idx", (F.col("yaw") * 4).alias("a")), ["traj_id"], ["idx"], "a")
    return got.select("traj_id", "idx", r(F.col("unwrapped"), 4).alias("unwrapped"))


@query("seq_last_n", "SELECT user_id, event_id, value, total FROM (SELECT user_id, event_id, value, count(*) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn <= 5")
def seq_last_n(spark, sf):
    return S.last_n(events(spark, sf).select("user_id", "event_id", "value"), ["user_id"], ["event_id"], 5)


@query("seq_latest_keys", "SELECT user_id, event_id, value, first FROM (SELECT user_id, min(event_id) AS first, max(event_id) AS event_id, max_by(value, event_id) AS value FROM events GROUP BY user_id) ORDER BY first DESC, user_id LIMIT 40")
def seq_latest_keys(spark, sf):
    return S.latest_keys(events(spark, sf).select("user_id", "event_id", "value"), "user_id", "event_id", 40)


@query("label_ids_first_seen", "SELECT event_type, min(event_id) AS first, CAST(row_number() OVER (ORDER BY min(event_id), event_type) - 1 AS BIGINT) AS id FROM events GROUP BY event_type")
def label_ids_first_seen(spark, sf):
    return S.first_seen_ids(events(spark, sf), "event_type", "event_id")


@query("counter_periodic", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n % 4 = 0")
def counter_periodic(spark, sf):
    return S.every_kth(events(spark, sf).select("user_id", "event_id"), ["user_id"], ["event_id"], 4)


@query("counter_skipped", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE (n - 1) % 10 = 0")
def counter_skipped(spark, sf):
    return S.every_kth(events(spark, sf).select("user_id", "event_id"), ["user_id"], ["event_id"], 10, count_first=False)


@query("best_so_far", "SELECT user_id, event_id, value FROM (SELECT user_id, event_id, value, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n % 2 = 0 AND (best IS NULL OR value < best)")
def best_so_far(spark, sf):
    return S.best_so_far(events(spark, sf).select("user_id", "event_id", "value"), ["user_id"], ["event_id"], "value", 2)


@query("seq_random_pick", "SELECT event_id FROM events ORDER BY sha256('1:' || CAST(event_id AS VARCHAR)), event_id LIMIT 50")
def seq_random_pick(spark, sf):
    return S.random_pick(events(spark, sf).select("event_id"), 50)


_TYPED = "t AS (SELECT event_id, value, CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS BIGINT) AS idx, dense_rank() OVER (ORDER BY event_type) AS k FROM events)"


def _streams(spark, sf, n):
    e = S.index_within(events(spark, sf).select("event_type", "event_id", "value"), ["event_type"], ["event_id"])
    kinds = [x[0] for x in e.select("event_type").distinct().orderBy("event_type").limit(n).collect()]
    return [e.where(F.col("event_type") == k).select("idx", F.col("event_id").alias(f"e{i}"), F.col("value").alias(f"v{i}")) for i, k in enumerate(kinds)]


@query("zip_streams", f"WITH {_TYPED} SELECT a.idx, a.event_id AS e0, a.value AS v0, b.event_id AS e1, b.value AS v1, c.event_id AS e2, c.value AS v2 FROM t a JOIN t b ON a.idx = b.idx AND b.k = 2 JOIN t c ON a.idx = c.idx AND c.k = 3 WHERE a.k = 1")
def zip_streams(spark, sf):
    return Z.zip_streams(_streams(spark, sf, 3), ["idx"])


@query("zip_with_missing", f"WITH {_TYPED} SELECT a.idx, a.event_id AS e0, a.value AS v0, coalesce(b.event_id, -1) AS e1, b.value AS v1, CAST(NULL AS DOUBLE) AS velodyne FROM t a LEFT JOIN t b ON a.idx = b.idx AND b.k = 2 WHERE a.k = 1")
def zip_with_missing(spark, sf):
    a, b = _streams(spark, sf, 2)
    return Z.absent(Z.zip_optional(a, [b], ["idx"]), "velodyne", "double").withColumn("e1", F.coalesce("e1", F.lit(-1).cast("bigint")))


@query("union_scenes", "SELECT o_orderkey, o_totalprice, 'even' AS scene FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, o_totalprice, 'odd' FROM orders WHERE o_orderkey % 2 = 1")
def union_scenes(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return Z.union_scenes({"even": o.where("o_orderkey % 2 = 0"), "odd": o.where("o_orderkey % 2 = 1")})


@query(
    "asof_join",
    "SELECT a.event_id, coalesce(max(b.event_id), -1) AS before FROM events a LEFT JOIN (SELECT * FROM events WHERE event_type = (SELECT max(event_type) FROM events)) b ON b.user_id = a.user_id AND b.event_id <= a.event_id WHERE a.event_type = (SELECT min(event_type) FROM events) GROUP BY a.event_id",
)
def asof_join(spark, sf):
    e = events(spark, sf).select("user_id", "event_id", "event_type")
    lo, hi = e.agg(F.min("event_type"), F.max("event_type")).first()
    left, right = e.where(F.col("event_type") == lo), e.where(F.col("event_type") == hi)
    return Z.asof(left, right, ["user_id"], "event_id", []).select("event_id", F.coalesce("match.ts", F.lit(-1).cast("bigint")).alias("before"))


_REL = rotate_sql("a.q", ("(b.tx - a.tx)", "(b.ty - a.ty)", "(b.tz - a.tz)"), -1)


@query(
    "pose_accumulator",
    f"WITH {POSES} SELECT b.traj_id, b.idx, {', '.join(f'{rs(e, 5)} AS {k}' for e, k in zip(_REL, ('tx', 'ty', 'tz'), strict=True))}, count(*) OVER (PARTITION BY b.traj_id) AS total FROM poses b JOIN poses a ON a.traj_id = b.traj_id AND a.idx = 0 QUALIFY row_number() OVER (PARTITION BY b.traj_id ORDER BY b.idx DESC) <= 10",
)
def pose_accumulator(spark, sf):
    """The newest ten poses of each trajectory, from its first one."""
    got = S.last_n(PO.relative_to_first(poses(spark, sf), ["traj_id"], "idx"), ["traj_id"], ["idx"], 10)
    return got.select("traj_id", "idx", *[r(F.col(f"rel.t.{k}"), 5).alias(f"t{k}") for k in "xyz"], "total")


@query("seq_random_order", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(min(event_id) AS BIGINT) AS lo, CAST(max(event_id) AS BIGINT) AS hi, CAST(count(*) - 1 AS BIGINT) AS last, true AS moved FROM events")
def seq_random_order(spark, sf):
    """A permutation: every row once, dense places, another order."""
    got = S.random_order(events(spark, sf).select("event_id"))
    return got.agg(F.countDistinct("event_id").alias("n"), F.min("event_id").alias("lo"), F.max("event_id").alias("hi"), F.max("idx").alias("last"), (F.count_if(F.col("idx") != F.col("event_id")) > F.count("*") / 2).alias("moved"))


@query("seq_repeated", "SELECT event_id, unnest(range(3)) AS call FROM events")
def seq_repeated(spark, sf):
    return S.repeated(events(spark, sf).select("event_id"), 3)


@query("seq_index_with_ties", "SELECT event_id, CAST(row_number() OVER (ORDER BY user_id % 3, event_id) - 1 AS BIGINT) AS idx FROM events")
def seq_index_with_ties(spark, sf):
    """A global index where three values are all there is: blocks are cut by the tie."""
    return S.index_all(events(spark, sf).select("event_id", (F.col("user_id") % 3).alias("k")), "k", ["event_id"]).select("event_id", "idx")


@query("window_sessions", "SELECT CAST(user_id AS BIGINT) AS user_id, count(*) AS sessions FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events) WHERE p IS NULL OR ts > p + INTERVAL 1 HOUR GROUP BY user_id")
def window_sessions(spark, sf):
    """Sessions with gaps of over an hour."""
    e = events(spark, sf).select("user_id", "ts")
    return e.groupBy("user_id", F.session_window("ts", "3600000001 microseconds")).agg(F.count("*").alias("n")).groupBy("user_id").agg(F.count("*").alias("sessions"))
