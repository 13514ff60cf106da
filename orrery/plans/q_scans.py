"""Queries of scans along long trajectories."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from orrery.functions import pose as P
from orrery.functions import quat, vec
from orrery.operators import scan
from orrery.plans.fixtures import POSES, multiply_sql, poses, r, rotate_sql, rs, table
from orrery.plans.registry import query

#: Quaternions whose products are exact in binary, so that any order of multiplication gives the same bits.
_TURNS = [(0.5, 0.5, 0.5, 0.5), (0.0, 0.0, 0.0, 1.0), (1.0, 0.0, 0.0, 0.0), (0.5, -0.5, 0.5, 0.5), (0.0, 0.0, 1.0, 0.0)]
_turn_sql = lambda k: f"CAST(CASE event_id % {len(_TURNS)} {' '.join(f'WHEN {i} THEN {t[k]}' for i, t in enumerate(_TURNS))} END AS DOUBLE)"


def _next(a: str, b: str) -> str:
    """SQL of the parts of a after b, named qx..qw, tx..tz."""
    q = multiply_sql(f"{a}.q", f"{b}.q")
    t = rotate_sql(f"{a}.q", tuple(f"{b}.t{k}" for k in "xyz"))
    return ", ".join([*(f"{e} AS q{k}" for e, k in zip(q, "xyzw", strict=True)), *(f"{e} + {a}.t{k} AS t{k}" for e, k in zip(t, "xyz", strict=True))])


_PARTS = [*(f"q{k}" for k in "xyzw"), *(f"t{k}" for k in "xyz")]


def _flat(col: str, digits: int | None = None) -> list:
    at = [*(F.col(f"{col}.q.{k}").alias(f"q{k}") for k in "xyzw"), *(F.col(f"{col}.t.{k}").alias(f"t{k}") for k in "xyz")]
    return [c if digits is None else r(c, digits).alias(n) for c, n in zip(at, _PARTS, strict=True)]


@query(
    "chain_all_events",
    f"""WITH RECURSIVE steps AS (SELECT event_id AS i, {', '.join(f'{_turn_sql(k)} AS q{n}' for k, n in enumerate('xyzw'))}, round(value) AS tx, CAST(event_id % 7 AS DOUBLE) AS ty, CAST(event_id % 3 - 1 AS DOUBLE) AS tz FROM events),
numbered AS (SELECT *, row_number() OVER (ORDER BY i) AS n FROM steps),
chain AS (SELECT i, n, {', '.join(_PARTS)} FROM numbered WHERE n = 1
  UNION ALL SELECT s.i, s.n, {_next('c', 's')} FROM chain c JOIN numbered s ON s.n = c.n + 1)
SELECT i AS event_id, {', '.join(f'{p} + CAST(0 AS DOUBLE) AS {p}' for p in _PARTS)} FROM chain""",
)
def chain_all_events(spark, sf):
    """All events as steps of one trajectory, chained: turns and whole steps that are exact in binary."""
    k = F.pmod(F.col("event_id"), F.lit(len(_TURNS))).cast("int")
    turn = quat.quat(*[F.array(*[F.lit(t[i]) for t in _TURNS])[k] for i in range(4)])
    step = P.pose(turn, vec.vec3(F.round("value"), (F.col("event_id") % 7).cast("double"), (F.col("event_id") % 3 - 1).cast("double")))
    # blocks of a thousand rows, so that small tables have many
    got = scan.prefix_products(table(spark, sf, "events").select("event_id", step.alias("pose")), [], "event_id", size=1000)
    return got.select("event_id", *[(c + F.lit(0.0)).alias(n) for c, n in zip(_flat("chain"), _PARTS, strict=True)])


_U = lambda kind, i: f"((CAST('0x' || substr(sha256('7:{kind}:' || CAST(event_id AS VARCHAR)), {8 * i + 1}, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE)"
_normal = lambda kind, i: f"sqrt(-2 * ln({_U(kind, 2 * i)})) * cos({2 * math.pi!r}::DOUBLE * {_U(kind, 2 * i + 1)})"


@query(
    "noisy_odometry",
    f"""WITH RECURSIVE {POSES.replace('WITH ', '')},
noise AS (SELECT *, {', '.join(f'0.2 * {_normal("step", i)} AS etx{n}' for i, n in enumerate('xyz'))}, {', '.join(f'0.05 * {_normal("turn", i)} AS e{n}' for i, n in enumerate(('roll', 'pitch', 'yaw')))} FROM poses),
e AS (SELECT traj_id, idx, event_id, etxx AS tx, etxy AS ty, etxz AS tz,
  sin(eroll/2)*cos(epitch/2)*cos(eyaw/2) + cos(eroll/2)*sin(epitch/2)*sin(eyaw/2) AS qx, cos(eroll/2)*sin(epitch/2)*cos(eyaw/2) - sin(eroll/2)*cos(epitch/2)*sin(eyaw/2) AS qy,
  sin(eroll/2)*sin(epitch/2)*cos(eyaw/2) + cos(eroll/2)*cos(epitch/2)*sin(eyaw/2) AS qz, cos(eroll/2)*cos(epitch/2)*cos(eyaw/2) - sin(eroll/2)*sin(epitch/2)*sin(eyaw/2) AS qw FROM noise),
d AS (SELECT b.traj_id, b.idx, {', '.join(f'{x} AS q{k}' for x, k in zip(multiply_sql('a.q', 'b.q', -1), 'xyzw', strict=True))},
  {', '.join(f'{x} AS t{k}' for x, k in zip(rotate_sql('a.q', tuple(f'(b.t{k} - a.t{k})' for k in 'xyz'), -1), 'xyz', strict=True))} FROM poses a JOIN poses b ON b.traj_id = a.traj_id AND b.idx = a.idx + 1),
s AS (SELECT d.traj_id, d.idx, {_next('e', 'd')} FROM d JOIN e ON e.traj_id = d.traj_id AND e.idx = d.idx),
walk AS (SELECT traj_id, idx, {', '.join(_PARTS)} FROM poses WHERE idx = 0
  UNION ALL SELECT s.traj_id, s.idx, {_next('w', 's')} FROM walk w JOIN s ON s.traj_id = w.traj_id AND s.idx = w.idx + 1)
SELECT traj_id, idx, {', '.join(f'{rs(p, 5)} AS {p}' for p in _PARTS)} FROM walk""",
)
def noisy_odometry(spark, sf):
    """Trajectories that drift by noise drawn from a hash of each event."""
    got = scan.noisy_odometry(poses(spark, sf), ["traj_id"], "idx", F.col("event_id"), [0.2, 0.05], seed=7, size=500)
    return got.select("traj_id", "idx", *_flat("noisy", 5))
