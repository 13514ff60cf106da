"""Feature tracks as observation rows (track_id, tick, x, y), several cameras by extra `by` columns."""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(by: Sequence[str]):
    return Window.partitionBy(*by, "track_id").orderBy("tick")


def observations(df: DataFrame) -> DataFrame:
    """Rows with finite places."""
    ok = F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y") & (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    return df.where(ok)


def latest(obs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(track_id, x, y, tick, length): the newest place and the lifetime length."""
    return obs.groupBy(*by, "track_id").agg(F.max(F.struct("tick", "x", "y")).alias("r"), F.count("*").alias("length")).select(*by, "track_id", "r.tick", "r.x", "r.y", "length")


def flow(obs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(track_id, dx, dy): the newest place less the one before; 0 for a track of one place. Two rows a track are kept in
    the aggregate, so no sort of whole tracks is needed."""
    last = obs.groupBy(*by, "track_id").agg(F.max(F.struct("tick", "x", "y")).alias("b"))
    before = obs.join(last, [*by, "track_id"]).where(F.col("tick") < F.col("b.tick")).groupBy(*by, "track_id").agg(F.max(F.struct("tick", "x", "y")).alias("a"))
    both = last.join(before, [*by, "track_id"], "left")
    return both.select(*by, "track_id", F.coalesce(F.col("b.x") - F.col("a.x"), F.lit(0.0)).alias("dx"), F.coalesce(F.col("b.y") - F.col("a.y"), F.lit(0.0)).alias("dy"))


def confident(obs: DataFrame, by: Sequence[str] = (), least: int = 4) -> DataFrame:
    return latest(obs, by).where(F.col("length") >= least)


def matches(obs: DataFrame, by: Sequence[str] = (), i: int = -2, j: int = -1) -> DataFrame:
    """(track_id, x_i, y_i, x_j, y_j): places counted from the end (-1 is the newest) of tracks longer than both."""
    reach = max(abs(i), abs(j))
    back = Window.partitionBy(*by, "track_id").orderBy(F.col("tick").desc())
    n = obs.withColumn("_r", F.row_number().over(back)).where(F.col("_r") <= reach + 1)
    at = lambda c, k: F.max(F.when(F.col("_r") == -k, F.col(c)))
    got = n.groupBy(*by, "track_id").agg(*[at(c, k).alias(f"{c}_{s}") for s, k in (("i", i), ("j", j)) for c in "xy"], F.max("_r").alias("_n"))
    return got.where(F.col("_n") > reach).drop("_n")


def alive(obs: DataFrame, at: Column | int, by: Sequence[str] = ()) -> DataFrame:
    """(track_id, last, dead): a track is dead if it has no place at the tick."""
    at = at if isinstance(at, Column) else F.lit(at)
    return obs.where(F.col("tick") <= at).groupBy(*by, "track_id").agg(F.max("tick").alias("last")).withColumn("dead", F.col("last") < at)


def deaths(obs: DataFrame, by: Sequence[str] = (), gap: int = 1) -> DataFrame:
    """(track_id, last, length) of tracks that were pruned: their newest tick is over `gap` before the camera's."""
    end = obs.groupBy(*by).agg(F.max("tick").alias("_end"))
    ends = latest(obs, by).withColumnRenamed("tick", "last")
    joined = ends.join(end, list(by)) if by else ends.crossJoin(F.broadcast(end))
    return joined.where(F.col("last") < F.col("_end") - gap + 1).select(*by, "track_id", "last", "length")


def assign_ids(detections: DataFrame, known: DataFrame, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """New tracks for detections: ids go on from the camera's greatest, in the given order."""
    top = known.groupBy(*by).agg(F.max("track_id").alias("_top"))
    joined = detections.join(top, list(by), "left") if by else detections.crossJoin(F.broadcast(top))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return joined.withColumn("track_id", (F.coalesce("_top", F.lit(-1)) + rank).cast("bigint")).drop("_top")


def bounded_history(obs: DataFrame, n: int, by: Sequence[str] = ()) -> DataFrame:
    """The newest n places of each track."""
    back = Window.partitionBy(*by, "track_id").orderBy(F.col("tick").desc())
    return obs.withColumn("_r", F.row_number().over(back)).where(F.col("_r") <= n).drop("_r")


def forward_backward(df: DataFrame, tol: float = 1.5) -> DataFrame:
    """Keeps flows that come back: |x0 - xr| and |y0 - yr| both below tol."""
    return df.where((F.abs(F.col("x0") - F.col("xr")) < tol) & (F.abs(F.col("y0") - F.col("yr")) < tol))


def strongest_per_cell(points: DataFrame, by: Sequence[str], h: float, w: float, grid: tuple[int, int] = (12, 10), most: int = 1200) -> DataFrame:
    """At most most / cells points of each grid cell, by falling response (ties by x, y)."""
    rows, cols = grid
    cell = points.withColumn("_r", F.floor(F.col("y") * rows / h)).withColumn("_c", F.floor(F.col("x") * cols / w))
    rank = F.row_number().over(Window.partitionBy(*by, "_r", "_c").orderBy(F.col("response").desc(), "x", "y"))
    return cell.withColumn("_k", rank).where(F.col("_k") <= max(1, most // (rows * cols))).drop("_r", "_c", "_k")


def scene_flow(pixels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """pixels (src, x, y, u, v): source pixel, place and projected place -> for each target pixel (int u, int v) the flow of
    the last source that lands there. Targets without source have no row: NaN in a dense image."""
    tx, ty = F.col("u").cast("int"), F.col("v").cast("int")
    last = F.max_by(F.struct("x", "y", "u", "v"), "src")
    got = pixels.groupBy(*by, tx.alias("tx"), ty.alias("ty")).agg(last.alias("s"))
    return got.select(*by, "tx", "ty", (F.col("s.u") - F.col("s.x")).alias("dx"), (F.col("s.v") - F.col("s.y")).alias("dy"))


def colour_index(track_id: Column, colours: int = 20) -> Column:
    return F.pmod(track_id, F.lit(colours))


def lag_flow(obs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Every observation with its step from the one before (0 for the first)."""
    w = _w(by)
    return obs.withColumn("dx", F.coalesce(F.col("x") - F.lag("x").over(w), F.lit(0.0))).withColumn("dy", F.coalesce(F.col("y") - F.lag("y").over(w), F.lit(0.0)))


#: Rounding bounds of the two determinants below, relative to the sums of their terms' sizes.
_TURN_BOUND, _CIRCLE_BOUND = 4e-16, 12e-16


def _turn(p: list, a: int, b: int, c: int) -> int:
    """The sign of the turn a, b, c: 1 to the left. Exact: where rounding could matter, in fractions."""
    (ax, ay), (bx, by), (cx, cy) = p[a], p[b], p[c]
    left, right = (ax - cx) * (by - cy), (ay - cy) * (bx - cx)
    d = left - right
    if abs(d) > _TURN_BOUND * (abs(left) + abs(right)):
        return 1 if d > 0 else -1
    ax, ay, bx, by, cx, cy = map(Fraction, (ax, ay, bx, by, cx, cy))
    d = (ax - cx) * (by - cy) - (ay - cy) * (bx - cx)
    return (d > 0) - (d < 0)


def _in_circle(p: list, a: int, b: int, c: int, d: int) -> bool:
    """Whether d is inside the circle of the left turn a, b, c. Of four points on one circle the least (by x, then y) counts as
    a little nearer than it is, so that the triangles between them fan out from it, whatever the order of insertion."""
    (ax, ay), (bx, by), (cx, cy), (dx, dy) = p[a], p[b], p[c], p[d]

    def terms(ax, ay, bx, by, cx, cy):
        aa, bb, cc = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
        return (aa, bx * cy, cx * by), (bb, cx * ay, ax * cy), (cc, ax * by, bx * ay)

    near = terms(ax - dx, ay - dy, bx - dx, by - dy, cx - dx, cy - dy)
    det = sum(s * (u - v) for s, u, v in near)
    if abs(det) > _CIRCLE_BOUND * sum(s * (abs(u) + abs(v)) for s, u, v in near):
        return det > 0
    ax, ay, bx, by, cx, cy, dx, dy = map(Fraction, (ax, ay, bx, by, cx, cy, dx, dy))
    det = sum(s * (u - v) for s, u, v in terms(ax - dx, ay - dy, bx - dx, by - dy, cx - dx, cy - dy))
    if det:
        return det > 0
    least = min((a, b, c, d), key=lambda i: p[i])
    if least == d:
        return True
    # a little nearer, it takes d out of the circle if its part of the determinant has the sign of a left turn
    others = {a: (b, c, d), b: (c, a, d), c: (a, b, d)}[least]
    return _turn(p, *others) < 0


def delaunay(xy: np.ndarray) -> np.ndarray:
    """Triangles (rows of three places, in rising order, sorted) whose circumcircles hold no other point; of points on one circle see
    _in_circle. Points must differ; points on one line have no triangles.

    Points are put in along a path that goes to and fro over strips, so that each is near the one before; its triangle is found by
    walking from there. Triangles whose circle holds the point are dug out, neighbour by neighbour, and their outline
    is joined to it. The outside is made of triangles with a point -1 at infinity. Decisions are exact.
    """
    n = len(xy)
    if n < 3:
        return np.empty((0, 3), int)
    strips = max(1, int((n / 2) ** 0.5))
    width = max(float(np.ptp(xy[:, 0])), 1e-300) / strips
    strip = np.minimum(((xy[:, 0] - xy[:, 0].min()) / width).astype(int), strips - 1)
    order = np.lexsort((np.where(strip % 2, -xy[:, 1], xy[:, 1]), strip)).tolist()
    p = list(map(tuple, xy.tolist()))
    third = next((k for k in range(2, n) if _turn(p, order[0], order[1], order[k])), None)
    if third is None:
        return np.empty((0, 3), int)
    order.insert(2, order.pop(third))
    a, b, c = order[:3]
    if _turn(p, a, b, c) < 0:
        a, b = b, a
    apex: dict[tuple[int, int], int] = {}  # the third point of the triangle to the left of each side

    def put(a: int, b: int, c: int) -> None:
        apex[a, b], apex[b, c], apex[c, a] = c, a, b

    for t in ((a, b, c), (b, a, -1), (c, b, -1), (a, c, -1)):
        put(*t)

    def broken(u: int, v: int, w: int, i: int) -> bool:
        if u >= 0 and v >= 0 and w >= 0:
            return _in_circle(p, u, v, w, i)
        x, y = (u, v) if w < 0 else (v, w) if u < 0 else (w, u)
        side = _turn(p, x, y, i)
        return side > 0 or side == 0 and min(p[x], p[y]) < p[i] < max(p[x], p[y])

    at = (a, b, c)
    for i in order[3:]:
        u, v, w = at
        while True:  # walk: over a side that the point is beyond
            for x, y in ((u, v), (v, w), (w, u)):
                if _turn(p, x, y, i) < 0:
                    u, v, w = y, x, apex[y, x]
                    break
            else:
                break
            if w < 0:
                break
        sides = [(u, v), (v, w), (w, u)]
        for side in sides:
            del apex[side]
        rim = []
        while sides:
            x, y = sides.pop()
            z = apex.get((y, x))
            if z is not None and broken(y, x, z, i):
                for side in ((y, x), (x, z), (z, y)):
                    del apex[side]
                sides += [(x, z), (z, y)]
            elif (y, x) in apex:
                rim.append((x, y))
        for x, y in rim:
            put(x, y, i)
            if x >= 0 and y >= 0:
                at = (x, y, i)
    got = sorted(tuple(sorted((u, v, w))) for (u, v), w in apex.items() if 0 <= u < v and u < w)
    return np.array(got, int).reshape(-1, 3)


def mesh(points: DataFrame, by: list[str], track_id: str = "track_id") -> DataFrame:
    """Places (by, track_id, x, y) -> (by, a, b, c): the triangles between the tracks of each picture, by rising track. A
    picture's tracks meet in one task; places that come twice count once, under the least track."""
    once = points.groupBy(*by, "x", "y").agg(F.min(track_id).alias("id"))
    fields = ", ".join(f"`{c}` {points.schema[c].dataType.simpleString()}" for c in by)
    kind = points.schema[track_id].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        ids = pdf["id"].to_numpy()
        t = delaunay(pdf[["x", "y"]].to_numpy(float))
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] * len(t) for c in by}, "a": ids[t[:, 0]], "b": ids[t[:, 1]], "c": ids[t[:, 2]]})

    return once.groupBy(*by).applyInPandas(run, f"{fields}{', ' if by else ''}a {kind}, b {kind}, c {kind}")


def mesh_edges(triangles: DataFrame, by: list[str]) -> DataFrame:
    """(by, a, b): each side of a triangle once."""
    sides = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("a"), F.col("c").alias("b")), F.struct(F.col("b").alias("a"), F.col("c").alias("b"))))
    return triangles.select(*by, sides.alias("s")).select(*by, "s.a", "s.b").distinct()


def mesh_neighbours(triangles: DataFrame, by: list[str]) -> DataFrame:
    """(by, track, near): for each track its neighbours in the mesh, sorted."""
    e = mesh_edges(triangles, by)
    both = e.select(*by, F.col("a").alias("track"), F.col("b").alias("n")).unionByName(e.select(*by, F.col("b").alias("track"), F.col("a").alias("n")))
    return both.groupBy(*by, "track").agg(F.array_sort(F.collect_set("n")).alias("near"))
