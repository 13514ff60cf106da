"""Matching, mining and suppression of boxes.

Tables have image columns (`by`), an id and x1, y1, x2, y2. Pairs are joined on the image; with a cell size, also on grid
cells, so that one crowded image is dealt over many tasks: a box goes to the cells it touches, and a pair is only made
in the cell that holds the corner of its intersection, so no pair comes twice.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import bbox
from orrery.operators import overlaps

XY = ("x1", "y1", "x2", "y2")


def _cells(df: DataFrame, cell: float, prefix: str, border: int = 0) -> DataFrame:
    """A row for each cell that a box touches; border: pixels that count as part of it on its far sides."""
    at = lambda c, more=0: F.floor((F.col(f"{prefix}.{c}") + more) / cell)
    cells = df.withColumn("_cx", F.explode(F.sequence(at("x1"), at("x2", border))))
    return cells.withColumn("_cy", F.explode(F.sequence(at("y1"), at("y2", border))))


def pairs(truth: DataFrame, test: DataFrame, by: Sequence[str], cell: float | None = None, disjoint: bool = False, inclusive: bool = False) -> DataFrame:
    """(by, a: truth row, b: test row, iou) of pairs in an image that overlap; with disjoint=True all pairs."""
    a = truth.select(*by, F.struct(*[c for c in truth.columns if c not in by]).alias("a"))
    b = test.select(*by, F.struct(*[c for c in test.columns if c not in by]).alias("b"))
    keys = list(by)
    if cell and not disjoint:
        border = 1 if inclusive else 0
        a, b, keys = _cells(a, cell, "a", border), _cells(b, cell, "b", border), [*by, "_cx", "_cy"]
    joined = a.join(b, keys)
    one = 1 if inclusive else 0
    if not disjoint:
        joined = joined.where((F.col("a.x1") < F.col("b.x2") + one) & (F.col("b.x1") < F.col("a.x2") + one) & (F.col("a.y1") < F.col("b.y2") + one) & (F.col("b.y1") < F.col("a.y2") + one))
    if cell and not disjoint:
        corner = lambda k: F.floor(F.greatest(F.col(f"a.{k}"), F.col(f"b.{k}")) / cell)
        joined = joined.where((F.col("_cx") == corner("x1")) & (F.col("_cy") == corner("y1"))).drop("_cx", "_cy")
    return joined.withColumn("iou", bbox.iou(F.col("a"), F.col("b"), inclusive))


def matches(truth: DataFrame, test: DataFrame, by: Sequence[str], threshold: float = 0.5, label: str | None = None, cell: float | None = None) -> DataFrame:
    """Pairs with IoU above the threshold, and equal labels if a label column is named."""
    keys = [*by, label] if label else list(by)
    return pairs(truth, test, keys, cell).where(F.col("iou") > threshold)


#: Rows that leave a task at a time.
_SENT = 200_000

Sides = tuple[pa.Array, np.ndarray, pa.Array, np.ndarray]


def _sides(truth: DataFrame, test: DataFrame, keys: Sequence[str], box_id: str, run: Callable[[Sides], Iterator[dict]], out: str, sent: Sequence[str] | None = None) -> DataFrame:
    """(sent: keys by default, out) of run over the sides of each group (ids and boxes of truth and test) that has both; it yields columns. A task
    holds a group's places, not its pairs. Groups with a null among their keys have none. Rows leave as Arrow numbers."""
    some = " AND ".join(f"`{c}` IS NOT NULL" for c in keys)
    both = truth.select(*keys, F.col(box_id).alias("_id"), *[F.col(c).cast("double").alias(c) for c in XY], F.lit(True).alias("_truth"))
    both = both.unionByName(test.select(*keys, F.col(box_id).alias("_id"), *[F.col(c).cast("double").alias(c) for c in XY], F.lit(False).alias("_truth"))).where(some)
    sent = list(keys if sent is None else sent)
    fields = ", ".join(f"`{c}` {both.schema[c].dataType.simpleString()}" for c in sent)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        group = [t.column(c)[0] for c in sent]
        side, ids = t.column("_truth").to_numpy().astype(bool), t.column("_id").combine_chunks()
        places = np.stack([t.column(c).to_numpy() for c in XY], 1)
        if side.any() and not side.all():
            part = lambda s: (ids.filter(pa.array(s)), places[s])
            for columns in run((*part(side), *part(~side))):
                values = [pa.array(v) for v in columns.values()]
                yield pa.RecordBatch.from_arrays([*(pa.repeat(g, len(values[0])) for g in group), *values], names=[*sent, *columns])

    return both.groupBy(*keys).applyInArrow(one, f"{fields}, {out}")


def match_ids(truth: DataFrame, test: DataFrame, by: Sequence[str], box_id: str, threshold: float = 0.5, label: str | None = None, labelled: bool = True) -> DataFrame:
    """(by, label if named and labelled, truth_id, test_id, iou): the pairs of `matches`, for a threshold of 0 or more, found by blocks. There
    may be as many rows as pairs; they leave the task in pieces."""
    keys = [*by, label] if label else list(by)
    slim = truth.select(box_id)
    kind = slim.schema[box_id].dataType.simpleString()

    def run(sides: Sides) -> Iterator[dict]:
        ids, a, others, b = sides
        held, n = [], 0

        def columns() -> dict:
            i, j, iou = map(np.concatenate, zip(*held, strict=True))
            return {"truth_id": ids.take(pa.array(i)), "test_id": others.take(pa.array(j)), "iou": iou}

        for rows, cols, iou in overlaps.blocks(a, b, threshold):
            at = np.flatnonzero(iou > threshold)
            held.append((rows[at // len(cols)], cols[at % len(cols)], iou.ravel()[at]))
            n += len(at)
            if n >= _SENT:
                yield columns()
                held, n = [], 0
        if n:
            yield columns()

    return _sides(truth, test, keys, box_id, run, f"truth_id {kind}, test_id {kind}, iou double", keys if labelled else by)


def match_totals(truth: DataFrame, test: DataFrame, by: Sequence[str], box_id: str, threshold: float = 0.5, inclusive: bool = False) -> DataFrame:
    """(by, n, total): count and sum of the overlaps above the threshold (0 or more) in each image that has any. The work still grows with
    the pairs of different boxes, but in blocks of numbers: no pair is a row."""

    def run(sides: Sides) -> Iterator[dict]:
        n, total = overlaps.totals(sides[1], sides[3], threshold, 1.0 if inclusive else 0.0)
        if n:
            yield {"n": [n], "total": [total]}

    return _sides(truth, test, by, box_id, run, "n bigint, total double")


#: Boxes of a chunk; chunks that are compared at a time.
_CHUNK, _AT_ONCE = 64, 8


def _area(x: np.ndarray) -> np.ndarray:
    return (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])


def _ordered(x: np.ndarray) -> np.ndarray:
    """Boxes in an order that keeps like ones together: by the bits of their four numbers in turn."""
    x = np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0)
    low, span = x.min(0), np.maximum(x.max(0) - x.min(0), 1e-300)
    q = np.clip((x - low) / span * 255, 0, 255).astype(np.int64)
    key = sum(((q[:, c] >> bit) & 1) << (4 * bit + c) for bit in range(8) for c in range(4))
    return np.argsort(key, kind="stable")


def _chunked(x: np.ndarray) -> tuple[list[slice], np.ndarray, np.ndarray, np.ndarray]:
    """Slices of ordered boxes, with their least and greatest numbers and least area."""
    cuts = [slice(k, k + _CHUNK) for k in range(0, len(x), _CHUNK)]
    starts = np.arange(0, len(x), _CHUNK)
    return cuts, np.minimum.reduceat(x, starts, 0), np.maximum.reduceat(x, starts, 0), np.maximum(np.minimum.reduceat(_area(x), starts), 0)


#: Overlap that is looked for first, pairs that a level may have for each open box, and comparisons below which levels don't pay.
_FIRST, _PAIRS, _PLAIN = 0.95, 64, 1 << 26


def best_overlaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The best overlap of each box of p with those of q. Equal boxes are compared once. The best ones are found by trees, level by level:
    all pairs that overlap by 0.95 or more, then, for boxes that have none, by 0.9, 0.8 and so on. Few boxes, and those of a level
    with very many pairs, go by chunks."""
    out = np.zeros(len(p))
    p_at, q = np.flatnonzero(np.isfinite(p).all(1)), q[np.isfinite(q).all(1)]
    if not len(p_at) or not len(q):
        return out
    p, back = np.unique(p[p_at], axis=0, return_inverse=True)
    q = np.unique(q, axis=0)
    best, rest, gap, found = np.zeros(len(p)), np.arange(len(p)), 1 - _FIRST, False
    while len(rest) * len(q) > _PLAIN and 1e-4 < gap < 1:
        got, n = np.zeros(len(rest)), 0
        for i, _, iou in overlaps.near_pairs(p[rest], q, 1 - gap):
            np.maximum.at(got, i, iou)
            n += len(i)
            if n > _PAIRS * len(p):
                break
        if n > _PAIRS * len(p):
            if found:
                break
            gap /= 2
            continue
        best[rest], found = got, True
        rest = rest[got == 0]
        gap *= 2
    if len(rest):
        best[rest] = _best_by_chunks(p[rest], q)
    out[p_at] = best[back.ravel()]
    return out


def _best_by_chunks(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """best_overlaps of different finite boxes: like ones lie in chunks, and chunks whose corners say that they can't overlap better
    than what is found are left out."""
    order = _ordered(p)
    p, q = p[order], q[_ordered(q)]
    best, area_p, area_q = np.zeros(len(p)), _area(p), _area(q)
    cuts, low_p, high_p, least_p = _chunked(p)
    others, low_q, high_q, least_q = _chunked(q)
    for k, cut in enumerate(cuts):
        inner = np.clip(np.minimum(high_p[k, 2:], high_q[:, 2:]) - np.maximum(low_p[k, :2], low_q[:, :2]), 0, None).prod(1)
        union = np.maximum(least_p[k] + least_q - inner, np.maximum(least_p[k], least_q))
        bound = np.where(inner > 0, np.minimum(1, np.divide(inner, union, out=np.ones_like(inner), where=union > 0)) * (1 + 1e-9), 0.0)
        a = p[cut]
        visit = np.argsort(-bound, kind="stable")
        for g in range(0, len(visit), _AT_ONCE):
            if bound[visit[g]] <= best[cut].min():
                break
            at = np.concatenate([np.arange(others[j].start, min(others[j].stop, len(q))) for j in visit[g : g + _AT_ONCE]])
            b = q[at]
            w = np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0])
            h = np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1])
            both = np.where((w > 0) & (h > 0), w * h, 0.0)
            union = area_p[cut][:, None] + area_q[at][None, :] - both
            best[cut] = np.maximum(best[cut], np.divide(both, union, out=np.zeros_like(both), where=both > 0).max(1, initial=0.0))
    out = np.empty(len(p))
    out[order] = best
    return out


def _best_by_image(truth: DataFrame, test: DataFrame, by: Sequence[str], box_id: str) -> DataFrame:
    """best_iou of images whose boxes fit into a task: chunks of truth boxes against chunks of their image's test boxes, so
    no pair becomes a row (see best_overlaps)."""
    a = truth.select(*by, box_id, *XY)
    b = test.where(" AND ".join(f"`{c}` IS NOT NULL" for c in by)).select(*[F.col(c).alias(f"_{c}") for c in (*by, *XY)])  # own names: both may come of one table
    fields = ", ".join(f"`{c}` {a.schema[c].dataType.simpleString()}" for c in [*by, box_id])

    def run(one: pa.Table, other: pa.Table) -> pa.Table:
        numbers = lambda t, names: np.stack([t.column(c).cast(pa.float64()).to_numpy() for c in names], 1) if t.num_rows else np.empty((0, 4))
        best = best_overlaps(numbers(one, XY), numbers(other, [f"_{c}" for c in XY]))
        return one.select([*by, box_id]).append_column("iou", pa.array(best))

    return a.groupBy(*by).cogroup(b.groupBy(*[f"_{c}" for c in by])).applyInArrow(run, f"{fields}, iou double")


def best_iou(truth: DataFrame, test: DataFrame, by: Sequence[str], box_id: str, cell: float | None = None, match: bool = False) -> DataFrame:
    """(by, id, iou): the best overlap of each truth box, 0 where nothing overlaps. match=True adds the test box that has
    it (ties go to the smallest id; null where nothing overlaps), at the price of a sorting aggregate. With a cell size, images of
    up to CROWDED boxes on either side are compared as a whole, others by cells."""
    if cell and not match and by:
        sides = [d.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > CROWDED).select(*by) for d in (truth, test)]
        full = sides[0].union(sides[1]).distinct()
        if full.isEmpty():
            return _best_by_image(truth, test, by, box_id)
        few, many = ([d.join(full, list(by), how) for d in (truth, test)] for how in ("left_anti", "left_semi"))
        return _best_by_image(*few, by, box_id).unionByName(_best_by_cells(*many, by, box_id, cell, False))
    return _best_by_cells(truth, test, by, box_id, cell, match)


def _best_by_cells(truth: DataFrame, test: DataFrame, by: Sequence[str], box_id: str, cell: float | None, match: bool) -> DataFrame:
    found = pairs(truth, test, by, cell).select(*by, F.col(f"a.{box_id}").alias(box_id), F.col(f"b.{box_id}").alias("_m"), "iou").groupBy(*by, box_id)
    if match:
        best = found.agg(F.max(F.struct("iou", (-F.col("_m")).alias("neg"))).alias("m")).select(*by, box_id, F.col("m.iou").alias("iou"), (-F.col("m.neg")).alias("match"))
    else:
        best = found.agg(F.max("iou").alias("iou"))
    return truth.select(*by, box_id).join(best, [*by, box_id], "left").withColumn("iou", F.coalesce("iou", F.lit(0.0)))


def recall_curve(best: DataFrame, samples: int = 500) -> DataFrame:
    """(threshold, recall) at evenly spaced thresholds from 0 to 1: rows are counted by the threshold that they reach, then
    summed from the top, so each row is read once."""
    # the largest k with k / (samples - 1) <= iou; the division is what a threshold is, so ties agree with it
    guess = F.floor(F.col("iou") * (samples - 1)).cast("int")
    up = F.when((guess + 1) / F.lit(float(samples - 1)) <= F.col("iou"), guess + 1).otherwise(guess)
    k = F.when(up / F.lit(float(samples - 1)) > F.col("iou"), up - 1).otherwise(up)
    counts = best.select(F.least(k, F.lit(samples - 1)).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    spine = best.sparkSession.range(samples).select(F.col("id").cast("int").alias("k"))
    from pyspark.sql import Window

    filled = F.broadcast(spine).join(counts, "k", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy())
    above = F.sum("n").over(Window.orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0))
    return filled.select((F.col("k") / F.lit(float(samples - 1))).alias("threshold"), F.try_divide(above, total).alias("recall"))


def label_pair_counts(truth: DataFrame, test: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    """(by, label, n): pairs of an image with equal labels, counted from the sides' counts: no pair is made."""
    a, b = (d.groupBy(*by, label).agg(F.count("*").alias(n)) for d, n in ((truth, "_a"), (test, "_b")))
    return a.join(b, [*by, label]).select(*by, label, (F.col("_a") * F.col("_b")).alias("n"))


def mine_negatives(proposals: DataFrame, truth: DataFrame, by: Sequence[str], box_id: str, most: int = 50, below: float = 0.1, cell: float | None = None) -> DataFrame:
    """Proposals whose best IoU with the image's truth is below a bound (all, if it has none): the first `most` by id."""
    from pyspark.sql import Window

    best = best_iou(proposals, truth, by, box_id, cell)
    hit = best.where((F.col("iou") >= below) & (F.col("iou") > 0)).select(*by, box_id)
    free = proposals.join(hit, [*by, box_id], "left_anti")
    return free.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(box_id))).where(F.col("_r") <= most).drop("_r")


def greedy_nms(boxes: np.ndarray, scores: np.ndarray, ids: np.ndarray, threshold: float, inclusive: bool = True, boundary: str = "gt") -> np.ndarray:
    """Rows kept: by falling score (ties by id), a box goes if an earlier kept one overlaps it by more than the threshold
    ('gt') or as much ('ge')."""
    one = 1.0 if inclusive else 0.0
    order = np.lexsort((ids, -scores))
    x1, y1, x2, y2 = boxes[order].T
    area = (x2 - x1 + one) * (y2 - y1 + one)
    alive, kept = np.ones(len(order), bool), []
    # boxes that reach a box begin no further before it than the widest is wide
    by_x = np.argsort(x1, kind="stable")
    starts, widest = x1[by_x], np.max(x2 - x1, initial=0.0)
    local = threshold > 0 and np.isfinite(boxes).all()
    for i in range(len(order)):
        if not alive[i]:
            continue
        kept.append(order[i])
        near = by_x[np.searchsorted(starts, x1[i] - widest - 1 - one) : np.searchsorted(starts, x2[i] + 1 + one, "right")] if local else by_x
        rest = near[alive[near] & (near > i)]
        w = np.maximum(0.0, np.minimum(x2[i], x2[rest]) - np.maximum(x1[i], x1[rest]) + one)
        h = np.maximum(0.0, np.minimum(y2[i], y2[rest]) - np.maximum(y1[i], y1[rest]) + one)
        common = w * h
        ratio = common / (area[i] + area[rest] - common)
        alive[rest[ratio > threshold if boundary == "gt" else ratio >= threshold]] = False
    return np.array(kept, int)


#: Boxes of an image above which its best overlaps and its suppression are dealt over tasks. Below it a task holds the image's
#: places only (some 100 MB), and its work is bounded by the boxes kept, or by chunks of like boxes.
CROWDED = 1_000_000


def nms(df: DataFrame, by: Sequence[str], box_id: str, threshold: float = 0.3, inclusive: bool = True, boundary: str = "gt", crowded: int = CROWDED, cell: float = 64.0) -> DataFrame:
    """Greedy suppression in each image: rows kept, all columns. The boxes of an image meet in one task, as each decision
    depends on the earlier ones; those of an image with more than `crowded` are decided in rounds over pairs (see
    nms_in_rounds), to the same result. Ids are unique in an image."""
    full = df.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > crowded).select(*by)
    rounds = None
    if full.limit(1).count():
        rounds = nms_in_rounds(df.join(full, list(by), "left_semi"), by, box_id, threshold, inclusive, boundary, cell)
        df = df.join(full, list(by), "left_anti")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = greedy_nms(pdf[list(XY)].to_numpy(float), pdf["score"].to_numpy(float), pdf[box_id].to_numpy(), threshold, inclusive, boundary)
        return pdf.iloc[np.sort(kept)]

    alone = df.groupBy(*by).applyInPandas(run, df.schema)
    return alone.unionByName(rounds) if rounds is not None else alone


def nms_in_rounds(df: DataFrame, by: Sequence[str], box_id: str, threshold: float = 0.3, inclusive: bool = True, boundary: str = "gt", cell: float = 64.0) -> DataFrame:
    """The same suppression over pairs of boxes that overlap enough, found by grid cells. In each round the boxes that
    no open box before them overlaps are kept, and the open boxes that a kept one overlaps go. There are as many
    rounds as the longest chain of such decisions needs; each is checkpointed."""
    context, spark = df.sparkSession.sparkContext, df.sparkSession
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="orrery-checkpoint-"))
    keys = [*by, box_id]
    slim = df.select(*keys, *XY, "score")
    over = F.col("iou") > threshold if boundary == "gt" else F.col("iou") >= threshold
    first = (F.col("a.score") > F.col("b.score")) | ((F.col("a.score") == F.col("b.score")) & (F.col(f"a.{box_id}") < F.col(f"b.{box_id}")))
    edges = pairs(slim, slim, by, cell, inclusive=inclusive).where(over & first).select(*by, F.col(f"a.{box_id}").alias("_a"), F.col(f"b.{box_id}").alias("_b")).checkpoint()
    ids = lambda d, c: d.select(*by, F.col(c).alias(box_id)).distinct()
    still = lambda e, d, c: e.join(d.withColumnRenamed(box_id, c), [*by, c], "left_semi")
    open_, kept = slim.select(*keys).checkpoint(), None
    while open_.limit(1).count():
        now = open_.join(ids(edges, "_b"), keys, "left_anti").checkpoint()
        gone = ids(still(edges, now, "_a"), "_b")
        open_ = open_.join(now, keys, "left_anti").join(gone, keys, "left_anti").checkpoint()
        edges = still(still(edges, open_, "_a"), open_, "_b").checkpoint()
        kept = now if kept is None else kept.union(now)
    return df.join(kept, keys, "left_semi") if kept is not None else df.where("false")


def points_in_boxes(points: DataFrame, boxes: DataFrame, by: Sequence[str] = (), cell: float = 32.0) -> DataFrame:
    """Pairs of points (x, y) and the boxes that hold them, edges included, joined on grid cells."""
    b = boxes.withColumn("_cx", F.explode(F.sequence(F.floor(F.col("x1") / cell), F.floor(F.col("x2") / cell)))).withColumn("_cy", F.explode(F.sequence(F.floor(F.col("y1") / cell), F.floor(F.col("y2") / cell))))
    p = points.withColumn("_cx", F.floor(F.col("x") / cell)).withColumn("_cy", F.floor(F.col("y") / cell))
    inside = (F.col("x") >= F.col("x1")) & (F.col("x") <= F.col("x2")) & (F.col("y") >= F.col("y1")) & (F.col("y") <= F.col("y2"))
    return p.join(b, [*by, "_cx", "_cy"]).where(inside).drop("_cx", "_cy")


def boxes_at_points(points: DataFrame, boxes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """points (x, y) with n, the number of boxes that hold each, edges included; points that none holds go. No pair is made: a box
    counts up at its first corner, down behind its sides and up behind both, and equal corners are counted first. How many
    corners lie before a place in both directions is a sum over blocks of ranks of x (a block at each power of two), in each of
    which it is a running sum by y. Only the different x of corners and places are ranked in one task for each group."""
    from pyspark.sql import Window

    xy = lambda c: F.col(c).cast("double")
    corner = lambda x, sx, y, sy, n: F.struct(xy(x).alias("_x"), F.lit(sx).alias("_sx"), xy(y).alias("_y"), F.lit(sy).alias("_sy"), F.lit(n).cast("bigint").alias("_n"))
    # side 0 counts from its place on, 1 is a point, 2 counts behind its place
    four = F.array(corner("x1", 0, "y1", 0, 1), corner("x2", 2, "y1", 0, -1), corner("x1", 0, "y2", 2, -1), corner("x2", 2, "y2", 2, 1))
    corners = boxes.where("x1 <= x2 AND y1 <= y2").select(*by, F.explode(four).alias("_c")).select(*by, "_c.*").groupBy(*by, "_x", "_sx", "_y", "_sy").agg(F.sum("_n").alias("_n")).where("_n <> 0")
    places = points.select(*by, xy("x").alias("_x"), F.lit(1).alias("_sx"), xy("y").alias("_y"), F.lit(1).alias("_sy")).where("_x IS NOT NULL AND _y IS NOT NULL").distinct()
    whole = Window.partitionBy(*by)
    ranks = corners.select(*by, "_x", "_sx").union(places.select(*by, "_x", "_sx")).distinct()
    ranks = ranks.withColumn("_r", F.row_number().over(whole.orderBy("_x", "_sx")).cast("bigint")).withColumn("_top", F.max("_r").over(whole))
    at = lambda d: d.join(ranks, [*by, "_x", "_sx"]).withColumn("_l", F.explode(F.sequence(F.lit(0), F.ceil(F.log2(F.col("_top") + 1)).cast("int")))).withColumn("_b", F.expr("shiftright(_r, _l)"))
    node = [*by, "_l", "_b"]
    counted = at(corners).where("_b % 2 = 0").groupBy(*node, "_y", "_sy").agg(F.sum("_n").alias("_n")).withColumn("_x", F.lit(None).cast("double"))
    asked = at(places).where("_b % 2 = 1").withColumn("_b", F.col("_b") - 1).select(*node, "_y", "_sy", F.lit(0).cast("bigint").alias("_n"), "_x")
    before = F.sum("_n").over(Window.partitionBy(*node).orderBy("_y", "_sy"))
    held = counted.select(*asked.columns).union(asked).withColumn("_m", before).where("_sy = 1").groupBy(*by, "_x", "_y").agg(F.sum("_m").alias("n")).where("n > 0")
    here = points.withColumn("_x", xy("x")).withColumn("_y", xy("y"))
    return here.join(held, [*by, "_x", "_y"]).select(*points.columns, "n")


def away_from(points: DataFrame, taken: DataFrame, by: Sequence[str], radius: float) -> DataFrame:
    """Points with no taken point within the radius (city-block mask off: Euclidean), by an anti-join on grid cells."""
    cell = float(radius)
    p = points.withColumn("_cx", F.floor(F.col("x") / cell)).withColumn("_cy", F.floor(F.col("y") / cell))
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    t = taken.select(*by, F.col("x").alias("_tx"), F.col("y").alias("_ty")).withColumn("_dx", F.explode(near)).withColumn("_dy", F.explode(near))
    t = t.select(*[F.col(c).alias(f"_k_{c}") for c in by], "_tx", "_ty", (F.floor(F.col("_tx") / cell) + F.col("_dx")).alias("_gx"), (F.floor(F.col("_ty") / cell) + F.col("_dy")).alias("_gy"))
    same = (F.col("_cx") == F.col("_gx")) & (F.col("_cy") == F.col("_gy"))
    for c in by:
        same = same & (F.col(c) == F.col(f"_k_{c}"))
    close = (F.col("x") - F.col("_tx")) * (F.col("x") - F.col("_tx")) + (F.col("y") - F.col("_ty")) * (F.col("y") - F.col("_ty")) <= radius * radius
    return p.join(t, same & close, "left_anti").drop("_cx", "_cy")


def around(points: DataFrame, by: Sequence[str], whole: bool = False) -> DataFrame:
    """The box of each group's points; whole casts to integers."""
    kind = "bigint" if whole else "double"
    return points.groupBy(*by).agg(*[f(c).cast(kind).alias(n) for n, f, c in (("x1", F.min, "x"), ("y1", F.min, "y"), ("x2", F.max, "x"), ("y2", F.max, "y"))])


def all_in_bounds(boxes: DataFrame, by: Sequence[str], h: float, w: float) -> DataFrame:
    ok: Column = F.bool_and((F.col("x1") >= 0) & (F.col("x2") < w) & (F.col("y1") >= 0) & (F.col("y2") < h))
    return boxes.groupBy(*by).agg(ok.alias("inbounds"))


def hull_order(points: np.ndarray) -> np.ndarray:
    """Indices of the convex hull, counter-clockwise, from the lowest-left point (monotone chain)."""
    order = np.lexsort((points[:, 1], points[:, 0]))
    order = [i for k, i in enumerate(order) if k == 0 or (points[i] != points[order[k - 1]]).any()]
    if len(order) < 3:
        return np.array(order, int)

    def half(seq: list[int]) -> list[int]:
        out: list[int] = []
        for i in seq:
            while len(out) > 1:
                (ax, ay), (bx, by_), (cx, cy) = points[out[-2]], points[out[-1]], points[i]
                if (bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax) > 0:
                    break
                out.pop()
            out.append(i)
        return out[:-1]

    return np.array(half(order) + half(order[::-1]), int)


#: Points that a task holds before it takes the hulls of what it has.
_HELD = 200_000


def convex_hull(points: DataFrame, by: Sequence[str], ccw: bool = True) -> DataFrame:
    """(by, pos, x, y): the hull of each group, points on its edges left out. With ccw=False in reverse, as images have y down.

    Each task first takes the hulls of the groups in its own rows, so that a group of any size sends a few points of each task;
    the hull of these hulls is the group's. Points without a finite place are left out."""
    slim = points.where("x IS NOT NULL AND y IS NOT NULL AND abs(x) < double('infinity') AND abs(y) < double('infinity')").select(*by, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    fields = ", ".join(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in by)

    def hulls(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [g.iloc[hull_order(g[["x", "y"]].to_numpy())] for _, g in pdf.groupby(list(by), dropna=False, sort=False)]
        return pd.concat(parts, ignore_index=True) if parts else pdf

    def partial(batches):
        held = None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if len(held) > _HELD:
                held = hulls(held)
                if len(held) > _HELD // 2:  # many groups: send them on
                    yield held
                    held = None
        if held is not None:
            yield hulls(held)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        xy = pdf[["x", "y"]].to_numpy()
        at = hull_order(xy)
        at = at if ccw else at[::-1]
        return pd.DataFrame({**{c: pdf[c].iloc[0] for c in by}, "pos": np.arange(len(at)), "x": xy[at, 0], "y": xy[at, 1]})

    return slim.mapInPandas(partial, slim.schema).groupBy(*by).applyInPandas(run, f"{fields}, pos bigint, x double, y double")


def propagate(boxes: DataFrame, members: DataFrame, tracks: DataFrame, by: Sequence[str], box_id: str) -> DataFrame:
    """Boxes carried by their tracks: members (box_id, track_id) joined with the tracks' places (track_id, x, y); boxes that
    share no track go, and tracks that lie in a new box join it. -> (by, box_id, x1..y2, n)."""
    moved = around(members.join(tracks, [*by, "track_id"]), [*by, box_id])
    alive = boxes.select(*by, box_id).join(moved, [*by, box_id])
    held = points_in_boxes(tracks, alive, by).groupBy(*by, box_id).agg(F.count("*").alias("n"))
    return alive.join(held, [*by, box_id])


def sliding_proposals(df: DataFrame, h: str, w: str, sizes: Sequence[tuple[int, int]], step: int) -> DataFrame:
    """Boxes of each size over each image on a grid, numbered from 1: a proposer that needs no pixels."""
    out = None
    for bh, bw in sizes:
        got = df.where((F.col(h) >= bh) & (F.col(w) >= bw)).withColumn("x1", F.explode(F.sequence(F.lit(0), F.col(w) - bw, F.lit(step)))).withColumn("y1", F.explode(F.sequence(F.lit(0), F.col(h) - bh, F.lit(step))))
        got = got.withColumn("x2", F.col("x1") + bw).withColumn("y2", F.col("y1") + bh)
        out = got if out is None else out.unionByName(got)
    return out
