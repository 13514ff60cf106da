"""Findings of the third round on larger tables: what failed there, at the least size that shows it."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import pose as P
from orrery.functions import quat, vec
from orrery.operators import imaging, scan
from orrery.operators import linear as L


def test_eight_points_of_many_matches():
    """The left vectors of 40,000 matches would take 13 GB."""
    rng = np.random.default_rng(1)
    p = rng.uniform([-5, -4, 8], [5, 4, 15], (40_000, 3))
    turn = np.array([[np.cos(0.1), 0, np.sin(0.1)], [0, 1, 0], [-np.sin(0.1), 0, np.cos(0.1)]])
    see = lambda x: 500 * x[:, :2] / x[:, 2:] + [320, 240]
    a, b = see(p), see(p @ turn.T + [1.5, 0, 0])
    one = lambda x: np.column_stack([x, np.ones(len(x))])
    assert np.abs((one(b) @ L.eight_point(a, b) * one(a)).sum(1)).max() < 1e-6
    assert np.abs((one(b) @ L.eight_point(a[:8], b[:8]) * one(a))[:8].sum(1)).max() < 1e-6


def test_grey_of_all_levels():
    """Halves go up, sums go from left to right, as in SQL."""
    duckdb = pytest.importorskip("duckdb")
    b, g = np.meshgrid(np.arange(256), np.arange(256))
    image = np.stack([b, g, np.full_like(b, 77)], -1).astype(np.uint8)
    sql = "SELECT CAST(round(0.114::DOUBLE * b + 0.587::DOUBLE * g + 0.299::DOUBLE * 77) AS INT) FROM range(256) x(g), range(256) y(b) ORDER BY g, b"
    assert imaging.gray_levels(image).ravel().tolist() == [r[0] for r in duckdb.sql(sql).fetchall()]


def test_more_trajectories_than_a_block_has_rows(spark):
    """Products of 40 trajectories of two poses in blocks of 6 rows: no chain of chains without end."""
    rows = spark.range(80).select((F.col("id") % 40).alias("k"), F.floor(F.col("id") / 40).alias("i"))
    df = rows.withColumn("pose", P.pose(quat.identity(), vec.vec3((F.col("k") + 1).cast("double"), F.lit(0.0), F.lit(0.0))))
    got = {(r["k"], r["i"]): r["chain"]["t"]["x"] for r in scan.prefix_products(df, ["k"], "i", size=6).collect()}
    assert got == {(k, i): (i + 1.0) * (k + 1) for k in range(40) for i in range(2)}


def test_globs_of_a_flat_folder_are_one_listing(spark, tmp_path):
    """A filter on names in place of a path for each file, which Spark lists by a task each; nested folders as before."""
    from orrery.sources import readers

    for k in range(40):
        (tmp_path / f"a{k}.txt").write_text(f"{k}")
    (tmp_path / "other.bin").write_text("x")
    got = readers.load(spark.read.format("binaryFile"), f"{tmp_path}/a*.txt")
    assert got._jdf.queryExecution().optimizedPlan().collectLeaves().head().relation().location().rootPaths().size() == 1
    assert got.count() == 40 and {r["value"] for r in readers._whole(spark, f"{tmp_path}/a*.txt").collect()} == {str(k) for k in range(40)}
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a99.txt").write_text("99")
    assert readers.load(spark.read.format("binaryFile"), f"{tmp_path}/a*.txt").count() == 40


def test_best_overlaps_are_those_of_all_pairs():
    """Chunks that are left out hold nothing better: against all pairs, with copies, empty boxes and lost numbers."""
    from orrery.operators import boxes as B

    rng = np.random.default_rng(3)
    made = lambda n: np.concatenate([xy := rng.integers(0, 120, (n, 2)), xy + rng.integers(-2, 40, (n, 2))], 1).astype(float)
    p, q = made(900), made(1500)
    p, q = np.concatenate([p, p[:50], [[np.nan, 0, 1, 1]]]), np.concatenate([q, q[:70]])
    w = np.minimum(p[:, None, 2], q[None, :, 2]) - np.maximum(p[:, None, 0], q[None, :, 0])
    h = np.minimum(p[:, None, 3], q[None, :, 3]) - np.maximum(p[:, None, 1], q[None, :, 1])
    both = np.where((w > 0) & (h > 0), w * h, 0.0)
    area = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    want = np.divide(both, area(p)[:, None] + area(q)[None, :] - both, out=np.zeros_like(both), where=both > 0).max(1)
    assert np.array_equal(B.best_overlaps(p, q), want)
    assert not B.best_overlaps(p, q[:0]).any() and not len(B.best_overlaps(p[:0], q))


def test_suppression_of_crowded_images():
    """Far boxes are never looked at, and near ones decide as they do among all."""
    from orrery.operators import boxes as B

    rng = np.random.default_rng(5)
    xy = rng.integers(0, 300, (1500, 2))
    boxes, scores = np.concatenate([xy, xy + rng.integers(1, 40, (1500, 2))], 1).astype(float), rng.integers(0, 9, 1500) / 10
    order, kept = np.lexsort((np.arange(1500), -scores)), []
    for i in order:
        k = np.array(kept, int)
        w = np.clip(np.minimum(boxes[k, 2], boxes[i, 2]) - np.maximum(boxes[k, 0], boxes[i, 0]) + 1, 0, None)
        h = np.clip(np.minimum(boxes[k, 3], boxes[i, 3]) - np.maximum(boxes[k, 1], boxes[i, 1]) + 1, 0, None)
        size = lambda x: (x[:, 2] - x[:, 0] + 1) * (x[:, 3] - x[:, 1] + 1)
        if not (w * h / (size(boxes[k]) + size(boxes[[i]]) - w * h) > 0.3).any():
            kept.append(i)
    assert B.greedy_nms(boxes, scores, np.arange(1500), 0.3).tolist() == kept


def test_work_on_few_bytes_is_dealt_over_tasks(spark):
    """Images made of a small file's rows: as many partitions as tasks can run at least, whatever their bytes."""
    from orrery.operators import denseflow, proposals

    image = F.struct(F.lit(16).alias("h"), F.lit(16).alias("w"), F.lit(1).alias("c"), F.unhex(F.repeat(F.lit("50"), 256)).alias("data"))
    rows = spark.range(40).coalesce(1).select((F.col("id") % 20).alias("k"), F.floor(F.col("id") / 20).alias("t"), image.alias("image"))
    used = lambda df: df.select(F.spark_partition_id().alias("p")).distinct().count()
    assert used(proposals.proposals(rows, ["k"])) >= 4
    assert used(denseflow.between_frames(rows, ["k"], "t", levels=1)) >= 4


def test_overlaps_of_equal_boxes_and_intervals_are_found_once(monkeypatch):
    """Sums over all pairs: copies by their number, whole numbers by intervals of an axis; other numbers by blocks, to the same result."""
    from orrery.operators import overlaps

    rng = np.random.default_rng(7)
    made = lambda n, tall: np.concatenate([xy := rng.integers(0, 50, (n, 2)), xy + np.stack([rng.integers(-3, 40, n), rng.integers(-1, tall, n)], 1)], 1).astype(float)
    a, b = made(3000, 3), made(2000, 30)
    a[:, 1], a[:, 3] = a[:, 1] // 10, a[:, 1] // 10 + a[:, 3] % 3
    a, b = np.concatenate([a, a[:900], [[np.nan, 0, 1, 1]]]), np.concatenate([b, b[:500], b[:500]])

    def plain(p, q, one, least):
        w, h = (np.clip(np.minimum(p[:, None, k + 2], q[None, :, k + 2]) - np.maximum(p[:, None, k], q[None, :, k]) + one, 0, None) for k in (0, 1))
        size = lambda x: (x[:, 2] - x[:, 0] + one) * (x[:, 3] - x[:, 1] + one)
        both = np.nan_to_num(w * h)
        iou = np.divide(both, size(p)[:, None] + size(q)[None, :] - both, out=np.zeros_like(both), where=both > 0)
        return int((iou > least).sum()), iou[iou > least].sum()

    seen = []
    by_blocks = overlaps.blocks
    monkeypatch.setattr(overlaps, "blocks", lambda p, q, *x: seen.append((len(p), len(q))) or by_blocks(p, q, *x))
    turned = [1, 0, 3, 2]
    for p, q, one, least in ((a, b, 1.0, 0.0), (a, b, 0.0, 0.0), (a[:, turned], b[:, turned], 1.0, 0.0), (a[:0], b, 1.0, 0.0)):
        n, total = overlaps.totals(p, q, least, one)
        want = plain(p, q, one, least)
        assert n == want[0] and abs(total - want[1]) < 1e-6
    monkeypatch.setattr(overlaps, "_TABLED", 64)
    assert overlaps.totals(a, b, 0.0, 1.0)[0] == plain(a, b, 1.0, 0.0)[0] and abs(overlaps.totals(a, b, 0.0, 1.0)[1] - plain(a, b, 1.0, 0.0)[1]) < 1e-6
    assert all(not x[0] for x in seen)  # none but the empty side
    for p, q, one, least in ((a + 0.25, b, 1.0, 0.0), (a, b, 0.0, 0.5)):
        n, total = overlaps.totals(p, q, least, one)
        want = plain(p, q, one, least)
        assert n == want[0] and abs(total - want[1]) < 1e-6
    assert seen[-1][0] <= 3000 and seen[-1][1] <= 2000  # copies once


def test_stacks_of_matrices_are_dealt_and_odd_rows_are_null(spark):
    """Rows of one small partition go to as many tasks as can run; rows of several shapes, with nulls or no finite numbers."""
    rows = [(0, [[2.0, 0.0], [0.0, 4.0]]), (1, None), (2, [[1.0, None], [0.0, 1.0]]), (3, [[1.0, 2.0], [3.0]]), (4, [[float("nan"), 0.0], [0.0, 1.0]]), (5, [[1.0, 1.0], [1.0, 1.0]]), (6, [[4.0]]), (7, [None, [1.0, 2.0]]), (8, [])]
    df = spark.createDataFrame(rows, "k int, m array<array<double>>").coalesce(1)
    got = L.held(df, n=F.transform("m", lambda r: r)).select("k", L.inverse(F.col("n")).alias("i"))
    assert {r["k"]: r["i"] for r in got.collect()} == {0: [[0.5, 0.0], [0.0, 0.25]], 6: [[0.25]], **dict.fromkeys((1, 2, 3, 4, 5, 7, 8))}
    assert {r["k"]: r["i"] for r in df.where("k IN (1, 2)").select("k", L.inverse(F.col("m")).alias("i")).collect()} == {1: None, 2: None}
    wide = L.held(spark.range(400).coalesce(1), m=F.array(F.array(F.col("id").cast("double"))))
    assert wide.select(F.spark_partition_id().alias("p")).distinct().count() >= 4


def test_pixels_of_many_images_leave_in_pieces():
    """A task that makes pixels of a batch of images sends them on by some hundred thousand, not all at once."""
    import pandas as pd

    made = []
    frame = SimpleNamespace(schema={"k": SimpleNamespace(dataType=SimpleNamespace(simpleString=lambda: "bigint"))})
    frame.where = frame.select = lambda *a: frame
    frame.mapInPandas = lambda run, schema: made.append(run)
    imaging.side_by_side(frame, ["k"], ["image"])
    image = imaging.encode(np.full((100, 100), 7, np.uint8))
    got = list(made[0](iter([pd.DataFrame({"k": range(40), "image": [image] * 40})])))
    assert max(map(len, got)) <= 110_000 and sum(map(len, got)) == 400_000
    assert pd.concat(got)["k"].value_counts().to_dict() == dict.fromkeys(range(40), 10_000)
