"""Findings of the third round on crowded images and long groups: work and memory that don't grow with the square."""

from __future__ import annotations

import tracemalloc
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orrery.operators import boxtracks, overlaps, tracker


def lattice(rng, n):
    x, y = rng.integers(0, 100, n), rng.integers(0, 60, n)
    return np.stack([x, y, x + 20 + rng.integers(1, 51, n), y + 20 + 10 * rng.integers(1, 8, n)], 1).astype(float)


@pytest.mark.parametrize("held", [2_000_000, 300, 20])
def test_assignment_is_that_of_the_matrix(monkeypatch, held):
    """With copies, ties, empty and turned boxes and lost numbers, and when few pairs can be held."""
    monkeypatch.setattr(overlaps, "_HELD", held)
    rng = np.random.default_rng(3)
    for n, m, threshold in ((0, 5, 0.5), (5, 0, 0.5), (150, 190, 0.5), (420, 380, 0.3), (200, 200, 0.0)):
        a, b = lattice(rng, n), lattice(rng, m)
        if n > 100:
            a[3, 0], b[7, 2], a[9], b[5] = np.nan, np.inf, [5, 5, 5, 9], [9, 9, 3, 3]
            a[10:60], b[20:60] = b[20], b[20]
        with np.errstate(all="ignore"):
            want = sorted(boxtracks.assign(boxtracks.overlaps(a, b), threshold))
        assert sorted(zip(*(x.tolist() for x in overlaps.assigned(a, b, threshold)), strict=True)) == want


def test_a_crowded_frame_takes_no_matrix():
    """12,000 by 12,000 overlaps would be 1.2 GB, with those on the way to them over 5 GB."""
    rng = np.random.default_rng(4)
    live, _ = boxtracks.step(boxtracks.Live(), lattice(rng, 12_000), 0.5, 1)
    tracemalloc.start()
    boxtracks.step(live, lattice(rng, 12_000), 0.5, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4e8


def test_tracks_hold_a_frame_at_a_time(spark):
    """A camera's rows reach the tracker in order, in several batches, and its rows leave frame by frame."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        df = spark.range(1500).select((F.col("id") % 3).alias("camera"), F.floor((1499 - F.col("id")) / 60).alias("tick"), (F.col("id") * 37 % 80).cast("double").alias("x"), (F.col("id") * 91 % 60).cast("double").alias("y"), F.lit(1.0).alias("response"), F.lit(1.0).alias("dx"), F.lit(0.0).alias("dy"))

        def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            keys, turns = tracker.in_turn(batches, ["camera"], "tick")
            for at, frame in turns:
                yield pd.DataFrame({**{k: [v] for k, v in keys.items()}, "tick": [at], "n": [len(frame)]})

        got = tracker.sorted_groups(df, ["camera"], "tick").applyInPandas(sizes, "camera bigint, tick bigint, n bigint").toPandas()
        assert len(got) == 75 and (got["n"] == 20).all()
        assert (got.groupby("camera")["tick"].diff().dropna() == 1).all()
        out = tracker.track(df, ["camera"], "tick", tracker.Settings(60, 80, least=8), tracker.Shift()).toPandas()
        whole, frames = tracker.folded(tracker.Live(), df.where("camera = 1").toPandas(), "tick", tracker.Settings(60, 80, least=8), tracker.Shift())
        names = ["tick", "track_id", "x", "y", "length", "event"]
        order = lambda d: d[names].sort_values(names).reset_index(drop=True)
        pd.testing.assert_frame_equal(order(out[out["camera"] == 1]), order(frames), check_dtype=False)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("inclusive", [False, True])
def test_totals_of_pairs_are_those_of_rows(spark, inclusive):
    """Counts, sums and ids by blocks against a row a pair; only the larger side's places reach Python, not its pairs."""
    from orrery.operators import boxes as B

    rng = np.random.default_rng(5)
    rows = [(int(k % 3), k, *x.tolist()) for k, x in enumerate(lattice(rng, 240))]
    df = spark.createDataFrame(rows, "img long, id long, x1 double, y1 double, x2 double, y2 double")
    one, two = df.where("id % 2 = 0"), df.where("id % 2 = 1 AND img < 2")
    for threshold in (0.0, 0.5):
        want = B.pairs(one, two, ["img"], inclusive=inclusive).where(F.col("iou") > threshold)
        got = B.match_totals(one, two, ["img"], "id", threshold, inclusive)
        assert "Join" not in got._jdf.queryExecution().toString()
        total = {r["img"]: (r["n"], round(r["t"], 6)) for r in want.groupBy("img").agg(F.count("*").alias("n"), F.sum("iou").alias("t")).collect()}
        assert {r["img"]: (r["n"], round(r["total"], 6)) for r in got.collect()} == total
        if not inclusive:
            ids = {(r["img"], r["truth_id"], r["test_id"], r["iou"]) for r in B.match_ids(one, two, ["img"], "id", threshold).collect()}
            assert ids == {(r["img"], r["a"]["id"], r["b"]["id"], r["iou"]) for r in want.collect()}


def test_boxes_at_points_without_pairs(spark):
    """Edges, copies, empty and turned boxes, points in none; the plan joins no point with a box."""
    from orrery.operators import boxes as B

    rng = np.random.default_rng(6)
    boxes = lattice(rng, 300).tolist() + [[5.0, 5.0, 5.0, 5.0], [9.0, 9.0, 3.0, 3.0]] + [[1.5, 2.5, 3.5, 4.5]] * 3
    points = [(k, float(rng.integers(0, 170)), float(rng.integers(0, 150))) for k in range(200)] + [(200, 5.0, 5.0), (201, 1.5, 4.5), (202, -9.0, 3.0)]
    p = spark.createDataFrame(points, "id long, x double, y double").withColumn("img", F.col("id") % 2)
    b = spark.createDataFrame(boxes, "x1 double, y1 double, x2 double, y2 double").withColumn("img", (F.col("x1") % 2).cast("long"))
    for by in ([], ["img"]):
        xy = [(i, x, y, i % 2) for i, x, y in points]
        want = {(i, n) for i, x, y, g in xy if (n := sum(x1 <= x <= x2 and y1 <= y <= y2 and (not by or int(x1 % 2) == g) for x1, y1, x2, y2 in boxes))}
        assert {(r["id"], r["n"]) for r in B.boxes_at_points(p, b, by).collect()} == want


def test_noise_and_keyframes_of_a_long_trajectory():
    """20,000 poses took over 15 s in numpy calls a row; the chain and the gates go row by row in plain numbers."""
    import time

    from orrery.operators import poses as PO

    class Group:
        schema = None

        def groupBy(self, *_):
            return self

        def applyInPandas(self, run, _):
            return run

    rng = np.random.default_rng(7)
    q = rng.normal(size=(20_000, 4))
    names = ["tx", "ty", "tz", "qx", "qy", "qz", "qw"]
    pdf = pd.DataFrame(np.concatenate([rng.normal(size=(20_000, 3)) * 100, q / np.linalg.norm(q, axis=1)[:, None]], 1), columns=names).assign(i=range(20_000))
    start = time.perf_counter()
    same = PO.inject_noise(Group(), ["k"], "i", [0.0, 0.0])(pdf)
    kept = PO.sample_poses(Group(), ["k"], "i", 120.0, 0.6, 1)(pdf)
    assert time.perf_counter() - start < 4
    assert np.abs(same[names].to_numpy() - pdf[names].to_numpy()).max() < 1e-6
    assert kept["i"].iloc[0] == 0 and kept["i"].is_monotonic_increasing
    assert PO.sample_step(np.empty((0, 7)), pdf[names].to_numpy()[0], 1.0, 1.0) and not PO.sample_step(pdf[names].to_numpy()[:3], pdf[names].to_numpy()[1], 1.0, 1.0)
