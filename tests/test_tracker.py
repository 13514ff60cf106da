"""Kept-up tracks: the step against plain rules, images, and the stream's timers."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from orrery.operators import imaging, tracker
from orrery.streaming import tracker as streaming


def frame(points, dx=0.0, dy=0.0) -> pd.DataFrame:
    return pd.DataFrame([(*p, dx, dy) for p in points] or [(None, None, None, dx, dy)], columns=["x", "y", "response", "dx", "dy"])


def test_step():
    s = tracker.Settings(100, 100, least=3, radius=5)
    live, got = tracker.step(tracker.Live(), frame([(10, 10, 1), (50, 50, 9), (52, 50, 3), (90, 90, 2)]), s, tracker.Shift())
    # the strongest; new ones don't keep away from each other
    assert got[["track_id", "x", "event"]].values.tolist() == [[0, 50, "new"], [1, 52, "new"], [2, 90, "new"]]
    # enough points: nothing is detected, one leaves
    live, got = tracker.step(live, frame([(1, 1, 5)], dx=20), s, tracker.Shift())
    assert got[["track_id", "x", "length", "event"]].values.tolist() == [[0, 70, 2, "seen"], [1, 72, 2, "seen"], [2, 90, 1, "lost"]]
    # one is missing; detections by the old places are left alone, at the radius too
    live, got = tracker.step(live, frame([(75, 50, 9), (67, 47, 8), (77.5, 50, 1), (20, 20, 1)]), s, tracker.Shift())
    assert got[["track_id", "x", "event"]].values.tolist() == [[0, 70, "seen"], [1, 72, "seen"], [3, 20, "new"]]
    live, got = tracker.step(live, frame([], dx=float("nan")), s, tracker.Shift())
    assert set(got["event"]) == {"lost"} and live.next_id == 4 and len(live.ids) == 0


def test_away_equals_all_distances():
    rng = np.random.default_rng(1)
    found, taken = rng.uniform(0, 60, (300, 3)), rng.uniform(0, 60, (40, 2))
    far = np.sqrt(((found[:, None, :2] - taken) ** 2).sum(2)).min(1) > 6
    assert (tracker.away(found, taken, 6) == found[far]).all()


def blobs(shift: tuple[float, float]) -> np.ndarray:
    y, x = np.mgrid[:60, :80].astype(float)
    at = np.random.default_rng(5).uniform([10, 10], [70, 50], (12, 2)) + shift
    return sum(200 * np.exp(-((x - a) ** 2 + (y - b) ** 2) / 6) for a, b in at).clip(0, 255)


def test_images_are_followed(spark):
    """Points go with a moving picture, in batch."""
    rows = [(0, k, imaging.encode(blobs((1.5 * k, -0.5 * k)))) for k in range(4)]
    df = spark.createDataFrame([(c, k, tuple(i[n] for n in ("h", "w", "c", "data"))) for c, k, i in rows], "camera int, tick int, image struct<h: int, w: int, c: int, data: binary>")
    got = tracker.track(df, ["camera"], "tick", tracker.Settings(60, 80, least=8), tracker.Images()).toPandas()
    long = got[got["length"] == 4]
    assert len(long) >= 5
    for i in long["track_id"]:
        path = got[(got["track_id"] == i) & (got["event"] != "lost")].sort_values("tick")[["x", "y"]].to_numpy()
        assert np.abs(np.diff(path, axis=0) - [1.5, -0.5]).max() < 0.3


def test_silent_cameras_are_closed(spark, tmp_path):
    """The waiting frame is taken by a timer, and its tracks end; a camera that comes back starts anew."""
    s = tracker.Settings(100, 100, least=2, radius=5)
    rows = [(1, 0, 10.0, 10.0, 1.0, 0.0, 0.0), (1, 1, None, None, None, 5.0, 0.0), (2, 0, 20.0, 20.0, 1.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "camera int, tick int, x double, y double, response double, dx double, dy double")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    with streaming.rocksdb(spark):
        got = streaming.track(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "camera", "tick", s, tracker.Shift(), silence_ms=1500)
        q = got.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").start(f"{tmp_path}/out")
        try:
            seen = []
            for _ in range(60):
                time.sleep(1)
                assert q.exception() is None
                seen = spark.read.schema(got.schema).parquet(f"{tmp_path}/out").where("event = 'closed'").collect() if q.lastProgress else []
                if len(seen) == 2:
                    break
        finally:
            q.stop()
    out = {(r["camera"], r["tick"], r["track_id"], r["x"], r["event"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert out == {(1, 0, 0, 10.0, "new"), (1, 1, 0, 15.0, "seen"), (1, 1, 0, 15.0, "closed"), (2, 0, 0, 20.0, "new"), (2, 0, 0, 20.0, "closed")}


def test_no_rows(spark):
    df = spark.createDataFrame([(1, None, 1.0, 1.0, 1.0, 0.0, 0.0)], "camera int, tick int, x double, y double, response double, dx double, dy double")
    assert tracker.track(df, ["camera"], "tick", tracker.Settings(9, 9), tracker.Shift()).count() == 0
    assert tracker.track(df.withColumn("tick", F.lit(1)), ["camera"], "tick", tracker.Settings(9, 9), tracker.Shift()).count() == 1
