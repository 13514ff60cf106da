"""Cases of the fourth round: equal corner responses that round apart, crowded images, frames of a stream that wait."""

from __future__ import annotations

import numpy as np
import pytest

from orrery.operators import boxes, boxtracks, denseflow, imaging, overlaps, proposals
from orrery.plans import q_motion


def test_corners_of_equal_response(spark):
    """The response of two neighbours is 968 / 9 by other sums, which round apart; both are peaks."""
    a = np.array([[123, 111, 118, 124, 126, 85, 110, 116], [139, 137, 135, 150, 137, 104, 120, 123], [119, 144, 112, 111, 157, 143, 118, 109], [140, 143, 103, 142, 123, 128, 132, 122], [121, 120, 134, 123, 104, 126, 114, 147], [144, 168, 121, 150, 143, 120, 117, 110], [143, 136, 138, 129, 95, 129, 123, 128], [149, 120, 140, 163, 133, 126, 108, 138]], np.uint8)
    images = spark.createDataFrame([(1, (8, 8, 1, a.tobytes()))], f"i int, image {imaging.IMAGE.simpleString()}")
    got = {(r["x"], r["y"]): r["response"] for r in imaging.corners(images, ["i"]).collect()}
    response = imaging.corner_response(a.astype(float))
    assert {(7.0, 6.0)} <= got.keys() and response[6, 7] < imaging.dilate(response)[6, 7]


def _boxes(n: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x, y = rng.integers(0, 100, n).astype(float), rng.integers(0, 60, n).astype(float)
    return np.stack([x, y, x + 20 + rng.integers(1, 51, n), y + 20 + 10 * rng.integers(1, 8, n)], 1)


def test_best_overlaps_leave_few_boxes_to_chunks(monkeypatch):
    """A crowded image's best overlaps come from the trees' levels; the old form looked at almost every chunk."""
    left, plain = [], boxes._best_by_chunks
    monkeypatch.setattr(boxes, "_best_by_chunks", lambda p, q: left.append(len(p)) or plain(p, q))
    p, q = _boxes(20_000, 1), _boxes(20_000, 2)
    got = boxes.best_overlaps(p, q)
    assert sum(left) < 4000
    u, back = np.unique(p, axis=0, return_inverse=True)
    assert (got == plain(u, np.unique(q, axis=0))[back.ravel()]).all()


def test_best_overlaps_of_odd_boxes(monkeypatch):
    """Copies, crowds of all but equal boxes, boxes of no or negative size and lost numbers, with and without levels."""
    rng = np.random.default_rng(3)
    some = _boxes(300, 4)
    crowd = np.array([5.0, 5, 60, 70]) + rng.random((300, 4)) * 1e-3
    odd = np.array([[3.0, 3, 3, 9], [9, 9, 2, 2], [np.nan, 0, 9, 9], [0, 0, np.inf, 9], [500, 500, 600, 600]])
    p, q = np.concatenate([some, crowd, odd, some[:9]]), np.concatenate([_boxes(300, 5), crowd[:150] + 1e-4, odd[:4], some[:5]])
    want = np.zeros(len(p))
    with np.errstate(all="ignore"):
        for i in np.flatnonzero(np.isfinite(p).all(1)):
            for b in q[np.isfinite(q).all(1)]:
                w, h = min(p[i, 2], b[2]) - max(p[i, 0], b[0]), min(p[i, 3], b[3]) - max(p[i, 1], b[1])
                if w > 0 and h > 0:
                    areas = (p[i, 2] - p[i, 0]) * (p[i, 3] - p[i, 1]) + (b[2] - b[0]) * (b[3] - b[1])
                    want[i] = max(want[i], w * h / (areas - w * h))
    assert np.allclose(boxes.best_overlaps(p, q), want, rtol=1e-12, atol=0)
    for most in (64, 1):
        monkeypatch.setattr(boxes, "_PLAIN", 0)
        monkeypatch.setattr(boxes, "_PAIRS", most)
        assert np.allclose(boxes.best_overlaps(p, q), want, rtol=1e-12, atol=0)


def test_match_ids_leave_as_numbers(spark):
    """Ids of any type, lost numbers, groups with one side or a null key; a label that is matched needs not be sent with each pair."""
    fields = "img bigint, id string, label string, x1 double, y1 double, x2 double, y2 double"
    box = (0.0, 0.0, 10.0, 10.0)
    one = [(1, "a", "p", *box), (1, "b", "q", *box), (1, "c", None, *box), (2, "d", "p", *box), (3, "e", "p", None, 0.0, 10.0, 10.0), (None, "f", "p", *box), (3, "g", "p", 0.0, 0.0, 10.0, 5.5)]
    two = [(1, "A", "p", *box), (1, "B", "q", 0.0, 0.0, 10.0, 5.0), (1, "C", None, *box), (3, "E", "p", *box), (None, "F", "p", *box), (1, "D", "p", 0.0, 0.0, 10.0, 8.0)]
    one, two = spark.createDataFrame(one, fields), spark.createDataFrame(two, fields)
    bare = boxes.match_ids(one, two, ["img"], "id", 0.5, "label", labelled=False)
    want = {(1, "a", "A", 1.0), (1, "a", "D", 0.8), (3, "g", "E", 0.55)}
    assert bare.columns == ["img", "truth_id", "test_id", "iou"] and {tuple(r) for r in bare.collect()} == want
    assert {tuple(r) for r in boxes.match_ids(one, two, ["img"], "id", 0.5, "label").drop("label").collect()} == want
    assert "Decimal" not in bare._jdf.queryExecution().toString() and "FlatMapGroupsInArrow" in bare._jdf.queryExecution().toString()


def test_streamed_frames_wait_in_a_file(spark, tmp_path, monkeypatch):
    """A camera's task holds one frame of a batch, and the stream gives what the batch form does: cameras without a name, frames
    without boxes, boxes that lack a number, frames of more rows than a packed row holds."""
    rng = np.random.default_rng(8)
    frames = [(t, rng.random((90, 4)).tobytes()) for t in (3, 1, 2, 1)]
    monkeypatch.setattr(boxtracks, "_KEPT", 1000)
    got = list(boxtracks._spooled(iter(frames)))
    assert [(t, len(b)) for t, b in got] == [(1, 180), (2, 90), (3, 90)] and (got[0][1] == np.frombuffer(frames[1][1] + frames[3][1]).reshape(-1, 4)).all()
    rows = []
    for camera in ("a", None):
        for t in range(6):
            rows += [(camera, t, *map(float, b)) for b in _boxes(150, 10 + t % 3)]
        rows += [(camera, 6, None, None, None, None), (camera, 4, 1.0, None, 5.0, 5.0), (camera, None, 1.0, 1.0, 5.0, 5.0), (camera, 7, 1.0, 1.0, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "camera string, tick bigint, x1 double, y1 double, x2 double, y2 double")
    for k, some in enumerate(("tick < 3", "tick >= 3 OR tick IS NULL")):
        df.where(some).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = boxtracks.track_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*"), "camera", "tick", 0.5, 1)
    stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    want = sorted(map(str, boxtracks.track(df, ["camera"], "tick", 0.5, 1).collect()))
    assert sorted(map(str, spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").collect())) == want and len(want) > 1800


def test_totals_of_crowded_images_by_shapes(monkeypatch):
    """Many boxes of few shapes on whole numbers are never compared one by one, and counts and sums are those of all pairs."""
    rng = np.random.default_rng(9)

    def made(n):
        x, y = rng.integers(-5, 9, n).astype(float), rng.integers(3, 13, n).astype(float)
        return np.concatenate([np.stack([x, y, x + rng.integers(-1, 7, n), y + 2 * rng.integers(0, 4, n)], 1), [[0.0, 0, np.nan, 1]]])

    a, b = made(3000), made(2000)
    plain = {(least, one): (0, 0.0) for least in (0.0, 0.3, 0.5) for one in (0.0, 1.0)}
    for x in a[:-1]:
        w, h = (np.minimum(x[k + 2], b[:-1, k + 2]) - np.maximum(x[k], b[:-1, k]) for k in (0, 1))
        for (least, one), (n, total) in plain.items():
            inner = np.maximum(w + one, 0) * np.maximum(h + one, 0)
            size = lambda t: (t[..., 2] - t[..., 0] + one) * (t[..., 3] - t[..., 1] + one)
            iou = np.divide(inner, size(x) + size(b[:-1]) - inner, out=np.zeros(len(inner)), where=inner > 0)
            plain[least, one] = n + int((iou > least).sum()), total + iou[iou > least].sum()

    def never(*_):
        raise AssertionError("compared one by one")

    monkeypatch.setattr(overlaps, "blocks", never)
    monkeypatch.setattr(overlaps, "_by_intervals", never)
    for (least, one), (n, total) in plain.items():
        got = overlaps.totals(a, b, least, one)
        assert got[0] == n and abs(got[1] - total) < 1e-9 * total
    monkeypatch.setattr(overlaps, "_ROOM", 1000)
    with pytest.raises(AssertionError):  # tables of more than their room are not made
        overlaps.totals(a, b, 0.5, 0.0)


def test_segments_join_plain_areas_as_such(monkeypatch):
    """Edges without a difference are not walked one by one; segments are those of the walk over all edges."""

    def walked(a, scale=300.0, least=20):
        h, w = a.shape[:2]
        c = imaging.to_color(a).astype(float)
        at = {(y, x): y * w + x for y in range(h) for x in range(w)}
        edges = sorted((float(np.sqrt(((c[y, x] - c[v, u]) ** 2).sum())), i, at[v, u]) for (y, x), i in at.items() for v, u in ((y, x + 1), (y + 1, x)) if (v, u) in at)
        group, inner = [{i} for i in range(h * w)], {i: 0.0 for i in range(h * w)}
        for first in (True, False):
            for d, i, j in edges:
                g, k = group[i], group[j]
                fits = d <= min(inner[min(g)] + scale / len(g), inner[min(k)] + scale / len(k)) if first else min(len(g), len(k)) < least
                if g is not k and fits:
                    g |= k
                    inner[min(g)] = d
                    for m in k:
                        group[m] = g
        return np.unique([min(g) for g in group], return_inverse=True)[1].reshape(h, w)

    rng = np.random.default_rng(2)
    blocks = np.kron(rng.integers(0, 5, (3, 4, 3)) * 50, np.ones((5, 4, 1), int)).astype(np.uint8)
    for a in (blocks, blocks[:, :, 0], blocks + rng.integers(0, 2, (15, 16, 1)).astype(np.uint8), rng.integers(0, 256, (9, 14)).astype(np.uint8), np.zeros((1, 7), np.uint8), np.zeros((6, 1, 3), np.uint8)):
        assert (proposals.segments(a) == walked(a)).all() and (proposals.segments(a, 40.0, 3) == walked(a, 40.0, 3)).all()
    found, find = [], proposals._find
    monkeypatch.setattr(proposals, "_find", lambda parent, i: found.append(i) or find(parent, i))
    poster = np.full((40, 56), 60, np.uint8)
    poster[5:20, 8:30] = 150
    assert proposals.segments(poster).max() == 1 and len(found) < 1500


def test_motion_both_ways_expands_images_once(monkeypatch):
    """The check there and back uses each image's quadratics twice; lines filtered by a matrix are those of the sum, and values that are
    lost stay lost in their windows only."""
    rng = np.random.default_rng(4)
    a = np.cumsum(np.cumsum(rng.normal(0, 3, (40, 56)), 0), 1)
    a = (255 * (a - a.min()) / (a.max() - a.min())).astype(np.uint8)
    b = np.roll(a, (1, 2), (0, 1))
    seen, plain = [], denseflow.expansion
    monkeypatch.setattr(denseflow, "expansion", lambda *x: seen.append(1) or plain(*x))
    got = denseflow.checked(a, b, 1.0, levels=2)
    assert len(seen) == 4
    there, back = (denseflow.median(denseflow.flow(x, y, levels=2)) for x, y in ((a, b), (b, a)))
    monkeypatch.setattr(denseflow, "_BAND", 0)
    slow = denseflow.flow(a, b, levels=2)
    assert np.allclose(denseflow.median(slow), there, atol=1e-9)
    known = ~np.isnan(got)
    assert known.any() and (got[known] == there[known]).all() and back.shape == there.shape
    monkeypatch.undo()
    holed = a.astype(float)
    holed[20, 30] = np.nan
    assert np.isnan(denseflow.expansion(holed)[:, 17:24, 27:34]).all() and np.isnan(denseflow.expansion(holed)).sum() == 5 * 49
    f = np.dstack([a, b]).astype(float)
    assert (denseflow.median(f) == np.median(np.lib.stride_tricks.sliding_window_view(np.pad(f, [(2, 2), (2, 2), (0, 0)], mode="edge"), (5, 5), (0, 1)), (-2, -1))).all()


def test_images_are_made_by_many_tasks(spark):
    """The keys of a small file are dealt before images are made of them, and a filter on the motion doesn't find it twice."""
    for query, maker in ((q_motion.dense_flow_steps, "_scene("), (q_motion.region_proposals, "_poster(")):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.index(maker) < plan.rindex("REPARTITION_BY_NUM")  # what lies lower comes first
        assert plan.count("ArrowEvalPython [run(") <= 1
