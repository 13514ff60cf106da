"""Segments and their merges against plain loops, and planted boxes."""

from __future__ import annotations

import numpy as np
import pytest

from orrery.operators import imaging, proposals


def plain_segments(a: np.ndarray, scale: float, least: int) -> set[frozenset]:
    """The same rule on sets of pixels."""
    a = imaging.to_color(a).astype(float)
    h, w = a.shape[:2]
    of = {(y, x): frozenset([(y, x)]) for y in range(h) for x in range(w)}
    inner = {r: 0.0 for r in of.values()}
    pairs = [(float(np.linalg.norm(a[y, x] - a[v, u])), y * w + x, v * w + u, (y, x), (v, u)) for y in range(h) for x in range(w) for v, u in ((y, x + 1), (y + 1, x)) if v < h and u < w]
    for small in (False, True):
        for d, _, _, p, q in sorted(pairs, key=lambda e: e[:3]):
            one, two = of[p], of[q]
            if one is two:
                continue
            if min(len(one), len(two)) < least if small else d <= min(inner[one] + scale / len(one), inner[two] + scale / len(two)):
                both = one | two
                inner[both] = d
                for k in both:
                    of[k] = both
    return set(of.values())


@pytest.mark.parametrize("scale,least", [(0, 1), (60, 1), (200, 4), (1e9, 1)])
def test_segments(scale, least):
    rng = np.random.default_rng(int(scale) % 97)
    for shape in ((7, 9), (1, 6), (6, 8, 3), (1, 1)):
        a = (rng.integers(0, 4, shape) * 20).astype(np.uint8)  # many ties
        labels = proposals.segments(a, scale, least)
        got = {frozenset(map(tuple, np.argwhere(labels == k).tolist())) for k in range(labels.max() + 1)}
        assert got == plain_segments(a, scale, least)
        first = [np.flatnonzero(labels.ravel() == k)[0] for k in range(labels.max() + 1)]
        assert first == sorted(first)


def test_merges():
    """Each merge joins the two neighbours of nearest mean colour; the last region is the image."""
    rng = np.random.default_rng(3)
    a = rng.integers(0, 255, (12, 15, 3)).astype(np.uint8)
    labels = proposals.segments(a, 400, 8)
    got = proposals.merged_boxes(a, labels)
    n = labels.max() + 1
    assert len(got) == 2 * n - 1 and got[-1].tolist() == [0, 0, 15, 12, 180]
    now = {k: labels == k for k in range(n)}
    for k in range(n, 2 * n - 1):
        touch = lambda p, q: (p[:, :-1] & q[:, 1:]).any() or (q[:, :-1] & p[:, 1:]).any() or (p[:-1] & q[1:]).any() or (q[:-1] & p[1:]).any()
        best = min((float(np.linalg.norm(a[now[i]].mean(0) - a[now[j]].mean(0))).__round__(9), i, j) for i in now for j in now if i < j and touch(now[i], now[j]))
        both = now.pop(best[1]) | now.pop(best[2])
        now[k] = both
        y, x = np.nonzero(both)
        assert got[k].tolist() == [x.min(), y.min(), x.max() + 1, y.max() + 1, both.sum()]


def test_planted_boxes(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for i in range(12):
        a = np.full((60, 80, 3), 90.0)
        a += rng.normal(size=a.shape) * 3
        want[i] = []
        for k in range(3):
            h, w = rng.integers(10, 18, 2)
            x, y = 2 + 26 * k + int(rng.integers(0, 6)), int(rng.integers(2, 40))
            a[y : y + h, x : x + w] = rng.uniform(130, 250, 3) + rng.normal(size=(h, w, 3)) * 3
            want[i].append((x, y, x + w, y + h))
        rows.append((i, tuple(imaging.encode(a).values())))
    df = spark.createDataFrame([*rows, (99, None)], "i int, image struct<h: int, w: int, c: int, data: binary>")
    got = proposals.proposals(df, ["i"]).toPandas()
    assert set(got["i"]) == set(want)
    found = 0
    for i, boxes in want.items():
        mine = got[got["i"] == i].sort_values("place")[["x1", "y1", "x2", "y2"]].to_numpy(float)
        from orrery.operators.boxtracks import overlaps

        found += (overlaps(np.array(boxes, float), mine).max(1) > 0.85).sum()
        assert (overlaps(mine, mine) - np.eye(len(mine)) <= 0.9).all() and len(mine) < 40
    assert found >= 34  # of 36
