"""Triangulation: every circle is empty, ties are as stated, any order gives the same, many points are quick."""

from __future__ import annotations

import itertools
import time
from fractions import Fraction

import numpy as np
import pytest

from orrery.operators import tracks


def inside(a, b, c, d) -> int:
    """1 if d is inside the circle of a, b, c; 0 on it. Exact."""
    a, b, c, d = (tuple(map(Fraction, map(float, q))) for q in (a, b, c, d))
    turn = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    rows = [(q[0] - d[0], q[1] - d[1], (q[0] - d[0]) ** 2 + (q[1] - d[1]) ** 2) for q in (a, b, c)]
    det = sum(rows[i][2] * (rows[(i + 1) % 3][0] * rows[(i + 2) % 3][1] - rows[(i + 2) % 3][0] * rows[(i + 1) % 3][1]) for i in range(3))
    v = det * (1 if turn > 0 else -1)
    return (v > 0) - (v < 0)


def hull_size(xy: np.ndarray) -> int:
    """Points on the outline, those inside its sides too."""
    on = set()
    for i, j in itertools.combinations(range(len(xy)), 2):
        side = (xy[j, 0] - xy[i, 0]) * (xy[:, 1] - xy[i, 1]) - (xy[j, 1] - xy[i, 1]) * (xy[:, 0] - xy[i, 0])
        if (side >= 0).all() or (side <= 0).all():
            on |= {i, j}
    return len(on)


def sets():
    rng = np.random.default_rng(0)
    yield rng.normal(size=(60, 2))
    yield np.array(list(itertools.product(range(7), range(5))), float)
    yield np.array(list(itertools.product(range(4), range(4))), float) * [1, 1e-7] + [1e5, 0]
    yield rng.integers(0, 6, (40, 2)).astype(float)
    yield np.array([(np.round(5 * x), np.round(5 * y)) for x, y in ((0.6, 0.8), (0.8, 0.6), (1, 0), (0, 1), (-1, 0), (0, -1), (-0.6, 0.8), (-0.8, -0.6), (0, 0))])
    yield np.array([(0, 0), (1, 0), (2, 0), (3, 0), (1.5, 1e-12), (5, 0)])


@pytest.mark.parametrize("k", range(6))
def test_circles_are_empty(k):
    xy = np.unique(next(itertools.islice(sets(), k, None)), axis=0)
    t = tracks.delaunay(xy)
    assert len({tuple(x) for x in t}) == len(t) == 2 * len(xy) - 2 - hull_size(xy)
    for a, b, c in t:
        assert all(inside(xy[a], xy[b], xy[c], xy[d]) <= 0 for d in range(len(xy)) if d not in (a, b, c))
    area = sum(abs((xy[b, 0] - xy[a, 0]) * (xy[c, 1] - xy[a, 1]) - (xy[b, 1] - xy[a, 1]) * (xy[c, 0] - xy[a, 0])) for a, b, c in t)
    assert area > 0
    # any order of the rows gives the same triangles
    mixed = np.random.default_rng(k).permutation(len(xy))
    back = {tuple(sorted(mixed[list(x)].tolist())) for x in tracks.delaunay(xy[mixed])}
    assert back == {tuple(x) for x in t.tolist()}


def test_ties_fan_out_from_the_least():
    xy = np.array(list(itertools.product(range(4), range(3))), float)
    at = {tuple(q): i for i, q in enumerate(xy.tolist())}
    t = {tuple(x) for x in tracks.delaunay(xy).tolist()}
    for x, y in itertools.product(range(3), range(2)):  # each square is cut through its lower left corner
        a, b, c, d = (at[x + i, y + j] for i, j in ((0, 0), (1, 0), (1, 1), (0, 1)))
        assert tuple(sorted((a, b, c))) in t and tuple(sorted((a, c, d))) in t
    circle = np.array([(3, 4), (4, 3), (5, 0), (0, 5), (-5, 0), (0, -5), (-3, 4), (-4, -3)], float)
    least = circle.tolist().index([-5, 0])
    assert all(least in x for x in tracks.delaunay(circle).tolist())


def test_lines_and_few_points():
    assert len(tracks.delaunay(np.array([(k, 2 * k) for k in range(9)], float))) == 0
    assert len(tracks.delaunay(np.zeros((2, 2)))) == 0
    assert tracks.delaunay(np.array([(0, 0), (0, 1), (0, 2), (1, 1)], float)).tolist() == [[0, 1, 3], [1, 2, 3]]


def test_many_points():
    rng = np.random.default_rng(1)
    xy = rng.uniform(0, 1000, (100_000, 2))
    began = time.process_time()
    t = tracks.delaunay(xy)
    assert time.process_time() - began < 60
    assert 2 * len(xy) - 2 - 100 < len(t) < 2 * len(xy) - 2
    # a sample of circles against near points
    for a, b, c in t[rng.integers(0, len(t), 50)]:
        near = np.argsort(((xy - xy[a]) ** 2).sum(1))[:60]
        assert all(inside(xy[a], xy[b], xy[c], xy[d]) <= 0 for d in near if d not in (a, b, c))
