"""Dense motion: known shifts, turns and scalings, what doesn't come back, and colours."""

from __future__ import annotations

import colorsys

import numpy as np
import pytest

from orrery.operators import denseflow as D
from orrery.operators import imaging


def picture(move=lambda x, y: (x, y), h: int = 72, w: int = 96) -> np.ndarray:
    """A smooth random pattern, seen through a motion of its plane."""
    rng = np.random.default_rng(2)
    y, x = np.mgrid[:h, :w].astype(float)
    x, y = move(x, y)
    waves = sum(np.sin(a * x + b * y + c) for a, b, c in zip(rng.uniform(-0.5, 0.5, 12), rng.uniform(-0.5, 0.5, 12), rng.uniform(0, 7, 12)))
    return 128 + 10 * waves


INNER = (slice(14, -14), slice(14, -14))


@pytest.mark.parametrize("shift", [(0, 0), (1.5, -0.75), (4.25, 3), (-6, 5)])
def test_shifts(shift):
    got = D.flow(picture(), picture(lambda x, y: (x - shift[0], y - shift[1])))
    assert np.abs(got[INNER] - shift).max() < 0.1


def test_turns_and_scalings():
    for angle, zoom in ((0.03, 1), (0, 1.04), (-0.02, 0.97)):
        c, s = np.cos(angle) * zoom, np.sin(angle) * zoom
        cx, cy = 48, 36
        forward = lambda x, y: (cx + c * (x - cx) - s * (y - cy), cy + s * (x - cx) + c * (y - cy))  # noqa: B023, E731
        n = c * c + s * s
        back = lambda x, y: (cx + (c * (x - cx) + s * (y - cy)) / n, cy + (-s * (x - cx) + c * (y - cy)) / n)  # noqa: B023, E731
        y, x = np.mgrid[:72, :96].astype(float)
        want = np.stack(forward(x, y), -1) - np.stack([x, y], -1)
        error = np.abs(D.flow(picture(), picture(back)) - want)[INNER]
        assert np.median(error) < 0.05 and np.quantile(error, 0.9) < 0.1 and error.max() < 0.25


def test_expansion_is_the_quadratic():
    y, x = np.mgrid[:30, :40].astype(float)
    got = D.expansion(3 + 2 * x - y + 0.5 * x * x - 0.25 * y * y + 0.75 * x * y)[:, 12, 20]
    assert np.allclose(got, [2 + 20 + 0.75 * 12, -1 - 0.5 * 12 + 0.75 * 20, 0.5, -0.25, 0.75])


def test_what_does_not_come_back():
    one, two = picture(), picture(lambda x, y: (x - 3, y))
    two[20:50, 40:70] = np.random.default_rng(0).uniform(0, 255, (30, 30))  # something else came in between
    f = D.checked(one, two, 0.25)
    clear = np.s_[16:-16, 14:28]
    assert np.isnan(f[25:45, 45:62]).mean() > 0.6 and np.nanmax(np.abs(f[clear] - [3, 0])) < 0.1 and np.isnan(f[clear]).mean() < 0.02
    mask = np.ones(one.shape, np.uint8)
    mask[:, :40] = 0
    assert np.isnan(D.checked(one, two, 0.5, mask1=mask)[:, :40]).all()
    p = D.moved_points(one, picture(lambda x, y: (x - 3, y)), np.array([[30.5, 30], [-1, 5], [np.nan, 3], [95.9, 71]]))
    assert np.abs(p[0] - [33.5, 30]).max() < 0.2 and np.isnan(p[1:3]).all()


def test_median_and_start():
    f = np.zeros((9, 9, 2))
    f[4, 4] = 100
    assert (D.median(f) == 0).all()
    shift = (11.0, -8.0)  # far for one level, unless it is guessed
    one, two = picture(), picture(lambda x, y: (x - shift[0], y - shift[1]))
    guess = np.full((72, 96, 2), (10.0, -7.0))
    assert np.abs(D.flow(one, two, levels=1, start=guess)[20:-20, 20:-20] - shift).max() < 0.2


def test_colours():
    rng = np.random.default_rng(1)
    f = rng.normal(size=(6, 8, 2)) * 20
    got = D.colours(f)
    for i in range(6):
        for j in range(8):
            angle = (np.degrees(np.arctan2(f[i, j, 1], f[i, j, 0])) + 180) / 360
            r, g, b = colorsys.hsv_to_rgb(angle % 1, 1, min(255, 4 * np.hypot(*f[i, j])) / 255)
            assert np.abs(got[i, j] - 255 * np.array([b, g, r])).max() <= 1


def test_between_frames(spark):
    rows = [(s, k, tuple(imaging.encode(picture(lambda x, y: (x - 2 * k * s, y + k))).values())) for s in (0, 1) for k in range(3)]  # noqa: B023
    df = spark.createDataFrame(rows, "s int, k int, image struct<h: int, w: int, c: int, data: binary>")
    got = {(r["s"], r["k"]): r["flow"] for r in D.between_frames(df, ["s"], "k").collect()}
    assert got[0, 2] is None and got[1, 2] is None
    for (s, k), f in got.items():
        if k < 2:
            assert np.nanmax(np.abs(D.decode(f)[INNER] - [2 * s, -1])) < 0.2
