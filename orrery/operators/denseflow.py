"""Dense motion between two images by polynomial expansion.

Around every pixel each image is fitted by a quadratic, weighted by a Gaussian; the fit needs only separable filters, as its normal
equations are the same everywhere. If the second image is the first one moved, the linear terms of the two quadratics differ by
twice their common quadratic term times the motion. These equations are averaged over a window and solved for each pixel,
a few times over, with the second image's quadratics fetched from where the last motion points; from a coarse image to finer ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators import imaging

FLOW = "struct<h: int, w: int, dx: binary, dy: binary>"


#: Sides up to which a filter is a product with a matrix.
_BAND = 256


@lru_cache(64)
def _band(kernel: bytes, size: int) -> np.ndarray:
    """The matrix that correlates a line of so many values with a kernel; the edge value goes on outside."""
    weights = np.frombuffer(kernel)
    out, at = np.zeros((size, size)), np.arange(size)
    for i, w in enumerate(weights):
        np.add.at(out, (at, np.clip(at + i - len(weights) // 2, 0, size - 1)), w)
    return out


def _along(a: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    """Correlation with a kernel along one of the last two axes; the edge pixel goes on outside."""
    size = a.shape[axis]
    if size <= _BAND and np.isfinite(a).all():  # a lost value would be lost for the whole line
        band = _band(kernel.tobytes(), size)
        return a @ band.T if axis == a.ndim - 1 else band @ a
    k = len(kernel) // 2
    padded = np.pad(a, [(k, k) if i == axis else (0, 0) for i in range(a.ndim)], mode="edge")
    part = lambda i: padded[(slice(None),) * axis + (slice(i, i + size),)]  # noqa: E731  a view: nothing is copied
    return sum(w * part(i) for i, w in enumerate(kernel))


_POWERS = [(0, 0), (1, 0), (0, 1), (2, 0), (0, 2), (1, 1)]


@lru_cache(16)
def _fit(size: int, sigma: float) -> tuple[list[np.ndarray], np.ndarray]:
    """The filters of the powers 0, 1 and 2, and the inverse of the fit's normal equations."""
    k = size // 2
    x = np.arange(-k, k + 1, dtype=float)
    g = np.exp(-(x**2) / (2 * sigma**2))
    g /= g.sum()
    moment = lambda p: (g * x**p).sum()
    gram = np.array([[moment(p + r) * moment(q + s) for r, s in _POWERS] for p, q in _POWERS])
    return [g * x**p for p in range(3)], np.linalg.inv(gram)


def expansion(a: np.ndarray, size: int = 7, sigma: float = 1.5) -> np.ndarray:
    """(5, h, w): x, y, x^2, y^2 and xy terms of each pixel's weighted quadratic."""
    filters, inverse = _fit(size, sigma)
    rows = [_along(a, f, 1) for f in filters]
    # moments of x^p y^q
    return np.tensordot(inverse, np.stack([_along(rows[p], filters[q], 0) for p, q in _POWERS]), 1)[1:]


def _blur(a: np.ndarray, size: int) -> np.ndarray:
    """Means over a window with Gaussian weights, of each plane."""
    k = size // 2
    g = np.exp(-(np.arange(-k, k + 1) ** 2) / (2 * (0.3 * (k - 1) + 0.8) ** 2))
    g /= g.sum()
    return _along(_along(a, g, 1), g, 2)


@lru_cache(16)
def _grid(h: int, w: int) -> np.ndarray:
    return np.mgrid[:h, :w].astype(float)


def _shrunk(a: np.ndarray, scale: float) -> np.ndarray:
    """As imaging.resize, one side after the other."""
    if abs(scale - 1) < 0.01:
        return a
    down, across = (imaging._spread(n, max(1, round(n * scale))) for n in a.shape)
    return down @ a @ across.T


def _refined(one: np.ndarray, two: np.ndarray, flow: np.ndarray, window: int) -> np.ndarray:
    """The motion after one solution of the averaged equations about the motion so far."""
    h, w = flow.shape[:2]
    y, x = _grid(h, w)
    tx, ty = x + flow[:, :, 0], y + flow[:, :, 1]
    there = np.moveaxis(imaging._at(np.moveaxis(two, 0, -1), tx, ty), -1, 0)
    outside = (tx < 0) | (ty < 0) | (tx > w - 1) | (ty > h - 1)
    xx, yy, xy = (one[2:] + there[2:]) / 2
    xy = xy / 2
    # (xx xy; xy yy) d = half the difference of the linear terms, about the motion so far
    bx = (one[0] - there[0]) / 2 + xx * flow[:, :, 0] + xy * flow[:, :, 1]
    by = (one[1] - there[1]) / 2 + xy * flow[:, :, 0] + yy * flow[:, :, 1]
    both = np.stack([xx * xx + xy * xy, xy * (xx + yy), xy * xy + yy * yy, xx * bx + xy * by, xy * bx + yy * by])
    both *= np.where(outside, 0.0, 1.0)
    a, b, c, u, v = _blur(both, window)
    det = a * c - b * b + 1e-3
    return np.stack([(c * u - b * v) / det, (a * v - b * u) / det], -1)


def flow(im1: np.ndarray, im2: np.ndarray, levels: int = 3, window: int = 15, rounds: int = 3, size: int = 7, sigma: float = 1.5, scale: float = 0.5, start: np.ndarray | None = None) -> np.ndarray:
    """(h, w, 2): how far each pixel of im1 has moved in im2, in x and y. start: a first guess of the same shape. Shifts come out
    to a few hundredths of a pixel; turns and scalings also turn and scale the linear terms, which costs about a tenth
    of a pixel for each three hundredths of a turn."""
    return _solved(_expanded(im1, im2, levels, size, sigma, scale), window, rounds, start)


def _expanded(im1: np.ndarray, im2: np.ndarray, levels: int = 3, size: int = 7, sigma: float = 1.5, scale: float = 0.5) -> list[tuple[np.ndarray, np.ndarray]]:
    """The expansions of both images, from the whole images to coarse ones."""
    a, b = (imaging.to_gray(x).astype(float) for x in (im1, im2))
    pyramid = [(a, b)]
    while len(pyramid) < levels and min(pyramid[-1][0].shape) * scale >= 2 * size:
        # smoothed first, so that fine detail doesn't turn into false motion
        pyramid.append(tuple(_shrunk(_blur(x[None], 5)[0], scale) for x in pyramid[-1]))
    return [tuple(expansion(x, size, sigma) for x in pair) for pair in pyramid]


def _solved(pyramid: list[tuple[np.ndarray, np.ndarray]], window: int = 15, rounds: int = 3, start: np.ndarray | None = None) -> np.ndarray:
    out = None
    for one, two in reversed(pyramid):
        h, w = one.shape[1:]
        if out is None:
            out = np.zeros((h, w, 2)) if start is None else _scaled(start, h, w)
        else:
            out = _scaled(out, h, w)
        for _ in range(rounds):
            out = _refined(one, two, out, window)
    return out


def _scaled(f: np.ndarray, h: int, w: int) -> np.ndarray:
    """A motion field for an image of another size."""
    y, x = np.mgrid[:h, :w].astype(float)
    got = imaging._at(f.astype(float), (x + 0.5) * f.shape[1] / w - 0.5, (y + 0.5) * f.shape[0] / h - 0.5)
    return got * [w / f.shape[1], h / f.shape[0]]


def median(f: np.ndarray, size: int = 5) -> np.ndarray:
    """The median of each window, plane by plane; edge pixels go on outside."""
    k = size // 2
    padded = np.pad(f, [(k, k), (k, k), (0, 0)], mode="edge")
    windows = np.lib.stride_tricks.sliding_window_view(padded, (size, size), (0, 1))
    if size % 2 and not np.isnan(f).any():  # without a look for lost values in each window
        windows = windows.reshape(*f.shape, size * size)
        windows.partition(size * size // 2, -1)
        return windows[..., size * size // 2].copy()
    return np.median(windows, (-2, -1))


def checked(im1: np.ndarray, im2: np.ndarray, threshold: float = 1.0, mask1: np.ndarray | None = None, mask2: np.ndarray | None = None, **how) -> np.ndarray:
    """The motion, NaN where a mask is 0 or where following it and the motion back ends more than the threshold away in x or y."""
    solve = {k: how[k] for k in ("window", "rounds", "start") if k in how}
    expand = {k: v for k, v in how.items() if k not in solve}
    pyramid = _expanded(im1, im2, **expand)
    other = [(two, one) for one, two in pyramid] if im1.shape[:2] == im2.shape[:2] else _expanded(im2, im1, **expand)
    there, back = median(_solved(pyramid, **solve)), median(_solved(other, **solve))
    if mask2 is not None:
        back[~mask2.astype(bool)] = np.nan
    y, x = np.mgrid[: there.shape[0], : there.shape[1]].astype(float)
    around = there + imaging._at(back, x + there[:, :, 0], y + there[:, :, 1])
    bad = ~(np.abs(around) <= threshold).all(-1)
    if mask1 is not None:
        bad |= ~mask1.astype(bool)
    return np.where(bad[:, :, None], np.nan, there)


def moved_points(im1: np.ndarray, im2: np.ndarray, points: np.ndarray, threshold: float = 2.0, **how) -> np.ndarray:
    """Points carried by the motion at their pixels; NaN outside the image and where the motion doesn't come back."""
    h, w = im1.shape[:2]
    f = checked(im1, im2, threshold, **how)
    out = np.full(points.shape, np.nan)
    inside = np.isfinite(points).all(1)
    inside[inside] &= ((points[inside] >= 0) & (points[inside] < [w, h])).all(1)
    at = points[inside].astype(int)
    out[inside] = points[inside] + f[at[:, 1], at[:, 0]]
    return out


def colours(f: np.ndarray, gain: float = 4.0) -> np.ndarray:
    """A picture of the motion, blue-green-red: hue is its direction (opposite of x is red), value its length times gain."""
    angle = np.degrees(np.arctan2(f[:, :, 1], f[:, :, 0])) + 180
    value = np.clip(np.nan_to_num(np.hypot(f[:, :, 0], f[:, :, 1])) * gain, 0, 255)
    sector = np.nan_to_num(angle) / 60
    # each channel rises, stays, falls and stays away over six sectors, two sectors apart
    channel = lambda shift: np.clip(2 - np.abs((sector + shift) % 6 - 3) if shift else np.abs(sector % 6 - 3) - 1, 0, 1)
    red, green, blue = channel(0), channel(1), channel(5)
    return np.rint(np.stack([blue, green, red], -1) * value[:, :, None]).astype(np.uint8)


def encode(f: np.ndarray) -> dict:
    h, w = f.shape[:2]
    return {"h": h, "w": w, "dx": f[:, :, 0].astype("<f4").tobytes(), "dy": f[:, :, 1].astype("<f4").tobytes()}


def decode(row) -> np.ndarray:
    return np.stack([np.frombuffer(row[k], "<f4").reshape(row["h"], row["w"]) for k in ("dx", "dy")], -1).astype(float)


def between_frames(frames: DataFrame, by: Sequence[str], order: str, threshold: float | None = 1.0, image: str = "image", **how) -> DataFrame:
    """Adds flow, the motion from each frame to the next one of its sequence (null for the last); NaN where it doesn't come back
    within the threshold (None: not checked). A row holds its two images, so pixels are never dealt one by one."""
    after = F.lead(image).over(Window.partitionBy(*by).orderBy(order))

    @F.pandas_udf(FLOW)
    def run(first: pd.DataFrame, second: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for a, b in zip(first.itertuples(index=False), second.itertuples(index=False), strict=True):
            if b.data is None or pd.isna(b.h):
                rows.append((None,) * 4)
                continue
            p, q = (imaging.decode({"h": int(x.h), "w": int(x.w), "c": int(x.c), "data": x.data}) for x in (a, b))
            got = encode(median(flow(p, q, **how)) if threshold is None else checked(p, q, threshold, **how))
            rows.append(tuple(got.values()))
        return pd.DataFrame(rows, columns=["h", "w", "dx", "dy"])

    run = run.asNondeterministic()  # or a filter on the flow makes it a second time
    # rows are few bytes and much work: partitions whose number Spark doesn't lower by their size
    parts = max(frames.sparkSession.sparkContext.defaultParallelism * 4, int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    paired = frames.withColumn("_after", after).repartition(parts, *by, order)
    known = F.col("_after").isNotNull()
    return paired.withColumn("flow", F.when(known, run(F.col(image), F.col("_after")))).drop("_after")
