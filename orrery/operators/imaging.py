"""Image kernels in numpy, applied to tables of images (h, w, c, data: bytes of uint8, rows first).

`apply` maps a kernel over an image column in Arrow batches. Kernels take and give arrays; borders reflect without
repeating the edge pixel unless said otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pixels that leave a task at a time, and images that are turned into rows at a time.
_SENT, _AT_ONCE = 100_000, 500

IMAGE = T.StructType([T.StructField("h", T.IntegerType()), T.StructField("w", T.IntegerType()), T.StructField("c", T.IntegerType()), T.StructField("data", T.BinaryType())])


def decode(row) -> np.ndarray:
    a = np.frombuffer(row["data"], np.uint8).reshape(row["h"], row["w"], row["c"])
    return a[:, :, 0] if row["c"] == 1 else a


def encode(a: np.ndarray) -> dict:
    a = np.clip(np.rint(a), 0, 255).astype(np.uint8) if a.dtype != np.uint8 else a
    return {"h": a.shape[0], "w": a.shape[1], "c": 1 if a.ndim == 2 else a.shape[2], "data": a.tobytes()}


def apply(df: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], col: str = "image", name: str = "image") -> DataFrame:
    @F.pandas_udf(IMAGE)
    def run(images: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([encode(kernel(decode(r))) for r in images.to_dict("records")], columns=IMAGE.names)

    return df.withColumn(name, run(F.col(col)))


def measure(df: DataFrame, kernel: Callable[[np.ndarray], float], col: str = "image", name: str = "value") -> DataFrame:
    @F.pandas_udf(T.DoubleType())
    def run(images: pd.DataFrame) -> pd.Series:
        return pd.Series([float(kernel(decode(r))) for r in images.to_dict("records")], dtype=float)

    return df.withColumn(name, run(F.col(col)))


def flip_channels(a: np.ndarray) -> np.ndarray:
    return a[:, :, ::-1]


def to_color(a: np.ndarray) -> np.ndarray:
    return a if a.ndim == 3 else np.repeat(a[:, :, None], 3, 2)


def to_gray(a: np.ndarray) -> np.ndarray:
    """Weights of blue, green and red in that order, added from left to right: a product of matrices may round otherwise."""
    return a if a.ndim == 2 else 0.114 * a[:, :, 0].astype(float) + 0.587 * a[:, :, 1] + 0.299 * a[:, :, 2]


def gray_levels(a: np.ndarray) -> np.ndarray:
    """Grey as whole levels, halves up."""
    g = to_gray(a)
    low = np.floor(g)
    return (low + (g - low >= 0.5)).astype(np.uint8)


def pad(a: np.ndarray, size: int = 3, value: int = 0) -> np.ndarray:
    return np.pad(a, [(size, size), (size, size)] + [(0, 0)] * (a.ndim - 2), constant_values=value)


def sample(a: np.ndarray, step: int = 2) -> np.ndarray:
    return a[::step, ::step]


def _spread(n_in: int, n_out: int) -> np.ndarray:
    """Rows of the weights by which n_in cells are averaged into n_out."""
    edges = np.linspace(0, n_in, n_out + 1)
    lo, hi = np.arange(n_in), np.arange(1, n_in + 1)
    return np.clip(np.minimum(hi[None], edges[1:, None]) - np.maximum(lo[None], edges[:-1, None]), 0, None) * n_out / n_in


def resize(a: np.ndarray, shape: tuple[int, int] | None = None, scale: float = 1.0) -> np.ndarray:
    """By the mean of covered area; as it is if the scale is within 0.01 of 1."""
    if shape is None:
        if abs(scale - 1) < 0.01:
            return a
        shape = (max(1, round(a.shape[0] * scale)), max(1, round(a.shape[1] * scale)))
    return np.einsum("ij,jk...,lk->il...", _spread(a.shape[0], shape[0]), a.astype(float), _spread(a.shape[1], shape[1]))


def _windows(a: np.ndarray, size: int) -> np.ndarray:
    k = size // 2
    p = np.pad(a.astype(float), [(k, k), (k, k)] + [(0, 0)] * (a.ndim - 2), mode="reflect" if min(a.shape[:2]) > k else "edge")
    return np.lib.stride_tricks.sliding_window_view(p, (size, size), axis=(0, 1))


def convolve(a: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    return np.einsum("...ij,ij->...", _windows(a, kernel.shape[0]), kernel)


def gaussian_blur(a: np.ndarray, size: int = 3) -> np.ndarray:
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    g = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma**2))
    g /= g.sum()
    return convolve(a, np.outer(g, g))


def box_blur(a: np.ndarray, size: int = 3) -> np.ndarray:
    return _windows(a, size).mean((-2, -1))


def median_blur(a: np.ndarray, size: int = 3) -> np.ndarray:
    return np.median(_windows(a, size), (-2, -1))


def gradients(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    g = to_gray(a)
    k = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1.0]])
    return convolve(g, k), convolve(g, k.T)


def laplacian_variance(a: np.ndarray) -> float:
    return float(convolve(to_gray(a), np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0.0]])).var())


def blur_measure(a: np.ndarray) -> float:
    gx, gy = gradients(a)
    return 1 / (((gx**2).sum() + (gy**2).sum()) / (gx.size + 1e-6))


def is_blurred(a: np.ndarray, threshold: float = 7) -> bool:
    return -math.log(blur_measure(a)) > threshold


def normalize(a: np.ndarray, lo: float = 0, hi: float = 255) -> np.ndarray:
    span = float(a.max()) - float(a.min())
    return np.full(a.shape, lo, float) if span == 0 else (a - float(a.min())) / span * (hi - lo) + lo


def sobel(a: np.ndarray, blur: int = 3) -> np.ndarray:
    gx, gy = gradients(gaussian_blur(to_gray(a), blur) if blur else a)
    return np.hypot(gx, gy)


def sobel_threshold(a: np.ndarray, blur: int = 3, threshold: float = 10) -> np.ndarray:
    return (sobel(a, blur) > threshold) * 255.0


def dilate(a: np.ndarray, iterations: int = 1) -> np.ndarray:
    for _ in range(iterations):
        a = _windows(a, 3).max((-2, -1))
    return a


def erode(a: np.ndarray, iterations: int = 1) -> np.ndarray:
    for _ in range(iterations):
        a = _windows(a, 3).min((-2, -1))
    return a


def erode_dilate(a: np.ndarray, iterations: int = 1) -> np.ndarray:
    return dilate(erode(a, iterations), iterations)


def dilate_erode(a: np.ndarray, iterations: int = 1) -> np.ndarray:
    return erode(dilate(a, iterations), iterations)


def canny(a: np.ndarray, blur: int = 3, low: float = 50, high: float = 150) -> np.ndarray:
    """Edges: ridges of the gradient across its direction, above high or joined to such a pixel above low."""
    gx, gy = gradients(gaussian_blur(to_gray(a), blur))
    m = np.hypot(gx, gy)
    p = np.pad(m, 1)
    sector = np.round(np.arctan2(gy, gx) / (np.pi / 4)).astype(int) % 4
    keep = np.zeros(m.shape, bool)
    for s, (dy, dx) in enumerate([(0, 1), (1, 1), (1, 0), (1, -1)]):
        ahead = p[1 + dy : 1 + dy + m.shape[0], 1 + dx : 1 + dx + m.shape[1]]
        back = p[1 - dy : 1 - dy + m.shape[0], 1 - dx : 1 - dx + m.shape[1]]
        keep |= (sector == s) & (m >= ahead) & (m > back)
    weak, edge = keep & (m > low), keep & (m > high)
    while True:
        grown = (dilate(edge.astype(float)) > 0) & weak
        if (grown == edge).all():
            return edge * 255.0
        edge = grown


def mosaic(images: list[np.ndarray], shape: tuple[int, int] = (50, 50), border: int = 0, columns: int | None = None) -> np.ndarray:
    """A grid of ceil(sqrt n) columns of equal tiles, zeros where there are none."""
    n = len(images)
    columns = columns or math.ceil(math.sqrt(n))
    rows = math.ceil(n / columns)
    tiles = [pad(resize(to_color(x), shape), border) for x in images]
    h, w = tiles[0].shape[:2]
    out = np.zeros((rows * h, columns * w, 3))
    for k, t in enumerate(tiles):
        i, j = divmod(k, columns)
        out[i * h : (i + 1) * h, j * w : (j + 1) * w] = t
    return out


def mosaics(df: DataFrame, by: list[str], order: str, most: int = 100, **how) -> DataFrame:
    """A mosaic for each `most` images of a group, in order: (by, part, image)."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1
    parts = df.withColumn("part", F.floor(place / most).cast("bigint"))
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        m = encode(mosaic([decode(r) for r in pdf["image"]], **how))
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in by}, "part": [pdf["part"].iloc[0]], "image": [m]})

    return parts.groupBy(*by, "part").applyInPandas(run, f"{fields}{', ' if by else ''}part bigint, image {IMAGE.simpleString()}")


def pixels(df: DataFrame, keep: list[str], col: str = "image") -> DataFrame:
    """(keep, x, y, value: first channel) for each pixel of each image."""
    sent = df.select(*keep, col)
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        for pdf in batches:
            for r in pdf.to_dict("records"):
                a = decode(r[col])
                a = a if a.ndim == 2 else a[:, :, 0]
                y, x = np.mgrid[: a.shape[0], : a.shape[1]]
                yield pd.DataFrame({**{c: [r[c]] * a.size for c in keep}, "x": x.ravel(), "y": y.ravel(), "value": a.ravel().astype(float)})

    return sent.mapInPandas(run, f"{fields}{', ' if keep else ''}x int, y int, value double")


def side_by_side(df: DataFrame, keep: list[str], images: list[str], step: int = 1, where: str | None = None) -> DataFrame:
    """(keep, x, y, a column for each named image: its first channel) for every step-th pixel of images that lie over each other,
    both in one row: pixels meet in the row's own task. where: an image whose pixels other than 0 are kept only. Rows
    that lack an image give none; images of different sizes are an error."""
    names = list(dict.fromkeys([*images, *([where] if where else [])]))
    sent = df.where(" AND ".join(f"`{n}` IS NOT NULL" for n in names)).select(*keep, *names)
    fields = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)

    def columns(pdf, parts):
        at, *rest = (np.concatenate(c) for c in zip(*parts, strict=True))
        return pd.DataFrame({**{c: pdf[c].to_numpy()[at] for c in keep}, **dict(zip(["x", "y", *images], rest, strict=True))})

    def run(batches):
        for pdf in batches:
            parts, n = [], 0
            for i, row in enumerate(pdf[names].itertuples(index=False)):
                planes = {n: decode(r) for n, r in zip(names, row, strict=True)}
                planes = {n: a if a.ndim == 2 else a[:, :, 0] for n, a in planes.items()}
                if len({a.shape for a in planes.values()}) != 1:
                    raise ValueError(f"images of different sizes: {[a.shape for a in planes.values()]}")
                y, x = np.mgrid[0 : planes[names[0]].shape[0] : step, 0 : planes[names[0]].shape[1] : step]
                y, x = y.ravel(), x.ravel()
                if where:
                    inside = planes[where][y, x] != 0
                    y, x = y[inside], x[inside]
                parts.append((np.full(len(x), i, np.int32), x.astype(np.int32), y.astype(np.int32), *(planes[n][y, x].astype(float) for n in images)))
                n += len(x)
                if n >= _SENT:
                    yield columns(pdf, parts)
                    parts, n = [], 0
            if parts:
                yield columns(pdf, parts)

    return sent.mapInPandas(run, f"{fields}x int, y int, " + ", ".join(f"`{n}` double" for n in images))


def keypoints(points: DataFrame, size: float = 1.0) -> DataFrame:
    """Points (x, y) as keypoints: a struct of x, y and size in place of both."""
    return points.withColumn("keypoint", F.struct(F.col("x").cast("float").alias("x"), F.col("y").cast("float").alias("y"), F.lit(size).cast("float").alias("size"))).drop("x", "y")


def keypoint_places(df: DataFrame) -> DataFrame:
    """Keypoints as points (x, y)."""
    return df.select(*[c for c in df.columns if c != "keypoint"], "keypoint.x", "keypoint.y")


def depth_mesh(depth: DataFrame, camera: Column, step: int = 1) -> DataFrame:
    """Depth pixels (x, y, value) to points: every step-th column and row, as (x, y, point) with their places in the picture."""
    from orrery.functions import camera as C

    kept = depth.where((F.col("x") % step == 0) & (F.col("y") % step == 0))
    return kept.withColumn("point", C.depth_point(camera, F.col("x").cast("double"), F.col("y").cast("double"), F.col("value"))).drop("value")


def textured_images(df: DataFrame, keep: list[str], camera: Column, baseline: Column, disparity: str = "disparity", texture: str = "texture", step: int = 1, offset: float = 0.0) -> DataFrame:
    """(keep, x, y, point, texture) of rows that hold a disparity image and a texture: each place's point and its colour. offset is
    added to the disparities."""
    from orrery.functions import camera as C

    both = side_by_side(df, keep, [disparity, texture], step)
    point = C.reconstruct_disparity(camera, baseline, F.col("x").cast("double"), F.col("y").cast("double"), F.col(disparity) + offset)
    return both.select(*keep, "x", "y", point.alias("point"), F.col(texture).alias("texture"))


def textured_points(disparity: DataFrame, texture: DataFrame, by: list[str], camera: Column, baseline: Column, step: int = 1) -> DataFrame:
    """Disparity pixels and texture pixels (by, x, y, value) -> (by, x, y, point, texture): each place's point and its colour."""
    from orrery.functions import camera as C

    d = disparity.where((F.col("x") % step == 0) & (F.col("y") % step == 0))
    point = C.reconstruct_disparity(camera, baseline, F.col("x").cast("double"), F.col("y").cast("double"), F.col("value"))
    return d.withColumn("point", point).drop("value").join(texture.withColumnRenamed("value", "texture"), [*by, "x", "y"])


def masked_pixels(pix: DataFrame, mask: DataFrame, by: list[str]) -> DataFrame:
    """(x, y, value) where the mask's value is true."""
    if dict(mask.dtypes)["value"] != "boolean":
        raise ValueError("the mask must be boolean")
    return pix.join(mask.where("value").select(*by, "x", "y"), [*by, "x", "y"], "left_semi")


def dense_grid(df: DataFrame, h: str, w: str, step: int = 4, levels: int = 7, scale: float = math.sqrt(2)) -> DataFrame:
    """Keypoints (x, y, size) on a grid for each level."""
    level = F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))
    g = df.withColumn("level", level).withColumn("size", step * F.pow(F.lit(scale), F.col("level")))
    at = lambda n: F.explode(F.sequence(F.lit(step), F.greatest(F.col(n) - step, F.lit(step)), F.lit(step)))
    return g.withColumn("x", at(w)).withColumn("y", at(h)).where((F.col("x") < F.col(w)) & (F.col("y") < F.col(h)))


def corner_response(a: np.ndarray) -> np.ndarray:
    """The smaller eigenvalue of the gradient's 3x3 second moments."""
    gx, gy = gradients(a)
    xx, yy, xy = (box_blur(p) for p in (gx * gx, gy * gy, gx * gy))
    return (xx + yy) / 2 - np.sqrt(((xx - yy) / 2) ** 2 + xy**2)


#: Responses that differ by no more are equal: sums of the same moments in another order round apart.
_EQUAL = 1e-6


def corners(df: DataFrame, keep: list[str], threshold: float = 0.01, subpixel: bool = False, levels: int = 1) -> DataFrame:
    """(keep, x, y, response, level): local peaks of the corner response above a share of the greatest, on a pyramid. Neighbours
    of equal response are peaks both."""
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def peaks(a: np.ndarray):
        r = corner_response(a)
        y, x = np.nonzero((r >= dilate(r) - _EQUAL) & (r > threshold * max(r.max(), 1e-12)))
        xs, ys = x.astype(float), y.astype(float)
        if subpixel:
            p = np.pad(r, 1, mode="edge")
            for out, (dy, dx) in ((xs, (0, 1)), (ys, (1, 0))):
                a_, b_, c_ = p[y + 1 - dy, x + 1 - dx], p[y + 1, x + 1], p[y + 1 + dy, x + 1 + dx]
                bend = a_ - 2 * b_ + c_
                out += np.where(bend < 0, 0.5 * (a_ - c_) / np.where(bend < 0, bend, -1), 0)
        return xs, ys, r[y, x]

    def run(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                a = to_gray(decode(row["image"])).astype(float)
                for level in range(levels):
                    if min(a.shape) < 4:
                        break
                    x, y, r = peaks(a)
                    yield pd.DataFrame({**{c: [row[c]] * len(x) for c in keep}, "x": x * 2.0**level, "y": y * 2.0**level, "response": r, "level": level})
                    a = resize(a, scale=0.5)

    return df.select(*keep, "image").mapInPandas(run, f"{fields}{', ' if keep else ''}x double, y double, response double, level int")


# flow


def _at(a: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear values; places outside take the nearest pixel."""
    h, w = a.shape[:2]
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = np.minimum(x.astype(int), w - 2 if w > 1 else 0), np.minimum(y.astype(int), h - 2 if h > 1 else 0)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = x - x0, y - y0
    if a.ndim == 3:
        fx, fy = fx[..., None], fy[..., None]
    flat = np.ascontiguousarray(a).reshape(h * w, *a.shape[2:])
    pixel = lambda y, x: flat.take(y * w + x, 0)
    return (pixel(y0, x0) * (1 - fx) + pixel(y0, x1) * fx) * (1 - fy) + (pixel(y1, x0) * (1 - fx) + pixel(y1, x1) * fx) * fy


def warp(a: np.ndarray, flow: np.ndarray) -> np.ndarray:
    """Pixels fetched from where the flow points."""
    y, x = np.mgrid[: a.shape[0], : a.shape[1]]
    return _at(a.astype(float), x + flow[:, :, 0], y + flow[:, :, 1])


def track_points(im1: np.ndarray, im2: np.ndarray, pts: np.ndarray, size: int = 5, levels: int = 4, rounds: int = 30) -> np.ndarray:
    """Pyramidal least-squares tracking of points from im1 to im2."""
    pyramid = [(to_gray(im1).astype(float), to_gray(im2).astype(float))]
    for _ in range(levels - 1):
        if min(pyramid[-1][0].shape) < 4 * size:
            break
        pyramid.append(tuple(resize(x, scale=0.5) for x in pyramid[-1]))
    k = size // 2
    oy, ox = np.mgrid[-k : k + 1, -k : k + 1]
    d = np.zeros_like(pts, float)
    for level in range(len(pyramid) - 1, -1, -1):
        a, b = pyramid[level]
        gx, gy = (g / 8 for g in gradients(a))
        p = pts / 2.0**level
        x, y = p[:, 0, None, None] + ox, p[:, 1, None, None] + oy
        ia, ix, iy = _at(a, x, y), _at(gx, x, y), _at(gy, x, y)
        xx, yy, xy = (ix * ix).sum((1, 2)) + 1e-6, (iy * iy).sum((1, 2)) + 1e-6, (ix * iy).sum((1, 2))
        det = xx * yy - xy * xy
        for _ in range(rounds):
            e = ia - _at(b, x + d[:, 0, None, None], y + d[:, 1, None, None])
            ex, ey = (e * ix).sum((1, 2)), (e * iy).sum((1, 2))
            step = np.stack([(yy * ex - xy * ey) / det, (xx * ey - xy * ex) / det], 1)
            d += step
            if np.abs(step).max(initial=0) < 0.01:
                break
        if level:
            d *= 2
    return pts + d


def dense_flow(im1: np.ndarray, im2: np.ndarray, size: int = 7) -> np.ndarray:
    y, x = np.mgrid[: im1.shape[0], : im1.shape[1]]
    pts = np.stack([x.ravel(), y.ravel()], 1).astype(float)
    return (track_points(im1, im2, pts, size) - pts).reshape(*im1.shape[:2], 2)


def undistort(a: np.ndarray, k: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The image without distortion d = (k1, k2, p1, p2, k3)."""
    v, u = np.mgrid[: a.shape[0], : a.shape[1]]
    x, y = (u - k[0, 2]) / k[0, 0], (v - k[1, 2]) / k[1, 1]
    r2 = x * x + y * y
    radial = 1 + d[0] * r2 + d[1] * r2**2 + d[4] * r2**3
    xd, yd = x * radial + 2 * d[2] * x * y + d[3] * (r2 + 2 * x * x), y * radial + d[2] * (r2 + 2 * y * y) + 2 * d[3] * x * y
    return _at(a.astype(float), xd * k[0, 0] + k[0, 2], yd * k[1, 1] + k[1, 2])
