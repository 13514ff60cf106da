"""Boxes that may hold an object, from the regions of an image.

Pixels are joined along edges of rising difference (colour distance of four-neighbours; ties by place): first while the edge is not
above what holds either region together (its greatest inner edge so far plus `scale` over its size), and small regions
with their least different neighbour; this segments the image. Then segments go on being merged, least different first
(difference of mean colours, ties by label), until one is left. Every segment and every merged region gives a box; boxes that
nearly repeat an earlier one are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from orrery.operators import imaging

#: Boxes that leave a task at a time.
_SENT = 10_000

OUT = "place bigint, x1 bigint, y1 bigint, x2 bigint, y2 bigint, size bigint"


def _find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _differences(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(difference, pixel, neighbour) of all four-neighbours, those of rows first, in the order of pixels."""
    h, w = a.shape[:2]
    at = np.arange(h * w).reshape(h, w)
    if a.ndim == 2 and a.dtype == np.uint8:  # whole numbers: three equal channels at once
        a = a.astype(float)
        apart = lambda x: np.sqrt(3 * (x * x)).ravel()
    else:
        a = imaging.to_color(a).astype(float)
        apart = lambda x: np.sqrt((x**2).sum(-1)).ravel()
    d = np.concatenate([apart(a[:, 1:] - a[:, :-1]), apart(a[1:] - a[:-1])])
    return d, np.concatenate([at[:, :-1].ravel(), at[:-1].ravel()]), np.concatenate([at[:, 1:].ravel(), at[1:].ravel()])


def _numbered(parent: list[int]) -> np.ndarray:
    """0, 1, ... for the sets that each belongs to, by their least members, which are their roots."""
    roots = np.array([_find(parent, i) for i in range(len(parent))])
    return (np.cumsum(roots == np.arange(len(roots))) - 1)[roots]


def _plains(d: np.ndarray, h: int, w: int) -> np.ndarray:
    """Labels 0, 1, ... of the pixels that edges without a difference join, in order of first pixels: runs of rows, joined where they lie over
    each other."""
    starts = np.ones((h, w), bool)
    starts[:, 1:] = d[: h * (w - 1)].reshape(h, w - 1) != 0
    run = (np.cumsum(starts) - 1).reshape(h, w)
    same = d[h * (w - 1) :].reshape(h - 1, w) == 0
    above, below = run[:-1][same], run[1:][same]
    new = np.ones(len(above), bool)
    new[1:] = (np.diff(above) != 0) | (np.diff(below) != 0)
    parent = list(range(int(run[-1, -1]) + 1))
    for i, j in zip(above[new].tolist(), below[new].tolist(), strict=True):
        i, j = _find(parent, i), _find(parent, j)
        parent[max(i, j)] = min(i, j)
    return _numbered(parent)[run]


def segments(a: np.ndarray, scale: float = 300.0, least: int = 20) -> np.ndarray:
    """Labels 0, 1, ... of each pixel's segment, in order of first pixels. No segment but a whole image has fewer than `least`
    pixels. Edges without a difference come first and always join, so plain areas are joined as such; the others are walked."""
    h, w = a.shape[:2]
    d, p, q = _differences(a)
    plain = _plains(d, h, w).ravel()
    walked = np.flatnonzero(d != 0)
    walked = walked[np.lexsort((q[walked], p[walked], d[walked]))]
    size = np.bincount(plain).tolist()
    d, p, q = d[walked].tolist(), plain[p[walked]].tolist(), plain[q[walked]].tolist()
    parent, inner = list(range(len(size))), [0.0] * len(size)

    def join(i: int, j: int, by: float) -> None:
        i, j = min(i, j), max(i, j)
        parent[j] = i
        size[i] += size[j]
        inner[i] = by  # edges rise, so the last is the greatest

    for by, i, j in zip(d, p, q, strict=True):
        i, j = _find(parent, i), _find(parent, j)
        if i != j and by <= min(inner[i] + scale / size[i], inner[j] + scale / size[j]):
            join(i, j, by)
    for by, i, j in zip(d, p, q, strict=True):
        i, j = _find(parent, i), _find(parent, j)
        if i != j and min(size[i], size[j]) < least:
            join(i, j, by)
    return _numbered(parent)[plain].reshape(h, w)


def merged_boxes(a: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """(x1, y1, x2, y2, pixels) of the segments and of each region that merging makes, in the order in which they come: x2 and
    y2 are behind the last pixel."""
    channels = [a] if a.ndim == 2 else [a[:, :, c] for c in range(3)]
    n = int(labels.max()) + 1
    flat = labels.ravel()
    size = np.bincount(flat, minlength=n)
    sums = [np.bincount(flat, c.ravel(), n) for c in channels]
    mean = list(np.stack(sums * (3 // len(sums)), 1) / size[:, None])
    order = np.argsort(flat, kind="stable")
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    y, x = np.divmod(order, labels.shape[1])
    box = list(zip(*(f.reduceat(c, starts).tolist() for f, c in ((np.minimum, x), (np.minimum, y), (np.maximum, x + 1), (np.maximum, y + 1))), strict=True))
    sizes, near = size.tolist(), [set() for _ in range(n)]
    for one, two in ((labels[:, :-1], labels[:, 1:]), (labels[:-1], labels[1:])):
        border = one != two
        for i, j in set(zip(one[border].tolist(), two[border].tolist(), strict=True)):
            near[i].add(j)
            near[j].add(i)
    import heapq

    apart = lambda i, j: float(((mean[i] - mean[j]) ** 2).sum() ** 0.5)
    heap = [(apart(i, j), i, j) for i in range(n) for j in near[i] if i < j]
    heapq.heapify(heap)
    gone = [False] * n
    while heap:
        _, i, j = heapq.heappop(heap)
        if gone[i] or gone[j]:
            continue
        k = len(box)
        gone[i] = gone[j] = True
        gone.append(False)
        sizes.append(sizes[i] + sizes[j])
        mean.append((mean[i] * sizes[i] + mean[j] * sizes[j]) / sizes[k])
        box.append((min(box[i][0], box[j][0]), min(box[i][1], box[j][1]), max(box[i][2], box[j][2]), max(box[i][3], box[j][3])))
        near.append({m for m in near[i] | near[j] if not gone[m]})
        for m in near[k]:
            near[m].add(k)
            heapq.heappush(heap, (apart(m, k), m, k))
    return np.column_stack([np.array(box, np.int64), np.array(sizes, np.int64)])


def distinct(boxes: np.ndarray, overlap: float = 0.9) -> np.ndarray:
    """Boxes that no earlier kept one overlaps by more than this."""
    area = (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1])
    kept: list[int] = []
    for i in range(len(boxes)):
        k = np.array(kept, int)
        near = np.minimum(boxes[k, 2:4], boxes[i, 2:4]) - np.maximum(boxes[k, :2], boxes[i, :2])
        inner = np.maximum(near, 0).prod(1)
        if not (inner > overlap * (area[k] + area[i] - inner)).any():
            kept.append(i)
    return boxes[kept]


def propose(a: np.ndarray, scale: float = 300.0, least: int = 20, overlap: float = 0.9) -> np.ndarray:
    """(x1, y1, x2, y2, pixels) of an image's regions, segments first, then merged regions from the last to the first."""
    labels = segments(a, scale, least)
    all_boxes = merged_boxes(a, labels)
    n = int(labels.max()) + 1
    return distinct(np.concatenate([all_boxes[:n], all_boxes[n:][::-1]]), overlap)


def proposals(images: DataFrame, keep: Sequence[str], scale: float = 300.0, least: int = 20, overlap: float = 0.9, image: str = "image") -> DataFrame:
    """(keep, place, x1, y1, x2, y2, size): the boxes of each image in order. Rows without an image give none; an image is one
    row's work."""
    fields = ", ".join(f"`{c}` {images.schema[c].dataType.simpleString()}" for c in keep)

    def columns(pdf: pd.DataFrame, at: list[int], parts: list[np.ndarray]) -> pd.DataFrame:
        rows, got = np.repeat(at, [len(p) for p in parts]), np.concatenate(parts)
        place = np.concatenate([np.arange(len(p)) for p in parts])
        return pd.DataFrame({**{c: pdf[c].to_numpy()[rows] for c in keep}, "place": place, **{k: got[:, i] for i, k in enumerate(("x1", "y1", "x2", "y2", "size"))}})

    def run(batches):
        for pdf in batches:
            at, parts, n = [], [], 0
            for i, row in enumerate(pdf[image].tolist()):
                at.append(i)
                parts.append(propose(imaging.decode(row), scale, least, overlap))
                n += len(parts[-1])
                if n >= _SENT:
                    yield columns(pdf, at, parts)
                    at, parts, n = [], [], 0
            if parts:
                yield columns(pdf, at, parts)

    session = images.sparkSession
    # a small file of keys may make images for hours: partitions whose number Spark doesn't lower by their size
    parts = max(session.sparkContext.defaultParallelism * 4, int(session.conf.get("spark.sql.shuffle.partitions")))
    return images.where(f"`{image}` IS NOT NULL").select(*keep, image).repartition(parts).mapInPandas(run, f"{fields}{', ' if keep else ''}{OUT}")
