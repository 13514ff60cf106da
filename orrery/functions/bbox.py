"""Boxes given by columns or structs x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x1, y1, x2, y2) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(float(v))).cast("double").alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), (x1, y1, x2, y2), strict=True)])


def area(b: Column, inclusive: bool = False) -> Column:
    one = 1 if inclusive else 0
    return (b["x2"] - b["x1"] + one) * (b["y2"] - b["y1"] + one)


def intersection(a: Column, b: Column, inclusive: bool = False) -> Column:
    """Common area; zero when the boxes only touch. inclusive counts both border pixels."""
    one = 1 if inclusive else 0
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]) + one
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]) + one
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def iou(a: Column, b: Column, inclusive: bool = False) -> Column:
    """Null if both have no area."""
    i = intersection(a, b, inclusive)
    return F.try_divide(i, area(a, inclusive) + area(b, inclusive) - i)


def scaled(b: Column, s) -> Column:
    """About the centre."""
    cx, cy, w, h = (b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2, (b["x2"] - b["x1"]) * s / 2, (b["y2"] - b["y1"]) * s / 2
    return box(cx - w, cy - h, cx + w, cy + h)


def corners(b: Column, ccw: bool = True) -> Column:
    pairs = [("x1", "y1"), ("x1", "y2"), ("x2", "y2"), ("x2", "y1")] if ccw else [("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2")]
    return F.array(*[F.struct(b[x].alias("x"), b[y].alias("y")) for x, y in pairs])


def contains(b: Column, x: Column, y: Column) -> Column:
    """Edges included."""
    return (x >= b["x1"]) & (x <= b["x2"]) & (y >= b["y1"]) & (y <= b["y2"])


def in_bounds(b: Column, h, w) -> Column:
    return (b["x1"] >= 0) & (b["x2"] < w) & (b["y1"] >= 0) & (b["y2"] < h)
