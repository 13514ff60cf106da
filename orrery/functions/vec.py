"""Vectors: structs of x, y, z, and arrays of doubles. All functions are Column to Column."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


_BOUND = re.compile(r"[xyz]_\d+\b|-?[0-9.]+(E-?[0-9]+)?$")


def bind(body, *cols: Column) -> Column:
    """body(*cols) with the columns computed once. Trees of nested products would otherwise grow with each use, even of a
    named column: the optimizer puts expressions in place of names when it moves filters. Variables of an
    enclosing lambda and literals need no binding."""
    if all(_BOUND.match(c._jc.toString()) for c in cols):
        return body(*cols)
    held = F.struct(*[c.alias(f"b{i}") for i, c in enumerate(cols)])
    return F.transform(F.array(held), lambda v: body(*[v[f"b{i}"] for i in range(len(cols))]))[0]


def vec3(x, y, z) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(float(v))).cast("double").alias(n) for n, v in zip("xyz", (x, y, z), strict=True)])


def add(a: Column, b: Column) -> Column:
    return bind(lambda a, b: vec3(a["x"] + b["x"], a["y"] + b["y"], a["z"] + b["z"]), a, b)


def sub(a: Column, b: Column) -> Column:
    return bind(lambda a, b: vec3(a["x"] - b["x"], a["y"] - b["y"], a["z"] - b["z"]), a, b)


def scale(a: Column, s) -> Column:
    s = s if isinstance(s, Column) else F.lit(float(s))
    return bind(lambda a, s: vec3(a["x"] * s, a["y"] * s, a["z"] * s), a, s)


def dot(a: Column, b: Column) -> Column:
    return bind(lambda a, b: a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"], a, b)


def cross(a: Column, b: Column) -> Column:
    return bind(lambda a, b: vec3(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"]), a, b)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column, b: Column) -> Column:
    return norm(sub(a, b))


def unit(a: Column) -> Column:
    """Null parts for the zero vector."""
    return bind(lambda v: bind(lambda n: vec3(*[F.try_divide(v[k], n) for k in "xyz"]), norm(v)), a)


def skew(a: Column) -> Column:
    """The matrix of the cross product with a, as rows."""
    zero = F.lit(0.0)
    return bind(lambda a: F.array(F.array(zero, -a["z"], a["y"]), F.array(a["z"], zero, -a["x"]), F.array(-a["y"], a["x"], zero)), a)


def to_array(a: Column) -> Column:
    return F.array(a["x"], a["y"], a["z"])


def homogeneous(a: Column) -> Column:
    """An array vector with 1 appended."""
    return F.concat(a, F.array(F.lit(1.0)))


def dehomogenise(a: Column) -> Column:
    """An array vector divided by its last entry, without that; null entries if it is zero."""
    last = F.element_at(a, -1)
    return F.transform(F.slice(a, F.lit(1), F.size(a) - 1), lambda e: F.try_divide(e, last))


def array_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def array_norm(a: Column) -> Column:
    return F.sqrt(array_dot(a, a))


def array_unit(a: Column) -> Column:
    return bind(lambda a, n: F.transform(a, lambda x: F.try_divide(x.cast("double"), n)), a, array_norm(a))


def array_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda acc, x: acc + x))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(array_dot(a, b), array_norm(a) * array_norm(b))


def root_sift(desc: Column, eps: float = 1e-7) -> Column:
    """Entrywise square root of desc / (sum + eps). Negative entries become NaN: drop such rows by is_finite."""
    total = F.aggregate(desc, F.lit(0.0), lambda acc, x: acc + x.cast("double")) + eps
    return bind(lambda d, t: F.transform(d, lambda x: F.sqrt(x.cast("double") / t)), desc, total)


def is_finite(a: Column) -> Column:
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def frame_from_two(v1: Column, v2: Column) -> Column:
    """Rows x, y, z of an orthonormal frame: x along v1, z along v1 x v2, y = z x x."""
    both = bind(lambda v1, v2: F.struct(unit(v1).alias("x"), unit(cross(v1, v2)).alias("z")), v1, v2)
    return bind(lambda f: F.struct(f["x"].alias("x"), unit(cross(f["z"], f["x"])).alias("y"), f["z"].alias("z")), both)


def frame_from_points(p1: Column, p2: Column, p3: Column, origin: Column | None = None) -> Column:
    frame = frame_from_two(sub(p1, p2), sub(p2, p3))
    return F.struct(frame.alias("frame"), (origin if origin is not None else p2).alias("origin"))


def matvec(m: Column, v: Column) -> Column:
    """Matrix (array of rows) times array vector."""
    return bind(lambda m, v: F.transform(m, lambda row: array_dot(row, v)), m, v)


def matmul(a: Column, b: Column) -> Column:
    """Product of matrices given as arrays of rows."""
    return bind(lambda a, cols: F.transform(a, lambda row: F.transform(cols, lambda c: array_dot(row, c))), a, transpose(b))


def transpose(m: Column) -> Column:
    return bind(lambda m: F.transform(F.sequence(F.lit(0), F.size(m[0]) - 1), lambda j: F.transform(m, lambda row: F.get(row, j))), m)


def matrix(rows: list[list]) -> Column:
    return F.array(*[F.array(*[(v if isinstance(v, Column) else F.lit(float(v))).cast("double") for v in row]) for row in rows])


def det3(m: list[list[Column]]) -> Column:
    (a, b, c), (d, e, f), (g, h, i) = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """Entrywise |a - b| <= atol + rtol * |b|, for arrays."""
    return F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= atol + rtol * F.abs(y)), lambda ok: ok)


def same_transform(a: Column, b: Column) -> Column:
    """Equal 4x4 matrices up to their last entry."""
    norm_ = lambda m: F.transform(F.flatten(m), lambda x: x / m[3][3])
    return bind(lambda a, b: close(norm_(a), norm_(b)), a, b)  # else each entry would make its matrix again


def total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)
