"""Linear algebra that has no column form: batches of matrices in numpy, through Arrow.

Matrices are arrays of rows. Each function takes columns and gives a column. The matrices of a batch are solved as one
stack; a row with null, singular or ill-fitting input gives null.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

VECTOR = T.ArrayType(T.DoubleType())
MATRIX = T.ArrayType(VECTOR)


def dealt(df: DataFrame) -> DataFrame:
    """df dealt over tasks whatever its bytes: rows that are few bytes in a file are much work for functions of this module."""
    session = df.sparkSession
    return df.repartition(max(session.sparkContext.defaultParallelism * 4, int(session.conf.get("spark.sql.shuffle.partitions"))))


def held(df: DataFrame, deal: bool = True, **columns: Column) -> DataFrame:
    """df, dealt over tasks, with computed columns, for functions of this module to work on (deal=False: in the tasks where it is). They come out of a generator, so they reach Python
    as plain columns: in one projection with a Python function, arguments with sums or products inside lambdas (as the
    pose builders have) are not found again when Spark takes the function out."""
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return (dealt(df) if deal else df).select("*", F.explode(F.array(row)).alias("_held")).select(*[F.col(f"`{c}`") for c in df.columns], "_held.*")


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


def _ends(x: pa.Array) -> np.ndarray:
    """Where lists begin and end; none at all may come without a buffer for it."""
    return x.offsets.to_numpy().astype(np.int64) if len(x) else np.zeros(1, np.int64)


def _shapes(x: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of an array of numbers, vectors or matrices: each row's lengths (-1, -1 for a row that is no finite number, vector or matrix), the
    place of its first number, and all numbers."""
    n, ok = len(x), ~x.is_null().to_numpy(zero_copy_only=False)
    shape, bounds, inner = np.ones((n, 2), np.int64), np.arange(n + 1), x
    if pa.types.is_list(x.type) or pa.types.is_large_list(x.type):
        bounds, inner = _ends(x), x.values
        shape[:, 0] = np.diff(bounds)
        if pa.types.is_list(inner.type) or pa.types.is_large_list(inner.type):
            ends, lost = _ends(inner), inner.is_null().to_numpy(zero_copy_only=False)
            sizes = np.diff(ends)
            least, most = np.full(n, -1), np.full(n, -1)
            some = np.flatnonzero(ok & (shape[:, 0] > 0))
            if len(some):
                row = np.repeat(np.arange(len(some)), shape[some, 0])
                own = np.arange(len(row)) - np.repeat(np.cumsum(shape[some, 0]) - shape[some, 0], shape[some, 0]) + bounds[some][row]
                first = np.flatnonzero(np.diff(row, prepend=-1))
                least[some], most[some] = (f.reduceat(np.where(lost[own], -1, sizes[own]), first) for f in (np.minimum, np.maximum))
            ok &= (least == most) & (least > 0)
            shape[:, 1] = np.where(ok, most, -1)
            bounds, inner = ends[bounds], inner.values
        else:
            ok &= shape[:, 0] > 0
    numbers = inner.cast(pa.float64()).to_numpy(zero_copy_only=False)
    total = np.concatenate([[0], np.cumsum(~np.isfinite(numbers))])
    ok &= total[bounds[1:]] == total[bounds[:-1]]
    return np.where(ok[:, None], shape, -1), bounds[:-1], numbers


def _arrow(values, fine: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows as an Arrow array of a kind; null where they aren't fine."""
    if not isinstance(values, np.ndarray):
        return pa.array([v if k else None for v, k in zip(values, fine, strict=True)], kind)
    if values.ndim == 1:
        return pa.array(values, kind, mask=~fine)
    values = values[fine]
    out = pa.array(np.ascontiguousarray(values, float).ravel())
    for k in range(values.ndim - 1, 1, -1):
        out = pa.ListArray.from_arrays(pa.array(np.arange(0, len(out) + 1, values.shape[k], dtype=np.int32)), out)
    places = pa.array(np.concatenate([[0], np.cumsum(fine)]).astype(np.int32) * values.shape[1], mask=np.append(~fine, False))
    return pa.ListArray.from_arrays(places, out).cast(kind)


def _stacked(f: Callable, kind: T.DataType, *cols: Column) -> Column:
    """f over stacks of rows of equal shapes: it gets an array for each column, first axis the rows, and gives the results (for
    a struct one array, or list, a field) and a mask of the rows that have one. Rows outside the mask and rows with
    nulls are null. Rows go to numpy and back as Arrow's flat numbers, none by itself."""
    names = kind.names if isinstance(kind, T.StructType) else None
    kinds = [to_arrow_type(x.dataType) for x in kind.fields] if names else [to_arrow_type(kind)]

    def solve(columns: tuple[pa.Array, ...]) -> list[pa.Array]:
        n, ranks = len(columns[0]), [_rank(c.type) for c in columns]
        found = [_shapes(c) for c in columns]
        shapes = np.concatenate([x[0] for x in found], 1)
        usable = np.flatnonzero((shapes >= 0).all(1))
        parts, at = [[] for _ in kinds], []
        every, which = np.unique(shapes[usable], axis=0, return_inverse=True)
        for k, shape in enumerate(every):
            rows = usable[which.ravel() == k]
            stacks = []
            for c, (rank, (_, start, numbers)) in enumerate(zip(ranks, found, strict=True)):
                lengths = tuple(shape[2 * c : 2 * c + rank])
                stacks.append(numbers[start[rows][:, None] + np.arange(int(np.prod(lengths, dtype=int)))].reshape(len(rows), *lengths))
            with np.errstate(all="ignore"):
                got, ok = f(*stacks)
            at.append(rows)
            for part, values, t in zip(parts, got if names else (got,), kinds, strict=True):
                part.append(_arrow(values, np.asarray(ok, bool), t))
        if not at:
            return [pa.nulls(n, t) for t in kinds]
        place = np.full(n, -1)
        place[np.concatenate(at)] = np.arange(sum(map(len, at)))
        place = pa.array(place, mask=place < 0)
        return [pa.concat_arrays(part).take(place) for part in parts]

    @F.arrow_udf(kind)
    def run(*columns: pa.Array) -> pa.Array:
        out = solve(columns)
        return pa.StructArray.from_arrays(out, names) if names else out[0]

    return run(*cols)


def _rank(t: pa.DataType) -> int:
    return 1 + _rank(t.value_type) if pa.types.is_list(t) or pa.types.is_large_list(t) else 0


def _all(x: np.ndarray) -> np.ndarray:
    """Whether all entries of each row of a stack hold."""
    return x.reshape(len(x), -1).all(1)


def _norm(x: np.ndarray) -> np.ndarray:
    return np.linalg.norm(x, axis=-1, keepdims=True)


def _signed(v: np.ndarray) -> np.ndarray:
    """Of each vector and its negative, the one whose largest entry is positive."""
    top = np.take_along_axis(v, np.abs(v).argmax(-1)[..., None], -1)
    return v * np.where(top < 0, -1.0, 1.0)


def _fixed_point(linear: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The point nearest to the origin that x -> linear x + shift keeps, and whether there is one."""
    held = np.eye(3) - linear
    point = (np.linalg.pinv(held, rcond=1e-9) @ shift[..., None])[..., 0]
    off = (held @ point[..., None])[..., 0] - shift
    return point, _norm(off)[:, 0] <= 1e-6 * (1 + _norm(shift)[:, 0])


def inverse(m: Column) -> Column:
    """Null for a singular matrix."""

    def solve(a):
        ok = np.linalg.cond(a) < 1e15
        return np.linalg.inv(np.where(ok[:, None, None], a, np.eye(a.shape[-1]))), ok

    return _stacked(solve, MATRIX, m)


def triangulate(p1: Column, x1: Column, p2: Column, x2: Column) -> Column:
    """Point seen at x1 and x2 (pixel pairs) by 3x4 projections: the null vector of four equations."""

    def solve(a, u, b, v):
        rows = [x[:, k, None] * m[:, 2] - m[:, k] for m, x in ((a, u), (b, v)) for k in (0, 1)]
        x = np.linalg.svd(np.stack(rows, 1))[2][:, -1]
        return x[:, :3] / x[:, 3:], np.abs(x[:, 3]) > 1e-12

    return _stacked(solve, VECTOR, p1, x1, p2, x2)


def decompose_essential(e: Column) -> Column:
    """struct(r1, r2, t): the two turns (right-handed) and the unit step."""

    def split(m):
        u, _, vt = np.linalg.svd(m)
        w = np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1.0]])
        turns = [u @ x @ vt for x in (w, w.T)]
        return [r * np.sign(np.linalg.det(r))[:, None, None] for r in turns] + [u[..., 2]], np.ones(len(m), bool)

    return _stacked(split, _struct(r1=MATRIX, r2=MATRIX, t=VECTOR), e)


def epipole(f: Column) -> Column:
    """The right null vector, last entry 1; null for an epipole at infinity."""

    def null(m):
        v = np.linalg.svd(m)[2][:, -1]
        return v / v[:, 2:], np.abs(v[:, 2]) > 1e-12

    return _stacked(null, VECTOR, f)


def factor_projection(p: Column) -> Column:
    """struct(k, r, t) of a 3x4 projection, by RQ with a positive diagonal."""

    def split(m):
        ok = np.abs(np.linalg.det(m[:, :, :3])) > 1e-12
        m = np.where(ok[:, None, None], m, np.eye(3, 4))
        flip = np.eye(3)[::-1]
        q, r = np.linalg.qr((flip @ m[:, :, :3]).swapaxes(1, 2))
        k, rot = flip @ r.swapaxes(1, 2) @ flip, flip @ q.swapaxes(1, 2)
        sign = np.sign(np.diagonal(k, axis1=1, axis2=2))
        k, rot = k * sign[:, None, :], sign[:, :, None] * rot
        return (k / k[:, 2:, 2:], rot, np.linalg.solve(k, m[:, :, 3:])[..., 0]), ok

    return _stacked(split, _struct(k=MATRIX, r=MATRIX, t=VECTOR), p)


def rotation_parts(m: Column) -> Column:
    """struct(angle, direction, point) of a rotation about an axis: angle from 0 to pi, the unit axis, its point nearest to the
    origin. No turn at all has the z axis and the origin. Null for what is no rotation, or moves along its axis as well.

    R - R' holds 2 sin(angle) times the axis. Near half a turn that is nothing, but R + R' - 2 cos(angle) I is then
    2 (1 - cos(angle)) times the axis' outer product, so its longest column lies along the axis.
    """

    def split(a):
        r, rt = a[:, :3, :3], a[:, :3, :3].swapaxes(1, 2)
        is_turn = _all(np.abs(r @ rt - np.eye(3)) < 1e-6) & (np.linalg.det(r) > 0)
        twist = np.stack([rt[:, 1, 2] - rt[:, 2, 1], rt[:, 2, 0] - rt[:, 0, 2], rt[:, 0, 1] - rt[:, 1, 0]], 1) / 2
        sine, cosine = _norm(twist)[:, 0], (np.trace(r, axis1=1, axis2=2) - 1) / 2
        angle = np.arctan2(sine, cosine)
        outer = r + rt - 2 * cosine[:, None, None] * np.eye(3)
        longest = np.linalg.norm(outer, axis=1).argmax(1)
        column = np.take_along_axis(outer, longest[:, None, None], 2)[..., 0]
        column *= np.where((column * twist).sum(1, keepdims=True) < 0, -1.0, 1.0)
        axis = np.where(sine[:, None] > 1e-6, twist / sine[:, None], np.where(cosine[:, None] > 0, [0.0, 0.0, 1.0], column / _norm(column)))
        point, there = _fixed_point(r, a[:, :3, 3])
        return (angle, axis, point), is_turn & there

    return _stacked(split, _struct(angle=T.DoubleType(), direction=VECTOR, point=VECTOR), m)


def reflection_parts(m: Column) -> Column:
    """struct(point, normal) of a mirror matrix: (I - R) / 2 is the normal's outer product. The normal's largest entry is
    positive. Null for what is no mirror."""

    def split(a):
        w, v = np.linalg.eigh((np.eye(3) - a[:, :3, :3]) / 2)
        ok = _all(np.abs(w - [0, 0, 1]) < 1e-6)
        return (a[:, :3, 3] / 2, _signed(v[..., 2])), ok  # the mirror image of the origin is twice the plane's nearest point

    return _stacked(split, _struct(point=VECTOR, normal=VECTOR), m)


def scale_parts(m: Column) -> Column:
    """struct(factor, origin, direction) of a scaling. What it adds to the identity is symmetric: (factor - 1) I if it is
    uniform, then direction is null, and (factor - 1) times the direction's outer product otherwise. The direction's
    largest entry is positive; origin is the fixed point nearest to the origin. Null for what is no scaling."""

    def split(a):
        more = a[:, :3, :3] - np.eye(3)
        w, v = np.linalg.eigh((more + more.swapaxes(1, 2)) / 2)
        order = np.abs(w).argsort(1)
        w = np.take_along_axis(w, order, 1)
        size = np.abs(w[:, 2])
        uniform = np.abs(w[:, 2] - w[:, 0]) <= 1e-9 * (1 + size)
        single = np.abs(w[:, 1]) <= 1e-9 * (1 + size)
        along = _signed(np.take_along_axis(v, order[:, None, 2:], 2)[..., 0])
        origin, there = _fixed_point(a[:, :3, :3], a[:, :3, 3])
        symmetric = _all(np.abs(more - more.swapaxes(1, 2)) < 1e-9)
        return (1 + w[:, 2], origin, [None if u else d for u, d in zip(uniform, along.tolist(), strict=True)]), symmetric & (uniform | single) & there

    return _stacked(split, _struct(factor=T.DoubleType(), origin=VECTOR, direction=VECTOR), m)


def projection_parts(m: Column, pseudo: bool = False) -> Column:
    """struct(point, normal, direction, perspective, pseudo) of a projection to a plane: point is the plane's nearest to the
    origin. direction is null for an orthogonal projection, perspective for a parallel one; pseudo is as given, for
    perspective projections that keep the relative depth. Null for what is no projection.

    A parallel projection takes a rank-one part, direction times normal, off the identity. A perspective one has the
    normal in its last row, and its other rows are lambda I less an outer product with the normal: the trace gives
    lambda, and the product's vector the centre.
    """

    def parallel(a):
        off = np.eye(3) - a[:, :3, :3]
        u, s, vt = np.linalg.svd(off)
        normal = _signed(vt[:, 0])
        direction = _signed(u[..., 0])
        point = (a[:, :3, 3] * normal).sum(1, keepdims=True) * normal
        straight = _all(np.abs(np.abs(normal * direction).sum(1, keepdims=True) - 1) < 1e-9) | (np.abs((normal * direction).sum(1)) > 1 - 1e-12)
        # the plane keeps its points: the image of the origin lies in it
        ok = (s[:, 1] < 1e-9 * (1 + s[:, 0])) & (np.abs(np.trace(off, axis1=1, axis2=2) - 1) < 1e-9)
        return point, normal, direction, straight, ok

    def central(a):
        row = -a[:, 3, :3]
        size = _norm(row)
        normal, m_ = row / size, a / size[..., None]
        level = (np.trace(m_, axis1=1, axis2=2) + (1 if pseudo else 0)) / 3
        rest = level[:, None, None] * np.eye(3) - m_[:, :3, :3]
        centre = (rest @ normal[..., None])[..., 0] - (normal if pseudo else 0)
        height = (centre * normal).sum(1) - level
        outer = (centre + (normal if pseudo else 0))[..., None] * normal[:, None]
        ok = (_norm(row)[:, 0] > 1e-12) & _all(np.abs(rest - outer) < 1e-6 * (1 + np.abs(rest).max((1, 2), keepdims=True))) & (np.abs(level) > 1e-12)
        return height[:, None] * normal, normal, centre, ok

    def split(a):
        flat = (np.abs(a[:, 3, :3]) < 1e-12).all(1) & (not pseudo)
        p, n, d, straight, ok = parallel(a)
        p2, n2, c, ok2 = central(np.where(flat[:, None, None], np.eye(4) + np.eye(4, k=-1), a))
        none = lambda keep, x: [v if k else None for k, v in zip(keep, x.tolist(), strict=True)]
        at = flat[:, None]
        return (np.where(at, p, p2), np.where(at, n, n2), none(flat & ~straight, d), none(~flat, c), (~flat & pseudo)), np.where(flat, ok, ok2)

    return _stacked(split, _struct(point=VECTOR, normal=VECTOR, direction=VECTOR, perspective=VECTOR, pseudo=T.BooleanType()), m)


def shear_parts(m: Column) -> Column:
    """struct(angle, direction, point, normal) of a shear: the direction and normal of its rank-one part, angle positive, and
    the point of its fixed plane nearest to the origin. Null for what is no shear, or shears nothing."""

    def split(a):
        u, s, vt = np.linalg.svd(a[:, :3, :3] - np.eye(3))
        d, n = u[..., 0], vt[:, 0]
        flip = np.where(np.take_along_axis(d, np.abs(d).argmax(1)[:, None], 1) < 0, -1.0, 1.0)
        d, n = d * flip, n * flip
        # the shift is -tan(angle) (point . normal) along the direction
        point = -((a[:, :3, 3] * d).sum(1) / s[:, 0])[:, None] * n
        ok = (s[:, 0] > 1e-12) & (s[:, 1] < 1e-9 * (1 + s[:, 0])) & (np.abs((d * n).sum(1)) < 1e-6)
        return (np.arctan(s[:, 0]), d, point, n), ok

    return _stacked(split, _struct(angle=T.DoubleType(), direction=VECTOR, point=VECTOR, normal=VECTOR), m)


def decompose(m: Column) -> Column:
    """struct(scale, shear, angles, translate, perspective) of a 4x4 matrix: M = T R (upper triangle of scales and shears)
    with angles about fixed x, y, z. Null for a singular matrix."""

    def split(a):
        ok = (np.abs(np.linalg.det(a[:, :3, :3])) > 1e-12) & (np.abs(a[:, 3, 3]) > 1e-12)
        a = np.where(ok[:, None, None], a, np.eye(4))
        a = a / a[:, 3:, 3:]
        affine = a.copy()
        affine[:, 3] = [0, 0, 0, 1]
        perspective = (a[:, 3:] @ np.linalg.inv(affine))[:, 0]
        q, r = np.linalg.qr(a[:, :3, :3])
        sign = np.where(np.diagonal(r, axis1=1, axis2=2) < 0, -1.0, 1.0)
        q, r = q * sign[:, None, :], sign[:, :, None] * r
        hand = np.sign(np.linalg.det(q))[:, None, None]
        q, r = q * hand, r * hand
        d = np.diagonal(r, axis1=1, axis2=2)
        angles = np.stack([np.arctan2(q[:, 2, 1], q[:, 2, 2]), np.arcsin(np.clip(-q[:, 2, 0], -1, 1)), np.arctan2(q[:, 1, 0], q[:, 0, 0])], 1)
        shear = np.stack([r[:, 0, 1] / d[:, 0], r[:, 0, 2] / d[:, 0], r[:, 1, 2] / d[:, 1]], 1)
        return (d, shear, angles, a[:, :3, 3], perspective), ok

    return _stacked(split, _struct(scale=VECTOR, shear=VECTOR, angles=VECTOR, translate=VECTOR, perspective=VECTOR), m)


def compose(parts: Column) -> Column:
    """The matrix of such a struct."""

    def build(scale, shear, angles, translate, perspective):
        n = len(scale)
        (cx, cy, cz), (sx, sy, sz) = np.cos(angles).T, np.sin(angles).T
        zero, one = np.zeros(n), np.ones(n)
        rows = lambda *m: np.array(m).transpose(2, 0, 1)
        about = rows([cz, -sz, zero], [sz, cz, zero], [zero, zero, one]) @ rows([cy, zero, sy], [zero, one, zero], [-sy, zero, cy]) @ rows([one, zero, zero], [zero, cx, -sx], [zero, sx, cx])
        upper = rows([one, shear[:, 0], shear[:, 1]], [zero, one, shear[:, 2]], [zero, zero, one])
        m = np.tile(np.eye(4), (n, 1, 1))
        m[:, :3, :3], m[:, :3, 3] = about @ (scale[:, :, None] * upper), translate
        p = np.tile(np.eye(4), (n, 1, 1))
        p[:, 3] = perspective
        return p @ m, np.ones(n, bool)

    return _stacked(build, MATRIX, *[parts[n] for n in ("scale", "shear", "angles", "translate", "perspective")])


# fundamental matrices


def eight_point(x1: np.ndarray, x2: np.ndarray) -> np.ndarray:
    """x2' F x1 = 0 by the normalised eight-point method."""

    def scaled(x):
        c = x.mean(0)
        s = np.sqrt(2) / max(1e-12, np.sqrt(((x - c) ** 2).sum(1)).mean())
        t = np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1]])
        return np.column_stack([x, np.ones(len(x))]) @ t.T, t

    a, ta = scaled(x1)
    b, tb = scaled(x2)
    # the triangle of a QR has the same right vectors; the left ones would be matches by matches
    rows = np.linalg.qr((b[:, :, None] * a[:, None, :]).reshape(len(a), 9), "r")
    f = np.linalg.svd(rows)[2][-1].reshape(3, 3)
    u, s, vt = np.linalg.svd(f)
    f = tb.T @ (u @ np.diag([s[0], s[1], 0]) @ vt) @ ta
    return f / (f[2, 2] if abs(f[2, 2]) > 1e-12 else np.linalg.norm(f))


def ransac_fundamental(x1: np.ndarray, x2: np.ndarray, threshold: float = 3.0, rounds: int = 500, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """F and the mask of matches within the threshold (pixels from the epipolar line)."""
    rng = np.random.default_rng(seed)
    h1, h2 = np.column_stack([x1, np.ones(len(x1))]), np.column_stack([x2, np.ones(len(x2))])

    def far(f):
        l2, l1 = h1 @ f.T, h2 @ f
        d = np.abs((h2 * l2).sum(1))
        return np.maximum(d / np.hypot(l2[:, 0], l2[:, 1]), d / np.hypot(l1[:, 0], l1[:, 1]))

    best = np.zeros(len(x1), bool)
    for _ in range(rounds):
        pick = rng.choice(len(x1), 8, replace=False)
        mask = far(eight_point(x1[pick], x2[pick])) < threshold
        if mask.sum() > best.sum():
            best = mask
    if best.sum() < 8:
        best = np.ones(len(x1), bool)
    f = eight_point(x1[best], x2[best])
    return f, far(f) < threshold


def fundamental(matches: DataFrame, by: list[str], method: str = "ransac", threshold: float = 3.0) -> DataFrame:
    """(by, u1, v1, u2, v2) -> (by, f, inliers): one matrix a pair of views; fewer than eight matches give none."""
    fields = ", ".join(f"`{c}` {matches.schema[c].dataType.simpleString()}" for c in by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < 8:
            return pd.DataFrame({**{c: [] for c in by}, "f": [], "inliers": []})
        pdf = pdf.sort_values(["u1", "v1", "u2", "v2"])
        a, b = pdf[["u1", "v1"]].to_numpy(float), pdf[["u2", "v2"]].to_numpy(float)
        f, mask = ransac_fundamental(a, b, threshold) if method == "ransac" else (eight_point(a, b), np.ones(len(a), bool))
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in by}, "f": [f.tolist()], "inliers": [int(mask.sum())]})

    return matches.groupBy(*by).applyInPandas(run, f"{fields}, f array<array<double>>, inliers bigint")
