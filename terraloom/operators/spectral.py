"""Fourier filters and harmonic fits over blocks of a series.

Blocks of equal length become arrays (one exchange by series and block); kernels then run on Arrow batches as
matrices of many blocks at once. The equal-weight harmonic fit needs no kernel and stays in expressions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from terraloom.sources.stores import kept

#: Blocks that a kernel sees at once, at most: a weighted fit of 7 harmonics holds some ten times 46 x 15 numbers of each.
TOGETHER = 512
#: Spectral powers within this relative distance of the largest count as equal to it.
SAME = 1e-12


def fill_rows(m: np.ndarray) -> np.ndarray:
    """Each row with its gaps interpolated, flat beyond the ends, and rounded where there were gaps; rows without a
    value stay NaN."""
    n = m.shape[1]
    known = np.isfinite(m)
    at = np.arange(n)
    before = np.maximum.accumulate(np.where(known, at, -1), axis=1)
    after = np.minimum.accumulate(np.where(known, at, n)[:, ::-1], axis=1)[:, ::-1]
    row = np.arange(len(m))[:, None]
    lo, hi = np.clip(before, 0, n - 1), np.clip(after, 0, n - 1)
    p, q = m[row, lo], m[row, hi]
    with np.errstate(invalid="ignore", divide="ignore"):
        line = np.rint(p + (q - p) * (at - before) / (after - before))
    out = np.where(known, m, np.where(before < 0, q, np.where(after >= n, p, line)))
    return np.where(known.any(axis=1)[:, None], out, np.nan)


def low_pass(m: np.ndarray, threshold: str = "half_second") -> np.ndarray:
    """Rows of ``m`` with only the frequencies whose power exceeds half that of the strongest but the largest
    (``half_second``), or half the whole part of the largest (``half_largest``)."""
    if not m.size:
        return m
    f = np.fft.fft(m, axis=1)
    power = (f.real**2 + f.imag**2) / m.shape[1]
    top = power.max(axis=1, keepdims=True)
    if threshold == "half_second":
        limit = np.where(power >= top * (1 - SAME), 0, power).max(axis=1, keepdims=True) / 2
    else:
        limit = np.trunc(top) / 2
    return np.fft.ifft(np.where(power > limit, f, 0), axis=1).real


def harmonic_basis(length: int, harmonics: int) -> np.ndarray:
    """Columns 1, cos t, sin t, cos 2t, .. for t = 1..length over one period."""
    angle = 2 * math.pi / length * np.outer(np.arange(1, length + 1), np.arange(1, harmonics + 1))
    return np.concatenate([np.ones((length, 1)), np.stack([np.cos(angle), np.sin(angle)], axis=2).reshape(length, -1)], axis=1)


def harmonic_solution(m: np.ndarray, w: np.ndarray, harmonics: int) -> tuple[np.ndarray, np.ndarray]:
    """Weighted least-squares harmonics of each row, and whether its system could be solved; where not, the row as it is."""
    a = harmonic_basis(m.shape[1], harmonics)
    aw = a[None] * w[:, :, None]
    normal, right = aw.transpose(0, 2, 1) @ a, aw.transpose(0, 2, 1) @ m[:, :, None]
    sound = np.isfinite(right).all(axis=(1, 2)) & (np.linalg.cond(np.where(np.isfinite(normal), normal, 0)) < 1e12)
    out = m.copy()
    if sound.any():
        out[sound] = (a[None] @ np.linalg.solve(normal[sound], right[sound]))[:, :, 0]
    return out, sound


def harmonic_fit(m: np.ndarray, w: np.ndarray, harmonics: int) -> np.ndarray:
    return harmonic_solution(m, w, harmonics)[0]


def to_blocks(df: DataFrame, keys: Sequence[str], value: str = "v", weight: str | None = None, position: str = "k") -> DataFrame:
    """One row per block: its key columns, ``vs`` and, with a weight, ``ws`` in the order of positions."""
    cell = F.struct(F.col(position).alias("k"), F.col(value).cast("double").alias("v"), *([F.col(weight).cast("double").alias("w")] if weight else []))
    out = df.groupBy(*keys).agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    return out.select(*keys, F.col("cells.v").alias("vs"), *([F.col("cells.w").alias("ws")] if weight else []))


def _kernel(blocks: DataFrame, out: str, run) -> DataFrame:
    """Adds ``out``: ``run(vs, ws)`` over matrices of ``TOGETHER`` blocks at most, NaN being NULL. All blocks have the same length."""
    names = blocks.columns
    schema = StructType([*blocks.schema.fields, StructField(out, ArrayType(DoubleType()))])

    def matrix(column: pa.Array) -> np.ndarray:
        flat = column.flatten()
        return np.where(flat.is_null().to_numpy(zero_copy_only=False), np.nan, flat.fill_null(0).to_numpy()).reshape(len(column), -1)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            for part in (b.slice(i, TOGETHER) for i in range(0, b.num_rows, TOGETHER)):
                vs = matrix(part.column(names.index("vs")))
                ws = matrix(part.column(names.index("ws"))) if "ws" in names else None
                made = run(vs, ws)
                flat = pa.array(made.ravel(), from_pandas=True)
                ends = pa.array(np.arange(0, made.size + 1, max(1, made.shape[1])), pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(ends, flat)], names=schema.names)

    return blocks.mapInArrow(mapped, schema)


def fft_filter(blocks: DataFrame, out: str = "filtered", passes: int = 1, threshold: str = "half_second", rounded: bool = True) -> DataFrame:
    """Interpolated and low-pass filtered blocks, ``passes`` times over; rounded after each pass but, without
    ``rounded``, the last."""

    def run(vs: np.ndarray, _) -> np.ndarray:
        for i in range(passes):
            vs = low_pass(fill_rows(vs), threshold)
            vs = np.rint(vs) if rounded or i + 1 < passes else vs
        return vs

    return _kernel(blocks, out, run)


def dft_fit(blocks: DataFrame, harmonics: int, out: str = "fitted", rounded: bool = True) -> DataFrame:
    """Weighted harmonic fits of interpolated blocks."""

    def run(vs: np.ndarray, ws: np.ndarray) -> np.ndarray:
        fit = harmonic_fit(fill_rows(vs), np.nan_to_num(ws), harmonics)
        return np.rint(fit) if rounded else fit

    return _kernel(blocks, out, run)


def dft_solvable(blocks: DataFrame, harmonics: int, out: str = "solvable") -> DataFrame:
    """Adds ``out``, an array with 1 where the weighted harmonic fit of a block could be solved, else 0."""
    return _kernel(blocks, out, lambda vs, ws: harmonic_solution(fill_rows(vs), np.nan_to_num(ws), harmonics)[1][:, None].astype(float))


def equal_weight_harmonics(value: Column, position: Column, length: int, harmonics: int) -> list[Column]:
    """Aggregates for the harmonics of a full block under equal weights: mean, and a cosine and sine each."""
    out = [F.avg(value).alias("c0")]
    for h in range(1, harmonics + 1):
        angle = position * (2 * math.pi * h / length)
        out += [(F.sum(value * F.cos(angle)) * (2 / length)).alias(f"a{h}"), (F.sum(value * F.sin(angle)) * (2 / length)).alias(f"b{h}")]
    return out


def from_blocks(df: DataFrame, keys: Sequence[str], *columns: str) -> DataFrame:
    """One row per block and position ``k`` (1..) with the elements of array ``columns``."""
    zipped = F.arrays_zip(*columns)
    return df.select(*keys, F.posexplode(zipped).alias("k", "c")).select(*keys, (F.col("k") + 1).alias("k"), *(F.col(f"c.{c}").alias(c) for c in columns))


def with_neighbours(blocks: DataFrame, harmonics: int, pixel: str = "px", period: str = "block", side: int = 150, reach: int = 3) -> DataFrame:
    """``blocks`` (pixel, period, vs, ws) with ``fitted``, the weighted harmonic fit, and ``solvable``. What can't be solved becomes, epoch
    by epoch, the mean of the interpolated series of the pixels up to ``reach`` before and after it in its square of ``side`` x
    ``side`` pixels, itself included; the last pixel of a square but one looks 2 pixels far, the last one 1. Neighbours without any
    value don't count; where none has one the fit is NULL. Only the neighbours of unsolved pixels are looked up."""
    filled = _kernel(blocks, "_filled", lambda vs, ws: fill_rows(vs))
    told = kept(dft_solvable(dft_fit(filled, harmonics, rounded=False), harmonics).withColumn("solvable", F.col("solvable")[0] == 1))
    n = side * side
    i = F.pmod(F.col(pixel), F.lit(n))
    far = F.when(i == n - 1, F.lit(min(1, reach))).when(i == n - 2, F.lit(min(2, reach))).otherwise(reach)
    asked = told.where(~F.col("solvable")).select(pixel, period, F.explode(F.sequence(F.greatest(F.col(pixel) - far, F.col(pixel) - i), F.least(F.col(pixel) + far, F.col(pixel) - i + n - 1))).alias("_other"))
    others = told.select(F.col(pixel).alias("_other"), period, "_filled")
    means = asked.join(others, ["_other", period]).select(pixel, period, F.posexplode("_filled").alias("_k", "_v")).groupBy(pixel, period, "_k").agg(F.avg("_v").alias("_v"))
    lists = means.groupBy(pixel, period).agg(F.array_sort(F.collect_list(F.struct("_k", "_v"))).alias("_near")).select(pixel, period, F.col("_near._v").alias("_near"))
    joined = told.join(lists, [pixel, period], "left")
    return joined.withColumn("fitted", F.when(F.col("solvable"), F.col("fitted")).otherwise(F.col("_near"))).drop("_near", "_filled")


def spline_rows(m: np.ndarray) -> np.ndarray:
    """Rows of ``m`` with gaps between known values filled by the cubic spline through these that has no knot next to its ends; what is
    before the first or after the last known value stays NaN. Three known values give a parabola, two a line, one itself.

    All rows' tridiagonal systems are solved at once: known values are moved to the left, and each step of the elimination
    takes one column of all rows."""
    rows, length = m.shape
    known = np.isfinite(m)
    n = known.sum(axis=1)
    order = np.argsort(~known, axis=1, kind="stable")
    x, y = order.astype(float), np.take_along_axis(m, order, axis=1)
    out = np.where(known, m, np.nan)
    most = int(n.max(initial=0))
    if most < 2:
        return out
    x, y = x[:, :most], np.where(np.arange(most) < n[:, None], y[:, :most], 0.0)
    h = np.where(np.arange(most - 1) < (n - 1)[:, None], np.diff(x, axis=1), 1.0)
    d = np.diff(y, axis=1) / h
    second = np.zeros((rows, most))
    if most > 2:
        lower, middle, upper = h[:, :-1].copy(), 2 * (h[:, :-1] + h[:, 1:]), h[:, 1:].copy()
        right = 6 * np.diff(d, axis=1)
        last = np.clip(n - 3, 0, most - 3)
        at = np.arange(rows)
        many = n > 3
        first_h, next_h = h[:, 0], h[:, 1]
        middle[many, 0] += (first_h * (1 + first_h / next_h))[many]
        upper[many, 0] -= (first_h**2 / next_h)[many]
        end_h, prior_h = h[at, np.clip(n - 2, 0, most - 2)], h[at, np.clip(n - 3, 0, most - 2)]
        middle[at[many], last[many]] += (end_h * (1 + end_h / prior_h))[many]
        lower[at[many], last[many]] -= (end_h**2 / prior_h)[many]
        three = n == 3
        middle[three, 0], right[three, 0] = 1.0, (2 * (d[:, 1] - d[:, 0]) / (first_h + next_h))[three]
        used = np.arange(most - 2) <= last[:, None]
        lower[:, 0] = 0
        for j in range(1, most - 2):
            f = np.where(used[:, j], lower[:, j] / middle[:, j - 1], 0)
            middle[:, j] -= f * upper[:, j - 1]
            right[:, j] -= f * right[:, j - 1]
        inner = np.zeros((rows, most - 2))
        for j in range(most - 3, -1, -1):
            after = inner[:, j + 1] * upper[:, j] if j < most - 3 else 0
            after = np.where(last == j, 0, after)
            inner[:, j] = np.where(used[:, j] & (n > 2), (right[:, j] - after) / middle[:, j], 0)
        second[:, 1:-1] = inner
        second[three, 0] = second[three, 2] = second[three, 1]
        second[many, 0] = ((1 + first_h / next_h) * second[:, 1] - first_h / next_h * second[:, 2])[many]
        k = np.clip(n - 1, 0, most - 1)
        ratio = end_h / prior_h
        tail = (1 + ratio) * second[at, np.clip(k - 1, 0, None)] - ratio * second[at, np.clip(k - 2, 0, None)]
        second[at[many], k[many]] = tail[many]
    before = np.cumsum(known, axis=1) - 1  # number of the last known value
    gap = ~known & (before >= 0) & (before < (n - 1)[:, None])
    r, c = np.nonzero(gap)
    j = before[r, c]
    step, t = h[r, j], c - x[r, j]
    a, b = second[r, j], second[r, j + 1]
    slope = d[r, j] - step * (2 * a + b) / 6
    out[r, c] = y[r, j] + t * (slope + t * (a / 2 + t * (b - a) / (6 * step)))
    return out


def spline(blocks: DataFrame, out: str = "curve") -> DataFrame:
    """Adds ``out``, the cubic spline through each block's values at every position between its first and last one."""
    return _kernel(blocks, out, lambda vs, _: spline_rows(vs))
