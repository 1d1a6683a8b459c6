"""Weighted polynomials and Fourier filters over the sliding windows of whole series.

One exchange makes an array of each series; kernels run on Arrow batches as matrices of many series, a matrix per
offset from the window's centre, so that a row costs its values and not a copy of its window. NaN stands for NULL. Sums are
taken in the order of the offsets, as ``series.fit_window`` does with expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from terraloom.operators.spectral import fill_rows, low_pass
from terraloom.schema import HALF

#: Series that a kernel takes at once.
CHUNK = 64

#: A matrix (series, centres) for each offset from the window's centre.
Window = list[np.ndarray]


def around(m: np.ndarray, half: int = HALF) -> Window:
    """The windows of the rows of ``m``, as views."""
    n = m.shape[1] - 2 * half
    return [m[:, k : k + n] for k in range(2 * half + 1)]


def filled_online(m: np.ndarray, head: int) -> np.ndarray:
    """Rows of ``m`` with gaps interpolated in their first ``head`` epochs, and the last value carried forward from there, as
    a cube does that is filled once and then shifted."""
    last = np.maximum.accumulate(np.where(np.isfinite(m), np.arange(m.shape[1]), -1), axis=1)
    carried = np.where(last >= 0, m[np.arange(len(m))[:, None], np.maximum(last, 0)], np.nan)
    return np.concatenate([fill_rows(m[:, :head]), carried[:, head:]], axis=1)


def coefficients(v: Window, w: Window, degree: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a0, a1, a2) of the weighted least-squares polynomial of each window; NaN if it is not determined. A weight without a
    value counts on the left-hand side only."""
    half = len(v) // 2
    s0, s1, s2, s3, s4, y0, y1, y2 = (np.zeros(v[0].shape) for _ in range(8))
    for k, (vk, wk) in enumerate(zip(v, w, strict=True)):
        t = float(k - half)
        y, wk = np.nan_to_num(wk * vk), np.nan_to_num(wk)
        for total, term in ((s0, wk), (s1, wk * t), (s2, wk * (t * t)), (s3, wk * (t * t * t)), (s4, wk * (t * t * (t * t))), (y0, y), (y1, y * t), (y2, y * (t * t))):
            total += term
    with np.errstate(divide="ignore", invalid="ignore"):
        if degree == 1:
            det = s0 * s2 - s1 * s1
            det = np.where(det != 0, det, np.nan)
            return (s2 * y0 - s1 * y1) / det, (s0 * y1 - s1 * y0) / det, np.zeros(det.shape)
        det = s0 * s2 * s4 + 2.0 * s1 * s2 * s3 - s2 * s2 * s2 - s1 * s1 * s4 - s0 * s3 * s3
        det = np.where(np.abs(det) > 1e-9 * s0 * s2 * s4, det, np.nan)
        c00, c01, c02 = s2 * s4 - s3 * s3, s2 * s3 - s1 * s4, s1 * s3 - s2 * s2
        c11, c12, c22 = s0 * s4 - s2 * s2, s1 * s2 - s0 * s3, s0 * s2 - s1 * s1
        return (c00 * y0 + c01 * y1 + c02 * y2) / det, (c01 * y0 + c11 * y1 + c12 * y2) / det, (c02 * y0 + c12 * y1 + c22 * y2) / det


def fitted(c: tuple[np.ndarray, ...], half: int = HALF) -> Window:
    """The rounded fit at every position of the windows."""
    return [np.rint(c[0] + c[1] * t + c[2] * (t * t)) for t in range(-half, half + 1)]


def reweighted(v: Window, fit: Window) -> Window:
    """Weights of the next pass: the sum of the absolute residuals over each of them, none below 1."""
    with np.errstate(invalid="ignore", divide="ignore"):
        distance = [np.maximum(np.abs(f - x), 1.0) for f, x in zip(fit, v, strict=True)]
        total = np.zeros(distance[0].shape)
        for d in distance:
            total += np.nan_to_num(d)
        return [total / d for d in distance]


def refit(v: Window, w: Window, passes: int = 2, second: str = "raw") -> tuple[tuple[np.ndarray, ...], Window, Window]:
    """Coefficients of the last of ``passes`` passes with residual weights in between, and the values and weights that it had.
    Later passes fit the values (``'raw'``) or the fit before (``'fit'``)."""
    c = coefficients(v, w)
    for _ in range(1, passes):
        fit = fitted(c, len(v) // 2)
        w = reweighted(v, fit)
        v = v if second == "raw" else fit
        c = coefficients(v, w)
    return c, v, w


def filtered(v: Window, passes: int = 1, rounded: bool = True) -> Window:
    """Each window interpolated and low-pass filtered, ``passes`` times over; rounded after each pass but, without
    ``rounded``, the last."""
    m = np.stack(v, axis=2)
    flat = m.reshape(-1, len(v))
    for i in range(passes):
        flat = low_pass(fill_rows(flat))
        flat = np.rint(flat) if rounded or i + 1 < passes else flat
    return [flat.reshape(m.shape)[:, :, k] for k in range(len(v))]


def statistics(v: Window, w: Window) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least and largest value of each window, and whether it has too few observations around the centre for a parabola."""
    half = len(v) // 2
    low, high = np.fmin.reduce(v), np.fmax.reduce(v)
    seen = [np.isfinite(x) for x in w]
    left, right, n = sum(x.astype(int) for x in seen[:half]), sum(x.astype(int) for x in seen[half + 1 :]), sum(x.astype(int) for x in seen)
    return low, high, (left <= 3) | (right <= 3) | ~seen[half] | (n <= half)


def over_series(df: DataFrame, keys: Sequence[str], run: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], outputs: Sequence[str], half: int = HALF, value: str = "v", weight: str = "w") -> DataFrame:
    """(keys, t, outputs) of every row with a full window around it: what ``run`` makes of matrices of values and weights
    (series, epochs), a matrix (series, centres) per output. Series shorter than a window go, and so do rows whose window
    lacks an epoch: there are as many rows in it, but not as many consecutive ``t``."""
    cell = F.struct("t", F.col(value).cast("double").alias("v"), F.col(weight).cast("double").alias("w"))
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(cell)).alias("c")).where(F.size("c") > 2 * half)
    rows = rows.select(*keys, F.col("c.t").alias("t"), F.col("c.v").alias("v"), F.col("c.w").alias("w"))
    n = len(keys)
    schema = StructType([*rows.schema.fields[:n], StructField("t", df.schema["t"].dataType), *(StructField(o, DoubleType()) for o in outputs)])

    def matrix(column: pa.Array, length: int) -> np.ndarray:
        flat = column.flatten()
        return np.where(flat.is_null().to_numpy(zero_copy_only=False), np.nan, flat.fill_null(0).to_numpy()).reshape(-1, length)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = b.column(n).value_lengths().to_numpy()
            cuts = np.flatnonzero(np.r_[True, lengths[1:] != lengths[:-1]]).tolist() if len(lengths) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(lengths)], strict=True):
                for at in range(lo, hi, CHUNK):
                    part, length = b.slice(at, min(CHUNK, hi - at)), int(lengths[lo])
                    centres = length - 2 * half
                    made = run(matrix(part.column(n + 1), length), matrix(part.column(n + 2), length))
                    owner = pa.array(np.repeat(np.arange(part.num_rows), centres))
                    t = part.column(n).flatten().to_numpy().reshape(-1, length)
                    whole = (t[:, 2 * half :] - t[:, :centres] == 2 * half).ravel()
                    out = pa.RecordBatch.from_arrays(
                        [*(part.column(i).take(owner) for i in range(n)), pa.array(t[:, half : half + centres].ravel()), *(pa.array(np.ascontiguousarray(made[o], np.float64).ravel(), from_pandas=True) for o in outputs)], names=schema.names
                    )
                    yield out if whole.all() else out.filter(pa.array(whole))

    return rows.mapInArrow(mapped, schema)
