"""Sliding-window and whole-series operators on long-form series.

A series frame has key columns, an integer time column without gaps, a nullable value and a nullable weight. All
operators here share one exchange and one sort by (keys, time); frame aggregates of one step stand in one
``select`` so that they share a Window node. Window fits work on the frame's arrays with higher-order
functions: offsets from the centre keep the sums small, and residual weights need the whole window anyway.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.schema import HALF


def _by(keys: Sequence[str], time: str = "t"):
    return Window.partitionBy(*keys).orderBy(time)


def window_stats(df: DataFrame, keys: Sequence[str], half: int = HALF, value: str = "v", weight: str = "w") -> DataFrame:
    """Extremes of the values and counts of the weights left of, at, right of the centre and in all."""
    w = _by(keys)
    around, left, right = w.rowsBetween(-half, half), w.rowsBetween(-half, -1), w.rowsBetween(1, half)
    return df.select(
        "*",
        F.min(value).over(around).alias("v_min"),
        F.max(value).over(around).alias("v_max"),
        F.count(weight).over(left).alias("n_left"),
        F.count(weight).over(right).alias("n_right"),
        F.count(weight).over(w.rowsBetween(0, 0)).alias("n_centre"),
        F.count(weight).over(around).alias("n_window"),
        F.count(F.lit(1)).over(around).alias("n_rows"),
    )


def linear_is_due(half: int = HALF) -> Column:
    """Too few observations around the centre for a parabola: columns of ``window_stats``."""
    return (F.col("n_left") <= 3) | (F.col("n_right") <= 3) | (F.col("n_centre") == 0) | (F.col("n_window") <= half)


def frames(df: DataFrame, keys: Sequence[str], half: int = HALF, value: str = "v", weight: str = "w", full_only: bool = True) -> DataFrame:
    """Adds ``frame``, the (v, w) of the window around each row; rows without a full window go."""
    around = _by(keys).rowsBetween(-half, half)
    out = df.select("*", F.collect_list(F.struct(F.col(value).cast("double").alias("v"), F.col(weight).cast("double").alias("w"))).over(around).alias("frame"))
    return out.where(F.size("frame") == 2 * half + 1) if full_only else out


_SUMS = ("s0", "s1", "s2", "s3", "s4", "y0", "y1", "y2")


def _moments(frame: Column, half: int) -> Column:
    """Sums of w t^k and w t^k v over a frame, t the offset from the centre. A weight without a value counts on
    the left-hand side only."""
    timed = F.transform(frame, lambda x, i: F.struct((i - half).cast("double").alias("t"), F.coalesce(x["w"], F.lit(0.0)).alias("w"), F.coalesce(x["w"] * x["v"], F.lit(0.0)).alias("y")))
    zero = F.struct(*(F.lit(0.0).alias(s) for s in _SUMS))

    def add(a: Column, x: Column) -> Column:
        t, t2 = x["t"], x["t"] * x["t"]
        terms = (x["w"], x["w"] * t, x["w"] * t2, x["w"] * (t2 * t), x["w"] * (t2 * t2), x["y"], x["y"] * t, x["y"] * t2)
        return F.struct(*((a[s] + v).alias(s) for s, v in zip(_SUMS, terms, strict=True)))

    return F.aggregate(timed, zero, add)


def _coefficients(s: Column, degree: int) -> Column:
    """(a0, a1, a2) of the weighted least-squares polynomial; NULL if it is not determined."""
    s0, s1, s2, s3, s4, y0, y1, y2 = (s[x] for x in _SUMS)
    if degree == 1:
        det = s0 * s2 - s1 * s1
        det = F.when(det != 0, det)
        return F.struct(((s2 * y0 - s1 * y1) / det).alias("a0"), ((s0 * y1 - s1 * y0) / det).alias("a1"), F.lit(0.0).alias("a2"))
    det = s0 * s2 * s4 + F.lit(2.0) * s1 * s2 * s3 - s2 * s2 * s2 - s1 * s1 * s4 - s0 * s3 * s3
    det = F.when(F.abs(det) > 1e-9 * s0 * s2 * s4, det)
    c00, c01, c02 = s2 * s4 - s3 * s3, s2 * s3 - s1 * s4, s1 * s3 - s2 * s2
    c11, c12, c22 = s0 * s4 - s2 * s2, s1 * s2 - s0 * s3, s0 * s2 - s1 * s1
    return F.struct(
        ((c00 * y0 + c01 * y1 + c02 * y2) / det).alias("a0"),
        ((c01 * y0 + c11 * y1 + c12 * y2) / det).alias("a1"),
        ((c02 * y0 + c12 * y1 + c22 * y2) / det).alias("a2"),
    )


def fit_window(df: DataFrame, out: str, frame: str = "frame", half: int = HALF, degree: int = 2) -> DataFrame:
    """Adds ``out``, the coefficients of the weighted polynomial over each row's frame; ``a0`` is the fit at the centre."""
    sums = f"_{out}_sums"
    return df.withColumn(sums, _moments(F.col(frame), half)).withColumn(out, _coefficients(F.col(sums), degree)).drop(sums)


def fitted(frame: str, coefficients: str, half: int = HALF) -> Column:
    """The rounded fit at every position of the frame."""
    c = F.col(coefficients)
    return F.transform(F.col(frame), lambda x, i: F.rint(c["a0"] + c["a1"] * (i - half) + c["a2"] * ((i - half) * (i - half))))


def reweight(df: DataFrame, out: str, coefficients: str, frame: str = "frame", half: int = HALF, values: str = "raw") -> DataFrame:
    """Adds ``out``, the frame with the weights of the next pass: the sum of the absolute residuals over each of them,
    none below 1. Former weights don't matter. The values stay (``'raw'``) or become the fit (``'fit'``)."""
    fit, dist = f"_{out}_fit", f"_{out}_dist"
    df = df.withColumn(fit, fitted(frame, coefficients, half))
    df = df.withColumn(dist, F.zip_with(F.col(frame), F.col(fit), lambda x, f: F.when(x["v"].isNotNull() & f.isNotNull(), F.greatest(F.abs(f - x["v"]), F.lit(1.0)))))
    total = F.aggregate(F.col(dist), F.lit(0.0), lambda a, d: a + F.coalesce(d, F.lit(0.0)))
    value = F.col(frame) if values == "raw" else F.transform(F.col(fit), lambda f: F.struct(f.alias("v")))
    df = df.withColumn("_total", total)
    return df.withColumn(out, F.zip_with(value, F.col(dist), lambda x, d: F.struct(x["v"].alias("v"), (F.col("_total") / d).alias("w")))).drop(fit, dist, "_total")


def interpolate(df: DataFrame, keys: Sequence[str], value: str = "v", out: str = "filled", online_after: int | None = None) -> DataFrame:
    """Adds ``out``: gaps interpolated by time, flat beyond the ends, rounded; series without any value stay empty.
    ``online_after=n`` does so for the first n epochs of a series only, and carries the last value forward from there,
    as a cube does that is filled once and then shifted."""
    w = _by(keys)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    v, known = F.col(value).cast("double"), F.col(value).isNotNull()
    if online_after is not None:
        head = F.row_number().over(w)
        df = df.select("*", head.alias("_n"))
        df = df.select("*", F.when(F.col("_n") <= online_after, F.col(value)).cast("double").alias("_head"))
        v, known = F.col("_head"), F.col("_head").isNotNull()
    at = F.when(known, F.col("t"))
    seen = df.select(
        "*",
        F.last(v, True).over(back).alias("_p"), F.last(at, True).over(back).alias("_pt"),
        F.first(v, True).over(ahead).alias("_n_"), F.first(at, True).over(ahead).alias("_nt"),
        *([F.last(F.col(value).cast("double"), True).over(back).alias("_locf")] if online_after is not None else []),
    )
    p, pt, n, nt = (F.col(c) for c in ("_p", "_pt", "_n_", "_nt"))
    line = F.rint(p + (n - p) * (F.col("t") - pt) / (nt - pt))
    whole = F.coalesce(F.col(value).cast("double"), line, p, n)
    if online_after is not None:
        whole = F.when(F.col("_n") <= online_after, whole).otherwise(F.coalesce("_locf", p, n))
    return seen.withColumn(out, whole).drop("_p", "_pt", "_n_", "_nt", "_n", "_head", "_locf")


def tumbling(df: DataFrame, keys: Sequence[str], length: int, start: int = 0) -> DataFrame:
    """Adds ``block`` and ``k`` (1..length), the tumbling block of ``length`` epochs from ``start`` on and the position
    in it; incomplete blocks go."""
    t = F.col("t") - start
    dealt = df.where(F.col("t") >= start).select("*", F.floor(t / length).cast("int").alias("block"), (t % length + 1).cast("int").alias("k"))
    return dealt.select("*", F.count(F.lit(1)).over(Window.partitionBy(*keys, "block")).alias("_rows")).where(F.col("_rows") == length).drop("_rows")
