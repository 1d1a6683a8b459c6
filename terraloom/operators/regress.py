"""Straight-line regressions and their quality measures as grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lines(df: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """Per group: ordinary least squares (``ols_b0``, ``ols_b1``), orthogonal regression (``odr_b0``, ``odr_b1``), ``r`` and ``r2``, in one pass."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    s = both.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("sxx"), F.var_pop(y).alias("syy"), F.covar_pop(x, y).alias("sxy")
    )
    sxx, syy, sxy = F.col("sxx"), F.col("syy"), F.col("sxy")
    nz = lambda c: F.when(c != 0, c)
    s = s.withColumn("ols_b1", sxy / nz(sxx)).withColumn("odr_b1", (syy - sxx + F.sqrt((syy - sxx) * (syy - sxx) + F.lit(4.0) * sxy * sxy)) / nz(F.lit(2.0) * sxy))
    s = s.withColumn("r", sxy / nz(F.sqrt(sxx * syy)))
    return s.select(
        *keys, "n", (F.col("my") - F.col("ols_b1") * F.col("mx")).alias("ols_b0"), "ols_b1", (F.col("my") - F.col("odr_b1") * F.col("mx")).alias("odr_b0"), "odr_b1", "r", (F.col("r") * F.col("r")).alias("r2")
    )


def weighted_line(df: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y", p: str = "p") -> DataFrame:
    """Weighted least-squares line per group by the normal equations."""
    px, py, w = F.col(x), F.col(y), F.col(p)
    s = df.where(px.isNotNull() & py.isNotNull()).groupBy(*keys).agg(
        F.sum(w).alias("a11"), F.sum(w * px).alias("a12"), F.sum(w * px * px).alias("a22"), F.sum(w * py).alias("v0"), F.sum(w * px * py).alias("v1")
    )
    det = F.col("a11") * F.col("a22") - F.col("a12") * F.col("a12")
    det = F.when(det != 0, det)
    return s.select(*keys, ((F.col("a22") * F.col("v0") - F.col("a12") * F.col("v1")) / det).alias("b0"), ((F.col("a11") * F.col("v1") - F.col("a12") * F.col("v0")) / det).alias("b1"))


def residual_stats(df: DataFrame, coefficients: DataFrame, keys: Sequence[str], b0: str, b1: str, x: str = "x", y: str = "y") -> DataFrame:
    """Quality of rounded predictions b0 + b1 x per group: residual mean, mean square, variance (n - 2) and deviation, absolute and
    relative errors, variation coefficients, explained, error and total variance."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).join(coefficients.select(*keys, b0, b1), list(keys))
    means = rows.groupBy(*keys).agg(F.avg(y).alias("_my"))
    fit = F.rint(F.col(b0) + F.col(b1) * F.col(x))
    rows = rows.join(means, list(keys)).select(*keys, F.col(y).cast("double").alias("y"), fit.alias("f"), "_my")
    v = F.col("f") - F.col("y")
    n = F.count("*")
    return rows.groupBy(*keys).agg(
        n.alias("n"), F.avg(v).alias("res_mean"), (F.sum(v * v) / n).alias("mse"), (F.sum(v * v) / F.when(n > 2, n - 2)).alias("res_var"), F.sqrt(F.sum(v * v) / F.when(n > 2, n - 2)).alias("res_std"),
        F.avg(F.abs(v)).alias("mae"), F.avg(F.when(F.col("y") != 0, F.abs(v) / F.col("y"))).alias("mre"),
        (F.stddev_pop("f") / F.avg("f")).alias("cv_fit"), (F.stddev_pop("y") / F.avg("y")).alias("cv_obs"), F.stddev_pop("y").alias("std_obs"),
        (F.sum((F.col("f") - F.col("_my")) * (F.col("f") - F.col("_my"))) / n).alias("var_explained"), (F.sum(v * v) / n).alias("var_error"), F.var_pop("y").alias("var_total"),
    )


def orthogonal_stats(df: DataFrame, coefficients: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """Sums of squares of an orthogonal regression: along x (delta), along y (eps), both, and the residual variance."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).join(coefficients.select(*keys, "odr_b0", "odr_b1"), list(keys))
    r = F.col(y) - F.col("odr_b0") - F.col("odr_b1") * F.col(x)
    s = rows.groupBy(*keys, "odr_b1").agg(F.sum(r * r).alias("rr"), F.count("*").alias("n"))
    b2 = F.col("odr_b1") * F.col("odr_b1")
    whole = F.col("rr") / (F.lit(1.0) + b2)
    return s.select(*keys, (b2 * whole / (F.lit(1.0) + b2)).alias("sum_square_delta"), (whole / (F.lit(1.0) + b2)).alias("sum_square_eps"), whole.alias("sum_square"), (whole / F.when(F.col("n") > 2, F.col("n") - 2)).alias("res_var"))
