"""The fitting and calibration pipelines as compositions of operators. Each takes a dense series frame
(keys, t, value, qual) with fill values and returns the fitted series."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.operators import masks, regress, robust, series, spatial, spectral, temporal, window_fit
from terraloom.schema import EPOCHS_PER_YEAR, HALF, WEIGHTS
from terraloom.sources import stores

KEYS = ("px",)


def catalogue(spark: SparkSession) -> DataFrame:
    """product, weights, width, description: the fitted products as a small dimension table."""
    told = {
        "poly_lin": (2 * HALF + 1, "two weighted parabola passes, then interpolation"), "lin_poly": (2 * HALF + 1, "interpolation, then two parabola passes"), "sg_fft_poly": (2 * HALF + 1, "Fourier filter within the window, then two parabola passes"),
        "dft": (EPOCHS_PER_YEAR, "three weighted harmonics of a year"), "poly": (2 * HALF + 1, "four parabola passes between the window's extremes"), "fourier7": (EPOCHS_PER_YEAR, "seven weighted harmonics of a year"),
    }
    return spark.createDataFrame([(n, list(w), *told[n]) for n, w in WEIGHTS.items()], "product string, weights array<double>, width int, description string")


def masked(df: DataFrame, weights: Sequence[float], keys: Sequence[str] = KEYS, missing: float | None = None, recode: str = "simultaneous") -> DataFrame:
    """(keys, t, v, w): values and weights without fill."""
    return df.select(*keys, "t", masks.no_fill(F.col("value")).cast("double").alias("v"), masks.weight(F.col("qual"), weights, missing=missing, recode=recode).alias("w"))


def poly_lin(df: DataFrame, keys: Sequence[str] = KEYS, second: str = "raw") -> DataFrame:
    """two weighted parabola passes over sliding windows, then interpolation of what has no fit."""

    def run(v, w):
        return {"smooth": spectral.fill_rows(np.rint(window_fit.refit(window_fit.around(v), window_fit.around(w), second=second)[0][0]))}

    return window_fit.over_series(masked(df, WEIGHTS["poly_lin"], keys), keys, run, ["smooth"])


def lin_poly(df: DataFrame, keys: Sequence[str] = KEYS, online: bool = False) -> DataFrame:
    """interpolation first, two passes (the second on the fit), and the interpolated value where the fit is below 1."""

    def run(v, w):
        v = window_fit.filled_online(v, 2 * HALF + 1) if online else spectral.fill_rows(v)
        return {"filled": v[:, HALF:-HALF], "fit": window_fit.refit(window_fit.around(v), window_fit.around(w), second="fit")[0][0]}

    fit = window_fit.over_series(masked(df, WEIGHTS["lin_poly"], keys), keys, run, ["filled", "fit"])
    return fit.select(*keys, "t", "filled", "fit", masks.fit_or_interpolation(F.rint("fit"), F.col("filled")).alias("smooth"))


def sg_fft_poly(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Fourier filter within each window, then two weighted parabola passes over the filtered values."""

    def run(v, w):
        fit = window_fit.refit(window_fit.filtered(window_fit.around(v)), window_fit.around(w))[0][0]
        return {"fit": fit, "smooth": np.rint(fit)}

    return window_fit.over_series(masked(df, WEIGHTS["sg_fft_poly"], keys), keys, run, ["fit", "smooth"])


def fft_year(df: DataFrame, keys: Sequence[str] = KEYS, start: int = 0, rounded: bool = True) -> DataFrame:
    """Fourier filter of whole years."""
    blocks = series.tumbling(masked(df, WEIGHTS["poly_lin"], keys), keys, EPOCHS_PER_YEAR, start)
    out = spectral.fft_filter(spectral.to_blocks(blocks, [*keys, "block"]), rounded=rounded)
    return spectral.from_blocks(out, [*keys, "block"], "filtered")


def fft_window(df: DataFrame, keys: Sequence[str] = KEYS, passes: int = 1, rounded: bool = True) -> DataFrame:
    """centre of each window after one or two Fourier passes."""

    def run(v, w):
        return {"smooth": window_fit.filtered(window_fit.around(v), passes, rounded)[HALF]}

    return window_fit.over_series(masked(df, WEIGHTS["poly_lin"], keys), keys, run, ["smooth"])


def dft_year(df: DataFrame, keys: Sequence[str] = KEYS, harmonics: int = 3, weights: Sequence[float] = WEIGHTS["dft"], missing: float = 0.0, start: int = 0) -> DataFrame:
    """F07 (three harmonics) and F09 (seven): weighted harmonic fit of whole years; what can't be solved stays interpolated."""
    blocks = series.tumbling(masked(df, weights, keys, missing=missing), keys, EPOCHS_PER_YEAR, start)
    out = spectral.dft_fit(spectral.to_blocks(blocks, [*keys, "block"], weight="w"), harmonics)
    return spectral.from_blocks(out, [*keys, "block"], "fitted")


def poly(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """four parabola passes on the fit, a straight line where observations are few, and the window's extremes as bounds."""

    def run(v, w):
        vs, ws = window_fit.around(v), window_fit.around(w)
        low, high, few = window_fit.statistics(vs, ws)
        c, _, last = window_fit.refit(vs, ws, passes=4, second="fit")
        line = window_fit.coefficients(window_fit.fitted(c), last, degree=1)[0]
        return {"v_min": low, "v_max": high, "fit": np.where(few, line, c[0])}

    fit = window_fit.over_series(masked(df, WEIGHTS["poly"], keys), keys, run, ["v_min", "v_max", "fit"])
    return fit.select(*keys, "t", "v_min", "v_max", masks.between_extremes(F.rint("fit"), F.col("v_min"), F.col("v_max")).alias("smooth"))


def calibrate(pairs: DataFrame, keys: Sequence[str], alpha: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Grubbs' test on x, regressions, and calibrated values with their quality: (rows, statistics)."""
    kept = robust.grubbs(pairs.where(F.col("x").isNotNull() & F.col("y").isNotNull()), keys, "x", alpha)
    lines = regress.lines(kept, keys)
    rows = pairs.join(lines.select(*keys, "odr_b0", "odr_b1"), list(keys)).withColumn("calibrated", masks.calibrated_range(F.col("odr_b0") + F.col("odr_b1") * F.col("x")))
    stats = lines.join(regress.residual_stats(kept, lines, keys, "odr_b0", "odr_b1").drop("n"), list(keys))
    return rows.drop("odr_b0", "odr_b1"), stats


def calibration_lines(scenes: DataFrame, reference: DataFrame, size: int = 15, alpha: float = 0.05) -> DataFrame:
    """F10 from rasters to lines. ``scenes``: scene, acq_date, row, col, value, mask on the reference's grid ``size`` times
    finer (``spatial.reproject_nearest`` puts them there); ``reference``: epoch_date, brow, bcol, value, weight.

    Cells are masked and averaged to blocks with their cover; each scene meets the epoch nearest to its day, whose 3 x 3
    means stand against the blocks. Only blocks that are seen in full, with full weight and values on both sides, count;
    Grubbs' test takes outliers out; lines and their residuals' statistics follow."""
    cells = scenes.select("scene", "row", "col", masks.mask_out(F.col("value"), F.col("mask")).alias("value"))
    blocks = spatial.block_mean(cells, ("scene",), size).withColumnRenamed("mean", "x")
    cover = spatial.block_cover(scenes, ("scene",), size).select("scene", "brow", "bcol", masks.only_full_weight(F.col("p")).alias("p"))
    days = scenes.select("scene", "acq_date").distinct()
    near = stores.kept(temporal.nearest(days, reference.select("epoch_date").distinct(), "acq_date", "epoch_date").select("scene", F.col("nearest").alias("epoch_date")))
    needed = reference.join(near.select("epoch_date").distinct(), "epoch_date", "left_semi")
    cell = stores.kept(needed.select("epoch_date", F.col("brow").alias("row"), F.col("bcol").alias("col"), "value", "weight"))
    smooth = spatial.focal_mean(cell, ("epoch_date",)).join(cell.where("weight >= 1").select("epoch_date", "row", "col"), ["epoch_date", "row", "col"])
    smooth = smooth.select("epoch_date", F.col("row").alias("brow"), F.col("col").alias("bcol"), F.col("focal").alias("y"))
    pairs = blocks.join(cover, ["scene", "brow", "bcol"]).join(near, "scene").join(smooth, ["epoch_date", "brow", "bcol"])
    pairs = stores.kept(pairs.where((F.col("p") >= 1) & (F.col("x") > 0) & (F.col("y") > 0)).select("scene", F.rint("x").alias("x"), F.rint("y").alias("y")))
    kept = robust.grubbs(pairs, ("scene",), "x", alpha)
    lines = regress.lines(kept, ("scene",))
    return lines.join(regress.residual_stats(kept, lines, ("scene",), "odr_b0", "odr_b1").drop("n"), "scene")


def calibrated_scenes(scenes: DataFrame, lines: DataFrame) -> DataFrame:
    """``scenes`` with ``calibrated``, the values on the reference's scale; scenes without a line go."""
    known = scenes.join(lines.select("scene", "odr_b0", "odr_b1"), "scene")
    return known.withColumn("calibrated", masks.calibrated_range(F.col("odr_b0") + F.col("odr_b1") * masks.mask_out(F.col("value"), F.col("mask")))).drop("odr_b0", "odr_b1")


def distance_statistics(df: DataFrame, keys: Sequence[str], value: str, alpha: float = 0.003, bins: int = 45) -> DataFrame:
    """what Grubbs' test leaves of each group: its interval, number, mean, deviation, three-sigma bounds, the normal density at
    the mean and at the bounds, and ``bins`` counts of equally wide bins from ``low`` to ``high``."""
    bounds = robust.grubbs_bounds(df, keys, value, alpha, 1)
    kept = df.join(bounds, list(keys)).where(F.col(value).between(F.col("low"), F.col("high")))
    spot = F.least(F.floor((F.col(value) - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1)).cast("int")
    counted = kept.groupBy(*keys, F.coalesce(spot, F.lit(0)).alias("bin")).agg(F.count("*").alias("n"))
    listed = counted.groupBy(*keys).agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("by_bin"))
    every = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.element_at("by_bin", b), F.lit(0).cast("long")))
    mean, sd = F.col("mean"), F.col("sd")
    left, right = mean - F.lit(3.0) * sd, mean + F.lit(3.0) * sd
    return bounds.join(listed, list(keys)).select(
        *keys, "total", "n", "low", "high", "mean", "sd", left.alias("left"), right.alias("right"), robust.normal_pdf(mean, mean, sd).alias("density_mean"), robust.normal_pdf(right, mean, sd).alias("density_bound"), every.alias("bins")
    )
