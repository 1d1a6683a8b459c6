"""Masking, weighting, clamping and rounding as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from terraloom.schema import DATA_FILL, QUALITY_FILL, VALID_HIGH, VALID_LOW


def no_fill(value: Column, fill: int = DATA_FILL) -> Column:
    """The value, or NULL where it is the fill value."""
    return F.when(value != fill, value)


def weight(qual: Column, weights: Sequence[float], missing: float | None = None, recode: str = "simultaneous", keep_code4: bool = False) -> Column:
    """Weight of a quality code. ``recode='chained'`` replaces codes one after another, so that a weight equal to a
    later code is replaced again. Fill becomes ``missing``; code 4, which means fill as well, too unless kept."""
    if recode == "chained":
        w = qual.cast("double")
        for code, to in enumerate(weights):
            w = F.when(w == float(code), F.lit(float(to))).otherwise(w)
    else:
        w = qual.cast("double")
        for code, to in reversed([*enumerate(weights)]):
            w = F.when(qual == code, F.lit(float(to))).otherwise(w)
    none = F.lit(missing).cast("double")
    w = F.when(qual == QUALITY_FILL, none).otherwise(w)
    return w if keep_code4 else F.when(qual == 4, none).otherwise(w)


def valid_or_fill(value: Column) -> Column:
    """Fitted values outside the valid domain, and missing ones, become the fill value."""
    return F.coalesce(F.when((value >= VALID_LOW) & (value <= VALID_HIGH), F.rint(value)), F.lit(float(DATA_FILL))).cast("int")


def floored(value: Column) -> Column:
    """Negative values become 0; there is no upper bound; missing ones become the fill value."""
    return F.when(value.isNull(), DATA_FILL).otherwise(F.rint(F.greatest(value, F.lit(0.0))).cast("int"))


def between_extremes(fit: Column, low: Column, high: Column) -> Column:
    return F.when(fit > high, high).when(fit < low, low).otherwise(fit)


def calibrated_range(value: Column) -> Column:
    """Calibrated full-resolution values: missing to 0, then into 0..10000."""
    return F.coalesce(F.least(F.greatest(F.rint(value), F.lit(0.0)), F.lit(10000.0)), F.lit(0.0)).cast("int")


def calibrated_block(value: Column) -> Column:
    """Calibrated block values: not below 0, 16 bits."""
    return F.least(F.rint(F.greatest(value, F.lit(0.0))), F.lit(32767.0)).cast("int")


def extracted(value: Column) -> Column:
    """Values read out at points: nothing outside 1..9999."""
    return F.when((value > 0) & (value < 10000), value).otherwise(0)


def mask_out(value: Column, mask: Column, no_data: int = 0, cloud: int = 2) -> Column:
    """NULL under clouds, outside the scene and where the scene has no data."""
    return F.when((mask != cloud) & (mask != no_data) & (value != 0), value)


def quality_mismatch(value: Column, qual: Column) -> Column:
    """True where the quality is set but the data are missing."""
    return (value == DATA_FILL) & (qual != QUALITY_FILL)


def fit_or_interpolation(fit: Column, interpolated: Column) -> Column:
    return F.when(F.coalesce(fit, F.lit(0.0)) < 1, interpolated).otherwise(fit)


def only_full_weight(p: Column) -> Column:
    return F.when(p < 1, 0.0).otherwise(p)


def plot_level(qual: Column) -> Column:
    """Height at which charts draw a quality code."""
    levels = {0: 3.0, 1: 2.0, 2: 1.0, 3: 0.5, 4: 0.1}
    out = F.lit(0.0)
    for code, level in levels.items():
        out = F.when(qual == code, F.lit(level)).otherwise(out)
    return out * 100


def to_int16(value: Column, missing: int = 0) -> Column:
    """Half-even rounding into 16 bits; never an unchecked cast."""
    return F.coalesce(F.least(F.greatest(F.rint(value), F.lit(-32768.0)), F.lit(32767.0)), F.lit(float(missing))).cast("int")
