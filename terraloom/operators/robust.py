"""Outlier tests and distribution summaries."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from terraloom.operators import quantiles
from terraloom.sources.stores import kept


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by the modified Lentz method."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def t_tail(t: float, df: float) -> float:
    """Probability that Student's t with ``df`` degrees of freedom exceeds ``t`` >= 0."""
    x, a, b = df / (df + t * t), df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    whole = front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b
    return whole / 2


@lru_cache(maxsize=4096)
def grubbs_critical(n: int, alpha: float = 0.05) -> float:
    """Two-sided critical value of Grubbs' test for n values; infinite below 3."""
    if n < 3:
        return math.inf
    low, high, p = 0.0, 1e8, alpha / (2 * n)
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_tail(mid, n - 2) > p else (low, mid)
    t2 = high * high
    return (n - 1) / math.sqrt(n) * math.sqrt(t2 / (n - 2 + t2))


#: Distinct values at each end of a group that a round may take away; distinct values that a task holds before it condenses them.
ENDS, HELD = 256, 200_000


Moments = tuple[int, float, float]


def _moments(v: np.ndarray, n: np.ndarray) -> Moments:
    """Number, mean and sum of squared deviations of values with counts."""
    count = int(n.sum())
    if not count:
        return 0, 0.0, 0.0
    mean = float((v * n).sum() / count)
    return count, mean, float((n * (v - mean) ** 2).sum())


def _merged(a: Moments, b: Moments) -> Moments:
    n = a[0] + b[0]
    if not a[0] or not b[0]:
        return a if a[0] else b
    d = b[1] - a[1]
    return n, a[1] + d * b[0] / n, a[2] + b[2] + d * d * a[0] * b[0] / n


def shrunk(v: np.ndarray, n: np.ndarray, middle: Moments, critical: float, ddof: int = 0) -> tuple[float, float, float, float, bool]:
    """(low, high, mean, deviation, done) of what Grubbs' test leaves of values ``v`` (ascending, distinct, with counts ``n``) and of
    ``middle``, values that lie between both halves of ``v``. Those farthest from the mean go, all that are equally far at
    once, until the test statistic is no longer above ``critical``. What goes is always an end, so what stays is an
    interval; NaN where nothing stays. Not done: an end is used up before the middle is reached; all between ``low`` and
    ``high`` has to be looked at again."""
    lo, hi, half = 0, len(v) - 1, len(v) // 2
    while lo <= hi:
        if middle[0] and (lo >= half or hi < half):
            return float(np.nextafter(v[half - 1], np.inf)) if lo >= half else v[lo], float(np.nextafter(v[half], -np.inf)) if hi < half else v[hi], math.nan, math.nan, False
        count, mean, m2 = _merged(_moments(v[lo : hi + 1], n[lo : hi + 1]), middle)
        if count <= ddof:
            return v[lo], v[hi], mean, math.nan, True
        sd = math.sqrt(m2 / (count - ddof)) if v[lo] < v[hi] else 0.0
        below, above = mean - v[lo], v[hi] - mean
        if not sd or max(below, above) / sd <= critical:
            return v[lo], v[hi], mean, sd, True
        lo, hi = lo + (below >= above), hi - (above >= below)
    return math.nan, math.nan, math.nan, math.nan, True


def _condensed(groups: np.ndarray, v: np.ndarray, n: np.ndarray, ends: int) -> tuple[np.ndarray, ...]:
    """(group, value, count, squared deviations): of each group the ``ends`` least and greatest distinct values with their counts, and one
    row (its value their mean) for all values between. Rows come in as (group, value, count)."""
    order = np.lexsort((v, groups))
    groups, v, n = groups[order], v[order], n[order]
    new = np.flatnonzero(np.r_[True, (groups[1:] != groups[:-1]) | (v[1:] != v[:-1])]) if len(v) else np.empty(0, int)
    groups, v, n = groups[new], v[new], np.add.reduceat(n, new) if len(new) else n
    first = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(v) else np.empty(0, int)
    size = np.diff(np.r_[first, len(v)])
    rank = np.arange(len(v)) - np.repeat(first, size)
    between = (rank >= ends) & (rank < np.repeat(size, size) - ends)
    rows = [groups[~between], v[~between], n[~between], np.full(int((~between).sum()), -1.0)]
    if between.any():
        g, x, c = groups[between], v[between], n[between]
        start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        total = np.add.reduceat(c, start)
        mean = np.add.reduceat(x * c, start) / total
        spread = np.add.reduceat(c * (x - np.repeat(mean, np.diff(np.r_[start, len(x)]))) ** 2, start)
        rows = [np.concatenate(p) for p in zip(rows, (g[start], mean, total, spread), strict=True)]
    return tuple(rows)


def grubbs_bounds(df: DataFrame, keys: Sequence[str], value: str, alpha: float = 0.05, ddof: int = 0, ends: int = ENDS) -> DataFrame:
    """(keys, total, low, high, mean, sd): the interval that Grubbs' test leaves of each group's values, their mean and deviation; ``total`` is
    the number of values that the test began with, missing ones apart.

    A round is a grouped aggregate: map tasks condense each group to its extremes, ``ends`` distinct values at either side with
    their counts, and the number, mean and squared deviations of what is between; so a task that joins the parts of a group
    sees a bounded number of rows from each map task. It takes extremes away one after the other. Groups that use up an end,
    with more than ``ends`` outliers at one side, go into another round with narrower bounds; all others are done."""
    fields = [df.schema[k] for k in keys]
    partial = StructType([*fields, *StructType.fromDDL("_v double, _n long, _m double")])
    done_schema = StructType([*fields, *StructType.fromDDL("total long, low double, high double, mean double, sd double, done boolean")])

    def condense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def given() -> pa.RecordBatch:
            t = pa.concat_tables(held)
            names = list(keys)
            one = t.group_by([*names, "_v"]).aggregate([("_n", "sum")]).rename_columns([*names, "_v", "_n"])
            number = np.zeros(one.num_rows, np.int64)
            if names:
                code = [one.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy() for k in names]
                _, where, number = np.unique(np.stack(code), axis=1, return_index=True, return_inverse=True)
                number = number.ravel()
            else:
                where = np.zeros(1, np.int64)
            g, v, n, m = _condensed(number, one.column("_v").to_numpy(), one.column("_n").to_numpy(), ends)
            take = pa.array(where[g])
            return pa.RecordBatch.from_arrays([*(one.column(k).combine_chunks().take(take) for k in names), pa.array(v), pa.array(n.astype(np.int64)), pa.array(m)], names=partial.names)

        size = 0
        for b in batches:
            if b.num_rows:
                held.append(pa.Table.from_batches([b]).append_column("_n", pa.array(np.ones(b.num_rows, np.int64))))
                size += b.num_rows
                if size >= HELD:
                    yield given()
                    held, size = [], 0
        if held:
            yield given()

    def take_away(key: tuple, group: pa.Table) -> pa.Table:
        v, n, m = (group.column(c).to_numpy() for c in ("_v", "_n", "_m"))
        alone, middle = m < 0, (0, 0.0, 0.0)
        for i in np.flatnonzero(~alone):
            middle = _merged(middle, (int(n[i]), float(v[i]), float(m[i])))
        values, at = np.unique(v[alone], return_inverse=True)
        counts = np.bincount(at.ravel(), weights=n[alone], minlength=len(values)).astype(np.int64)
        if middle[0]:  # values that are extreme in their part only belong to the middle
            middle = _merged(middle, _moments(values[ends:-ends], counts[ends:-ends]))
            values, counts = np.r_[values[:ends], values[-ends:]], np.r_[counts[:ends], counts[-ends:]]
        total = group.column("_total")[0].as_py() or int(counts.sum()) + middle[0]
        found = shrunk(values, counts, middle, grubbs_critical(total, alpha), ddof)
        made = [pa.array([total], pa.int64()), *(pa.array([x], pa.float64(), from_pandas=True) for x in found[:4]), pa.array([found[4]])]
        return pa.table([*(pa.array([k.as_py()], k.type) for k in key), *made], names=done_schema.names)

    v = F.col(value).cast("double")
    rows = df.select(*keys, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") < float("inf")))
    begun = F.lit(None).cast("long").alias("_total")
    parts, out = rows.mapInArrow(condense, partial).select("*", begun), None
    while True:
        told = kept(parts.groupBy(*keys).applyInArrow(take_away, done_schema))
        settled = told.where("done").drop("done")
        out = settled if out is None else out.unionByName(settled)
        again = told.where("NOT done").select(*keys, "total", "low", "high")
        if again.isEmpty():
            return out
        inside = rows.join(again, list(keys)).where(F.col("_v").between(F.col("low"), F.col("high"))).select(*rows.columns) if keys else rows.crossJoin(F.broadcast(again)).where(F.col("_v").between(F.col("low"), F.col("high"))).select("_v")
        begun_with = again.select(*keys, F.col("total").alias("_total"))
        parts = inside.mapInArrow(condense, partial)
        parts = parts.join(begun_with, list(keys)) if keys else parts.crossJoin(F.broadcast(begun_with))


def grubbs(df: DataFrame, keys: Sequence[str], value: str, alpha: float = 0.05, ddof: int = 0) -> DataFrame:
    """Rows of ``df`` whose value Grubbs' test leaves in their group; missing values don't stay. Keys are not null."""
    bounds = grubbs_bounds(df, keys, value, alpha, ddof).select(*keys, F.col("low").alias("_low"), F.col("high").alias("_high"))
    return df.join(bounds, list(keys)).where(F.col(value).cast("double").between(F.col("_low"), F.col("_high"))).select(*df.columns)


def median_distance(df: DataFrame, keys: Sequence[str], value: str, limit: float = 2.0, out: str = "kept") -> DataFrame:
    """Adds ``out``, the value or NULL where its distance to the group's median is ``limit`` medians or more. With a median
    of 0 nothing changes."""
    middle, v = quantiles.medians(df, keys, value).select(*keys, F.col("middle").alias("_m")), F.col(value)
    return df.join(middle, list(keys)).withColumn(out, F.when((F.col("_m") == 0) | (F.abs(v - F.col("_m")) / F.col("_m") < limit), v)).drop("_m")


def moments(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, mean, sd, low, high) of the values of each group."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.min(value).alias("low"), F.max(value).alias("high"))


def describe(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return moments(df, keys, value).join(quantiles.medians(df, keys, value), list(keys)).select(*keys, "n", "mean", "sd", "low", "high", "middle")


def normal_pdf(x: Column, mean: Column, sd: Column) -> Column:
    return F.exp(-((x - mean) * (x - mean)) / (F.lit(2.0) * sd * sd)) / (sd * math.sqrt(2 * math.pi))


def histogram(df: DataFrame, value: str, bins: int = 45) -> DataFrame:
    """(bin, n): counts of equally wide bins from the least to the greatest value, which falls into the last."""
    ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    spot = F.least(F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1)).cast("int")
    return df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(spot.alias("bin")).agg(F.count("*").alias("n"))
