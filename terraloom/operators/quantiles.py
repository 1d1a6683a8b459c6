"""Exact medians of groups of any size: selection by histograms that are refined around the middle.

Groups of up to ``SMALL`` values are sorted where they are. Of a larger one every round counts the values between two bounds in
``BINS`` bins, with the least and the greatest value of each, aggregated in the map tasks; the bin that holds the middle gives
the next bounds, values that occur in it, until it is small or has one value only. A task holds bins, never a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.sources.stores import kept

SMALL, BINS = 10_000, 1024
#: Groups whose bounds are broadcast at most.
BROADCAST_GROUPS = 50_000


def medians(df: DataFrame, keys: Sequence[str], value: str, small: int = SMALL, bins: int = BINS) -> DataFrame:
    """(keys, n, middle): number of the values that are neither null nor NaN and their median, NULL without any. Keys may be null."""
    v = F.col(value).cast("double")
    rows = df.select(*keys, F.when(~F.isnan(v), v).alias("_v"))
    sizes = kept(rows.groupBy(*keys).agg(F.count("_v").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    large = sizes.where(F.col("n") > small)
    if large.isEmpty():
        return rows.groupBy(*keys).agg(F.count("_v").alias("n"), F.median("_v").alias("middle"))
    state = large.select(*keys, "n", "_lo", "_hi", F.floor((F.col("n") - 1) / 2).alias("_first"), (F.col("n") % 2 == 0).alias("_two"), F.lit(0).cast("long").alias("_below"), F.col("n").alias("_inside"))
    found = []
    while True:
        state = kept(state)
        found.append(state.where("_lo = _hi").select(*keys, "n", F.col("_lo").alias("middle")))
        found.append(_sorted(rows, state.where(f"_lo < _hi AND _inside <= {small}"), keys))
        state = state.where(f"_lo < _hi AND _inside > {small}")
        if state.isEmpty():
            break
        told = _refined(rows, state, keys, bins)
        found.append(told.where("_upper IS NOT NULL").select(*keys, "n", ((F.col("_hi") + F.col("_upper")) / 2).alias("middle")))
        state = told.where("_upper IS NULL").drop("_upper")
    whole = sizes.where(F.col("n") <= small).select(*keys, "n")
    out = _within(rows, whole, keys).groupBy(*keys, "n").agg(F.median("_v").alias("middle"))
    for part in found:
        out = out.unionByName(part)
    return out


def _within(rows: DataFrame, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with their group's columns of ``state``. Few groups are broadcast; of many none can be much of the whole but for skew,
    which adaptive joins split."""
    if not keys:
        return rows.crossJoin(F.broadcast(state))  # one row
    held = state.limit(BROADCAST_GROUPS + 1).count()
    named = state.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(c for c in state.columns if c not in keys))
    same = None
    for i, k in enumerate(keys):
        one = rows[k].eqNullSafe(F.col(f"_k{i}"))
        same = one if same is None else same & one
    joined = rows.join(F.broadcast(named) if held <= BROADCAST_GROUPS else named, same)
    return joined.drop(*(f"_k{i}" for i in range(len(keys))))


def _sorted(rows: DataFrame, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Medians of groups with few values between their bounds."""
    inside = _within(rows, state, keys).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
    lists = inside.groupBy(*keys, "n", "_first", "_two", "_below").agg(F.array_sort(F.collect_list("_v")).alias("_all"))
    at = (F.col("_first") - F.col("_below")).cast("int")
    return lists.select(*keys, "n", F.when(F.col("_two"), (F.col("_all")[at] + F.col("_all")[at + 1]) / 2).otherwise(F.col("_all")[at]).alias("middle"))


def _magnitude(v: Column) -> Column:
    """Orders doubles as they are, by their logarithms, so that ranges over many powers shrink as fast as others."""
    return F.when(v > 0, F.log(v) + 800).when(v < 0, -(F.log(-v) + 800)).otherwise(0.0)


def _refined(rows: DataFrame, state: DataFrame, keys: Sequence[str], bins: int) -> DataFrame:
    """``state`` narrowed to the bin that holds the middle; ``_upper``: the least value above it where the middle lies between both."""
    inside = _within(rows, state, keys).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
    v, lo, hi = (F.col(c) for c in ("_v", "_lo", "_hi"))
    share = lambda of: F.least(F.floor((of(v) / 2 - of(lo) / 2) / (of(hi) / 2 - of(lo) / 2) * bins), F.lit(bins - 1)).cast("int")  # noqa: E731  (halves, as the span of two doubles may be none)
    wide = (lo <= 0) & (hi >= 0) | (F.abs(hi) / bins > F.abs(lo)) | (F.abs(lo) / bins > F.abs(hi))
    spot = F.when(wide, share(_magnitude)).otherwise(share(lambda x: x))
    counted = inside.groupBy(*keys, "n", "_first", "_two", "_below", spot.alias("_bin")).agg(F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    order = Window.partitionBy(*keys).orderBy("_bin")
    placed = counted.select("*", F.lead("_lo").over(order).alias("_next"), (F.col("_below") + F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).alias("_upto"))
    chosen = placed.where((F.col("_first") < F.col("_upto")) & (F.col("_first") >= F.col("_upto") - F.col("_c")))
    split = F.col("_two") & (F.col("_first") == F.col("_upto") - 1)
    return chosen.select(*keys, "n", "_lo", "_hi", "_first", "_two", (F.col("_upto") - F.col("_c")).alias("_below"), F.col("_c").alias("_inside"), F.when(split, F.col("_next")).alias("_upper"))
