"""Raster neighbourhoods, blocks, points, lines and projections in long form."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from terraloom.schema import SPHERE_RADIUS

#: Rows and columns of the squares in which neighbourhoods are computed.
SIDE = 64


def block_of(index: Column, size: int, offset: int = 0) -> Column:
    return F.floor((index - offset) / size).cast("int")


def block_mean(df: DataFrame, keys: Sequence[str], size: int, row0: int = 0, col0: int = 0, value: str = "value") -> DataFrame:
    """Mean of each ``size`` x ``size`` block, partial blocks at the edges too; blocks without values give 0."""
    return df.groupBy(*keys, block_of(F.col("row"), size, row0).alias("brow"), block_of(F.col("col"), size, col0).alias("bcol")).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"))


def block_cover(df: DataFrame, keys: Sequence[str], size: int, mask: str = "mask") -> DataFrame:
    """Cloud share, covered share and weight of each block; any noticeable cloud makes the weight 0."""
    n = F.count("*")
    shares = df.groupBy(*keys, block_of(F.col("row"), size).alias("brow"), block_of(F.col("col"), size).alias("bcol")).agg(
        (F.count_if(F.col(mask) == 2) / n).alias("cloud"), (F.count_if(F.col(mask) != 0) / n).alias("cover")
    )
    return shares.withColumn("p", F.when(F.col("cloud") >= 1e-5, 0.0).otherwise(F.abs(F.col("cloud") - F.col("cover"))))


def focal_mean(df: DataFrame, keys: Sequence[str], value: str = "value", out: str = "focal", reach: int = 1, whole: bool = False) -> DataFrame:
    """(keys, row, col, out): mean of the values around each cell of the raster, itself included; what is missing or outside
    doesn't count. ``whole`` cuts the means to whole numbers.

    Cells are dealt to squares of ``SIDE`` cells, those near an edge to the neighbouring squares too; each square is one matrix."""
    squares = lambda i: F.array_distinct(F.array(*(block_of(i + s, SIDE) for s in (-reach, 0, reach))))
    cells = df.select(*keys, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col(value).cast("double").alias("_v"), F.explode(squares(F.col("row"))).alias("_br"))
    dealt = cells.select("*", F.explode(squares(F.col("col"))).alias("_bc"))
    schema = StructType([*(df.schema[k] for k in keys), StructField("row", IntegerType()), StructField("col", IntegerType()), StructField(out, DoubleType())])

    def run(key: tuple, group: pa.Table) -> pa.Table:
        top, left = (key[len(keys) + i].as_py() * SIDE - reach for i in range(2))
        row, col, v = (group.column(c).to_numpy() for c in ("row", "col", "_v"))
        at, side = (row - top, col - left), SIDE + 2 * reach
        total, n, there = np.zeros((side, side)), np.zeros((side, side)), np.zeros((side, side), bool)
        known = np.isfinite(v)
        there[at] = True
        np.add.at(total, (at[0][known], at[1][known]), v[known])
        np.add.at(n, (at[0][known], at[1][known]), 1)
        shifts = [(slice(i, i + SIDE), slice(k, k + SIDE)) for i in range(2 * reach + 1) for k in range(2 * reach + 1)]
        with np.errstate(invalid="ignore"):
            mean = sum(total[s] for s in shifts) / sum(n[s] for s in shifts)
        mean = np.trunc(mean) if whole else mean
        r, c = np.nonzero(there[reach : reach + SIDE, reach : reach + SIDE])
        made = [pa.array((r + top + reach).astype(np.int32)), pa.array((c + left + reach).astype(np.int32)), pa.array(mean[r, c], from_pandas=True)]
        return pa.table([*(pa.array([k.as_py()] * len(r), k.type) for k in key[: len(keys)]), *made], names=schema.names)

    return dealt.groupBy(*keys, "_br", "_bc").applyInArrow(run, schema)


def cell_of(x: Column, y: Column, x0: Column, y0: Column, res: Column) -> tuple[Column, Column]:
    """(row, col) of a point on a north-up grid with upper-left corner (x0, y0)."""
    return F.floor((y0 - y) / res).cast("int"), F.floor((x - x0) / res).cast("int")


def extent(x0: Column, y0: Column, res: Column, n_rows: Column, n_cols: Column) -> dict[str, Column]:
    return {"x_min": x0, "x_max": x0 + n_cols * res, "y_min": y0 - n_rows * res, "y_max": y0}


def points_on_grid(points: DataFrame, grid: DataFrame, coarse: float) -> DataFrame:
    """Each point with the tile, row and col of every grid whose extent holds it. Grids and points meet in squares of side
    ``coarse`` (about a grid's own extent), so the join is by equality whatever the number of grids."""
    e = extent(*(F.col(c) for c in ("x0", "y0", "res", "n_rows", "n_cols")))
    square = lambda v: F.floor(v / coarse)
    spread = grid.select("*", F.explode(F.sequence(square(e["x_min"]), square(e["x_max"]))).alias("_sx")).select("*", F.explode(F.sequence(square(e["y_min"]), square(e["y_max"]))).alias("_sy"))
    placed = points.select("*", square(F.col("x")).alias("_sx"), square(F.col("y")).alias("_sy")).join(spread, ["_sx", "_sy"])
    inside = (F.col("x") >= e["x_min"]) & (F.col("x") < e["x_max"]) & (F.col("y") > e["y_min"]) & (F.col("y") <= e["y_max"])
    row, col = cell_of(*(F.col(c) for c in ("x", "y", "x0", "y0", "res")))
    return placed.where(inside).select(*points.columns, "tile", row.alias("row"), col.alias("col"))


def line_cells(lines: DataFrame, res: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """(fid, step, row, col): the cells that a line crosses, in its direction, sampled at every half cell, each cell
    once (at its first step)."""
    length = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))
    n = F.greatest(F.ceil(length / res * 2), F.lit(1)).cast("int")
    steps = lines.select("*", n.alias("n"), F.explode(F.sequence(F.lit(0), n)).alias("i"))
    share = F.col("i") / F.col("n")
    row, col = cell_of(F.col("x1") + (F.col("x2") - F.col("x1")) * share, F.col("y1") + (F.col("y2") - F.col("y1")) * share, F.lit(x0), F.lit(y0), F.lit(res))
    return steps.select("fid", F.col("i").alias("step"), row.alias("row"), col.alias("col")).groupBy("fid", "row", "col").agg(F.min("step").alias("step"))


def aligned_offsets(x0: Column, y0: Column, ref_x0: Column, ref_y0: Column, res: Column) -> tuple[Column, Column]:
    """Rows and columns by which a grid lies inside a reference grid of the same cells."""
    return F.round((ref_y0 - y0) / res).cast("int"), F.round((x0 - ref_x0) / res).cast("int")


# --- projections ------------------------------------------------------------------------------------------


def sinusoidal_inverse(x: Column, y: Column, radius: float = SPHERE_RADIUS) -> tuple[Column, Column]:
    """(longitude, latitude) in radians of a point of the sinusoidal projection on a sphere."""
    lat = y / radius
    return x / (radius * F.cos(lat)), lat


def sinusoidal(lon: Column, lat: Column, radius: float = SPHERE_RADIUS) -> tuple[Column, Column]:
    return lon * F.cos(lat) * radius, lat * radius


# The WGS 84 ellipsoid and the UTM scale.
_A, _F, _K0 = 6378137.0, 1 / 298.257223563, 0.9996


def utm(lon: Column, lat: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """(easting, northing) by the Krueger series to third order in the third flattening."""
    n = _F / (2 - _F)
    a = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    atanh = lambda v: F.lit(0.5) * F.log((F.lit(1.0) + v) / (F.lit(1.0) - v))
    s = F.sin(lat)
    t = F.sinh(atanh(s) - F.lit(e) * atanh(F.lit(e) * s))
    d = lon - math.radians(zone * 6 - 183)
    xi, eta = F.atan2(t, F.cos(d)), F.asinh(F.sin(d) / F.sqrt(t * t + F.cos(d) * F.cos(d)))
    east, north = eta, xi
    for j, al in enumerate(alpha, 1):
        east = east + F.lit(al) * F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j))
        north = north + F.lit(al) * F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j))
    return F.lit(500000.0) + F.lit(_K0 * a) * east, F.lit(_K0 * a) * north + (10_000_000.0 if south else 0.0)


def reproject_nearest(target: DataFrame, source: DataFrame, zone: int, x0: float, y0: float, res: float, keys: Sequence[str] = ()) -> DataFrame:
    """Values of a UTM raster ``source`` (row, col, value) at the centres of sinusoidal ``target`` cells (x, y): each target
    cell is mapped back and joined with the source cell it falls into."""
    lon, lat = sinusoidal_inverse(F.col("x"), F.col("y"))
    mapped = target.withColumn("_lon", lon).withColumn("_lat", lat)
    east, north = utm(F.col("_lon"), F.col("_lat"), zone)
    row, col = cell_of(east, north, F.lit(x0), F.lit(y0), F.lit(res))
    placed = mapped.select(*target.columns, row.alias("_row"), col.alias("_col"))
    s = source.select(*keys, F.col("row").alias("_row"), F.col("col").alias("_col"), "value")
    return placed.join(s, [*keys, "_row", "_col"], "left").select(*target.columns, "value")


def bounding_box(corners: DataFrame, keys: Sequence[str], res: float) -> DataFrame:
    """Upper-left corner and size in cells of the box around transformed corners (x, y)."""
    return corners.groupBy(*keys).agg(
        F.min("x").alias("x0"), F.max("y").alias("y0"), F.ceil((F.max("x") - F.min("x")) / res).cast("int").alias("n_cols"), F.ceil((F.max("y") - F.min("y")) / res).cast("int").alias("n_rows")
    )
