"""Scenes in UTM onto sinusoidal reference grids: corners, target grids and nearest values, block by block.

The formulas are written once for two kinds of numbers: Spark columns and numpy arrays.

A scene's outline is mapped to the reference projection and gives the target grid. Target cells are never rows on their own
before they have a value: source cells are packed into blocks of ``SOURCE_SIDE`` x ``SOURCE_SIDE``, the outline of each is mapped
to the target grid, and the cells of the box around it are mapped back as arrays of ``SIDE`` x ``SIDE`` at most. So the work is that of
the source cells and not of the target grid, most of which a long scene leaves empty; what is exchanged is a row per source
block, and no scene is in one task. Each block gives the target cells whose nearest source cell it holds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import product
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from terraloom.operators.spatial import block_of
from terraloom.schema import SPHERE_RADIUS
from terraloom.sources.stores import kept

#: Rows and columns of the target cells that are mapped at once, at most, and of a source block.
SIDE, SOURCE_SIDE = 256, 128

COLUMNS = SimpleNamespace(sin=F.sin, cos=F.cos, sinh=F.sinh, cosh=F.cosh, asin=F.asin, asinh=F.asinh, atanh=F.atanh, atan2=F.atan2, sqrt=F.sqrt)
ARRAYS = SimpleNamespace(sin=np.sin, cos=np.cos, sinh=np.sinh, cosh=np.cosh, asin=np.arcsin, asinh=np.arcsinh, atanh=np.arctanh, atan2=np.arctan2, sqrt=np.sqrt)

# The WGS 84 ellipsoid, the UTM scale, false easting and, in the south, northing.
_A, _F, K0, EAST, SOUTH = 6378137.0, 1 / 298.257223563, 0.9996, 500_000.0, 10_000_000.0
_N = _F / (2 - _F)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_E = 2 * math.sqrt(_N) / (1 + _N)
#: Coefficients of the Krueger series to the third order, forth and back.
_FORTH = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BACK = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_LATITUDE = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def meridian(zone):
    """Central meridian of a UTM zone in radians."""
    return (zone * 6 - 183) * (math.pi / 180)


def to_utm(lon, lat, zone, south=0, m: SimpleNamespace = COLUMNS):
    """(easting, northing) of longitude and latitude in radians; ``south`` is 1 on the southern half."""
    s = m.sin(lat)
    t = m.sinh(m.atanh(s) - m.atanh(s * _E) * _E)
    d = lon - meridian(zone)
    xi, eta = m.atan2(t, m.cos(d)), m.asinh(m.sin(d) / m.sqrt(t * t + m.cos(d) * m.cos(d)))
    north, east = xi, eta
    for j, c in enumerate(_FORTH, 1):
        east = east + m.cos(xi * (2 * j)) * m.sinh(eta * (2 * j)) * c
        north = north + m.sin(xi * (2 * j)) * m.cosh(eta * (2 * j)) * c
    return east * (K0 * _RADIUS) + EAST, north * (K0 * _RADIUS) + south * SOUTH


def from_utm(east, north, zone, south=0, m: SimpleNamespace = COLUMNS):
    """(longitude, latitude) in radians of easting and northing."""
    xi0, eta0 = (north - south * SOUTH) / (K0 * _RADIUS), (east - EAST) / (K0 * _RADIUS)
    xi, eta = xi0, eta0
    for j, c in enumerate(_BACK, 1):
        xi = xi - m.sin(xi0 * (2 * j)) * m.cosh(eta0 * (2 * j)) * c
        eta = eta - m.cos(xi0 * (2 * j)) * m.sinh(eta0 * (2 * j)) * c
    chi = m.asin(m.sin(xi) / m.cosh(eta))
    lat = chi
    for j, c in enumerate(_LATITUDE, 1):
        lat = lat + m.sin(chi * (2 * j)) * c
    return m.atan2(m.sinh(eta), m.cos(xi)) + meridian(zone), lat


def to_sinusoidal(lon, lat, m: SimpleNamespace = COLUMNS):
    return lon * m.cos(lat) * SPHERE_RADIUS, lat * SPHERE_RADIUS


def from_sinusoidal(x, y, m: SimpleNamespace = COLUMNS):
    lat = y / SPHERE_RADIUS
    return x / (m.cos(lat) * SPHERE_RADIUS), lat


# --- grids ------------------------------------------------------------------------------------------------


def outline(scenes: DataFrame, per_edge: int = 1) -> DataFrame:
    """(scene, x, y): points of each scene's outline in the reference projection, ``per_edge`` of them along every edge; with one these
    are the corners. ``scenes``: scene, zone, south, x0, y0 (upper-left corner), res, n_rows, n_cols."""
    at = F.explode(F.sequence(F.lit(0), F.lit(4 * per_edge - 1)))
    points = scenes.select("*", at.alias("_i")).withColumn("_s", (F.col("_i") % per_edge) / F.lit(per_edge))
    edge, s = F.floor(F.col("_i") / per_edge), F.col("_s")
    right = F.when(edge == 0, s).when(edge == 1, 1.0).when(edge == 2, F.lit(1.0) - s).otherwise(0.0)
    down = F.when(edge == 0, 0.0).when(edge == 1, s).when(edge == 2, 1.0).otherwise(F.lit(1.0) - s)
    placed = points.select("scene", "zone", "south", (F.col("x0") + right * F.col("n_cols") * F.col("res")).alias("_e"), (F.col("y0") - down * F.col("n_rows") * F.col("res")).alias("_n"))
    lon, lat = from_utm(F.col("_e"), F.col("_n"), F.col("zone"), F.col("south"))
    mapped = placed.select("scene", lon.alias("_lon"), lat.alias("_lat"))
    x, y = to_sinusoidal(F.col("_lon"), F.col("_lat"))
    return mapped.select("scene", x.alias("x"), y.alias("y"))


def target_grids(scenes: DataFrame, res: float, per_edge: int = 1) -> DataFrame:
    """(scene, t_x0, t_y0, t_rows, t_cols): the upper-left corner and size in cells of ``res`` of the box around each outline. The
    box of the corners alone (``per_edge`` 1) may cut off the bulge of an edge; more points per edge hold it."""
    count = lambda c: F.ceil((F.max(c) - F.min(c)) / F.lit(res)).cast("int")
    return outline(scenes, per_edge).groupBy("scene").agg(F.min("x").alias("t_x0"), F.max("y").alias("t_y0"), count("y").alias("t_rows"), count("x").alias("t_cols"))


# --- nearest values ---------------------------------------------------------------------------------------

_INFO = ("zone", "south", "x0", "y0", "res", "n_rows", "n_cols", "t_x0", "t_y0", "t_rows", "t_cols")


def _box(info: dict, res: float) -> tuple[int, int, int, int]:
    """First and last row and column (ends not included) of the target cells whose centres may lie in a source block: the box of its
    outline, mapped at every cell's corner, wider by a cell and the longest step along it, as the image may bulge between
    corners. Where the target grid goes once around the pole and more, columns repeat and all of them are in the box."""
    rows = np.arange(info["_si"] * SOURCE_SIDE, min((info["_si"] + 1) * SOURCE_SIDE, info["n_rows"]) + 1)
    cols = np.arange(info["_sj"] * SOURCE_SIDE, min((info["_sj"] + 1) * SOURCE_SIDE, info["n_cols"]) + 1)
    r = np.r_[np.full(len(cols), rows[0]), rows, np.full(len(cols), rows[-1]), rows[::-1]]
    c = np.r_[cols, np.full(len(rows), cols[-1]), cols[::-1], np.full(len(rows), cols[0])]
    lon, lat = from_utm(info["x0"] + c * info["res"], info["y0"] - r * info["res"], info["zone"], info["south"], ARRAYS)
    x, y = to_sinusoidal(lon, lat, ARRAYS)
    down, right = (info["t_y0"] - y) / res, (x - info["t_x0"]) / res
    more = 1 + max(np.abs(np.diff(down)).max(), np.abs(np.diff(right)).max())
    within = lambda v, n: (max(0, math.floor(v.min() - more)), min(n, math.ceil(v.max() + more) + 1))
    r0, r1 = within(down, info["t_rows"])
    ends = np.array([[info["t_x0"]], [info["t_x0"] + info["t_cols"] * res]])
    far = from_sinusoidal(ends, info["t_y0"] - np.array([r0, r1]) * res, ARRAYS)[0] - meridian(info["zone"])
    return r0, r1, *((0, info["t_cols"]) if np.abs(far).max() >= math.pi else within(right, info["t_cols"]))


def _mapped(info: dict, rows: np.ndarray, cols: np.ndarray, res: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Target rows and columns and the source rows and columns that their centres fall into, of those inside the source."""
    r, c = (x.ravel() for x in np.meshgrid(rows, cols, indexing="ij"))
    lon, lat = from_sinusoidal(info["t_x0"] + (c + 0.5) * res, info["t_y0"] - (r + 0.5) * res, ARRAYS)
    east, north = to_utm(lon, lat, info["zone"], info["south"], ARRAYS)
    sr, sc = np.floor((info["y0"] - north) / info["res"]).astype(np.int64), np.floor((east - info["x0"]) / info["res"]).astype(np.int64)
    inside = (sr >= 0) & (sr < info["n_rows"]) & (sc >= 0) & (sc < info["n_cols"])
    return r[inside], c[inside], sr[inside], sc[inside]


def on_grids(scenes: DataFrame, grids: DataFrame, cells: DataFrame, values: Sequence[str], res: float) -> DataFrame:
    """(scene, row, col, values): the nearest source values of all target cells that a scene covers. ``cells``: scene, row, col and
    ``values`` (bands, mask), which share one mapping. Cells without a row in ``cells`` have none in the result."""
    known = kept(scenes.join(grids, "scene").select("scene", *_INFO))
    spot = F.col("row") % SOURCE_SIDE * SOURCE_SIDE + F.col("col") % SOURCE_SIDE
    packed = cells.groupBy("scene", block_of(F.col("row"), SOURCE_SIDE).alias("_si"), block_of(F.col("col"), SOURCE_SIDE).alias("_sj")).agg(
        F.collect_list(F.struct(spot.cast("int").alias("_at"), *(F.col(v).cast("double").alias(v) for v in values))).alias("_cells")
    )
    made = StructType([known.schema["scene"], StructField("row", IntegerType()), StructField("col", IntegerType()), *(StructField(v, DoubleType()) for v in values)])
    # a block without a cell inside its scene has no value to give
    inside = (F.col("_si") >= 0) & (F.col("_si") * SOURCE_SIDE < F.col("n_rows")) & (F.col("_sj") >= 0) & (F.col("_sj") * SOURCE_SIDE < F.col("n_cols"))
    both = packed.join(known, "scene").where(inside)

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scene = b.column(b.schema.names.index("scene"))
            held = b.column(b.schema.names.index("_cells"))
            for i, info in enumerate(b.drop_columns(["_cells"]).to_pylist()):
                pieces = held[i].values
                at = pieces.field("_at").to_numpy()
                place = np.full(SOURCE_SIDE * SOURCE_SIDE, -1)
                place[at] = np.arange(len(at))
                r0, r1, c0, c1 = _box(info, res)
                for top, left in product(range(r0, r1, SIDE), range(c0, c1, SIDE)):
                    r, c, sr, sc = _mapped(info, np.arange(top, min(top + SIDE, r1)), np.arange(left, min(left + SIDE, c1)), res)
                    own = (sr // SOURCE_SIDE == info["_si"]) & (sc // SOURCE_SIDE == info["_sj"])
                    r, c, where = r[own], c[own], place[sr[own] % SOURCE_SIDE * SOURCE_SIDE + sc[own] % SOURCE_SIDE]
                    there = where >= 0
                    take = pa.array(where[there])
                    yield pa.RecordBatch.from_arrays(
                        [scene.take(pa.array(np.full(int(there.sum()), i))), pa.array(r[there].astype(np.int32)), pa.array(c[there].astype(np.int32)), *(pieces.field(v).take(take) for v in values)], names=made.names
                    )

    return both.mapInArrow(filled, made)


def grid_offset(t_x0: Column, t_y0: Column, ref_x0: float, ref_y0: float, res: float, size: int) -> tuple[Column, Column]:
    """(rows, cols) of ``res`` / ``size`` between a target grid's corner and the first corner of a reference cell of ``res`` inside it."""
    fine = res / size
    inside = lambda gap: F.rint((F.lit(res) - (gap - F.floor(gap / res) * res)) / fine).cast("int") % size
    return inside(F.lit(ref_y0) - t_y0), inside(t_x0 - ref_x0)
