"""Queries of rasters, points, lines and projections (A04-A07, A21, W08, J05, J06, J12, G) and of read-outs."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraloom.operators import masks, rasterise, series, spatial
from terraloom.plans import pipelines
from terraloom.plans.catalog import GRID, GRIDS, LINES, PLACED, POINTS, query, sql_fill, sql_series, sql_steps, steps
from terraloom.plans.scene_queries import sql_to_utm
from terraloom.schema import SPHERE_RADIUS, WEIGHTS
from terraloom.sources import shapes, stores, tables

RES, TOP = 10.0, 400.0


@query("a04_block_mean", f"WITH {GRID} SELECT CAST(row // 15 AS INTEGER) AS brow, CAST(col // 15 AS INTEGER) AS bcol, {sql_steps('coalesce(avg(CASE WHEN mask = 1 THEN value END), 0)')} AS mean FROM grid GROUP BY 1, 2")
def a04(spark, d):
    g = tables.part_grid(spark, d).select("row", "col", masks.mask_out(F.col("value"), F.col("mask")).alias("value"))
    return spatial.block_mean(g, (), 15).select("brow", "bcol", steps(F.col("mean")).alias("mean"))


@query(
    "a05_a06_a07_block_cover",
    f"""WITH {GRID}, s AS (SELECT row // 3 AS brow, col // 3 AS bcol, count(*) FILTER (mask = 2) / count(*) AS cloud, count(*) FILTER (mask <> 0) / count(*) AS cover FROM grid GROUP BY 1, 2)
        SELECT CAST(brow AS INTEGER) AS brow, CAST(bcol AS INTEGER) AS bcol, cloud, cover, CASE WHEN cloud >= 1e-5 THEN 0 ELSE abs(cloud - cover) END AS p FROM s""",
)
def a05(spark, d):
    return spatial.block_cover(tables.part_grid(spark, d), (), 3)


_FOCAL = "fc AS (SELECT a.row, a.col, avg(b.value) AS focal FROM grid a JOIN grid b ON b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY a.row, a.col)"


@query("w08_focal_mean", f"WITH {GRID}, {_FOCAL} SELECT row, col, {sql_steps('focal')} AS focal, CAST(floor(focal) AS BIGINT) AS whole FROM fc")
def w08(spark, d):
    g = tables.part_grid(spark, d)
    whole = spatial.focal_mean(g, (), out="whole", whole=True)
    return spatial.focal_mean(g, ()).join(whole, ["row", "col"]).select("row", "col", steps(F.col("focal")).alias("focal"), F.col("whole").cast("long").alias("whole"))


@query(
    "a21_focal_block_mean",
    f"WITH {GRID}, {_FOCAL} SELECT CAST(row // 15 AS INTEGER) AS brow, CAST(col // 15 AS INTEGER) AS bcol, {sql_steps('coalesce(avg(CASE WHEN focal > 0.001 THEN focal END), 0)')} AS mean FROM fc GROUP BY 1, 2",
)
def a21(spark, d):
    f = spatial.focal_mean(tables.part_grid(spark, d), ()).withColumn("focal", F.when(F.col("focal") > 0.001, F.col("focal")))
    return spatial.block_mean(f, (), 15, value="focal").select("brow", "bcol", steps(F.col("mean")).alias("mean"))


@query("j05_p16_points_on_grid", f"WITH {POINTS}, {GRIDS}, {PLACED} SELECT * FROM pl")
def j05(spark, d):
    return spatial.points_on_grid(tables.points(spark, d), tables.grids(spark, d), 2000.0)


@query("s03_g04_grid_extents", f"WITH {GRIDS} SELECT tile, x0 AS x_min, x0 + n_cols * res AS x_max, y0 - n_rows * res AS y_min, y0 AS y_max FROM til")
def g04(spark, d):
    e = spatial.extent(*(F.col(c) for c in ("x0", "y0", "res", "n_rows", "n_cols")))
    return tables.grids(spark, d).select("tile", *(c.alias(n) for n, c in e.items()))


@query(
    "j06_g03_aligned_rasters",
    f"""WITH {GRIDS}, {GRID}, o AS (SELECT tile, CAST(round((10000.0 - y0) / res) AS INTEGER) AS drow, CAST(round((x0 - 0.0) / res) AS INTEGER) AS dcol FROM til)
        SELECT tile, row AS scene_row, col AS scene_col, CAST(row + drow AS INTEGER) AS row, CAST(col + dcol AS INTEGER) AS col, value FROM grid, o""",
)
def j06(spark, d):
    drow, dcol = spatial.aligned_offsets(F.col("x0"), F.col("y0"), F.lit(0.0), F.lit(10000.0), F.col("res"))
    scene = tables.part_grid(spark, d).select(F.col("row").alias("scene_row"), F.col("col").alias("scene_col"), "value")
    rows = scene.agg(F.min("scene_row").alias("lo"), F.max("scene_row").alias("hi"))  # one row
    offsets = tables.grids(spark, d).select("tile", drow.alias("drow"), dcol.alias("dcol")).crossJoin(F.broadcast(rows)).select("tile", "drow", "dcol", F.explode(F.sequence("lo", "hi")).alias("scene_row"))
    return scene.join(offsets, "scene_row").select("tile", "scene_row", "scene_col", (F.col("scene_row") + F.col("drow")).alias("row"), (F.col("scene_col") + F.col("dcol")).alias("col"), "value")


@query(
    "j06b_g03_tiles_under_raster",
    f"""WITH {GRIDS}, {GRID}, o AS (SELECT tile, n_rows, n_cols, CAST(round((10000.0 - y0) / res) AS INTEGER) AS drow, CAST(round((x0 - 0.0) / res) AS INTEGER) AS dcol FROM til)
        SELECT tile, CAST(row - drow AS INTEGER) AS tile_row, CAST(col - dcol AS INTEGER) AS tile_col, row, col, value
        FROM grid JOIN o ON row - drow BETWEEN 0 AND n_rows - 1 AND col - dcol BETWEEN 0 AND n_cols - 1""",
)
def j06b(spark, d):
    """Every cell of the raster with the tile's cell that lies under it."""
    drow, dcol = spatial.aligned_offsets(F.col("x0"), F.col("y0"), F.lit(0.0), F.lit(10000.0), F.col("res"))
    tiles = tables.grids(spark, d).select("tile", "n_cols", drow.alias("drow"), dcol.alias("dcol"), F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("tile_row"))
    cells = tiles.select("tile", "drow", "dcol", "tile_row", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)).alias("tile_col"))
    shifted = cells.select("tile", "tile_row", "tile_col", (F.col("tile_row") + F.col("drow")).alias("row"), (F.col("tile_col") + F.col("dcol")).alias("col"))
    return tables.part_grid(spark, d).select("row", "col", "value").join(shifted, ["row", "col"]).select("tile", "tile_row", "tile_col", "row", "col", "value")


@query(
    "g02_bounding_box",
    f"WITH {POINTS}, {GRIDS}, {PLACED} SELECT tile, min(x) AS x0, max(y) AS y0, CAST(ceil((max(x) - min(x)) / 50.0::DOUBLE) AS INTEGER) AS n_cols, CAST(ceil((max(y) - min(y)) / 50.0::DOUBLE) AS INTEGER) AS n_rows FROM pl GROUP BY tile",
)
def g02(spark, d):
    return spatial.bounding_box(j05(spark, d), ("tile",), 50.0)


@query(
    "g01_reproject_nearest",
    f"""WITH {GRID}, tg AS (SELECT p_partkey AS id, CAST(669750 + p_partkey % 60 * 30 AS DOUBLE) AS x, CAST(5337600 - p_partkey // 60 * 30 AS DOUBLE) AS y, 32 AS zone, 0 AS south FROM part),
        tl AS (SELECT *, y / {SPHERE_RADIUS}::DOUBLE AS lat FROM tg), tm AS (SELECT *, x / ({SPHERE_RADIUS}::DOUBLE * cos(lat)) AS lon FROM tl), {sql_to_utm('lon', 'lat', 'tm', 'u', 'id, x, y')}
        SELECT id, x, y, value FROM u LEFT JOIN grid ON row = CAST(floor((5316700.0::DOUBLE - north) / 30.0::DOUBLE) AS INTEGER) AND col = CAST(floor((east - 500000.0::DOUBLE) / 30.0::DOUBLE) AS INTEGER)""",
)
def g01(spark, d):
    """Sinusoidal cells around 9 degrees east, 48 north, each with the UTM cell that it falls into; the parts' raster is the scene."""
    scene = tables.part_grid(spark, d).select("row", "col", "value")
    k, y0 = F.col("p_partkey"), 5_337_600.0
    target = tables.read(spark, d, "part").select(k.alias("id"), (669_750.0 + k % 60 * 30).alias("x"), (F.lit(y0) - F.floor(k / 60) * 30).alias("y"))
    return spatial.reproject_nearest(target, scene, 32, 500_000.0, 5_316_700.0, 30.0)


@query("j12_o06_line_cells", f"WITH {LINES} SELECT fid, CAST(step AS INTEGER) AS step, row, col FROM lcl")
def j12(spark, d):
    return spatial.line_cells(tables.lines(spark, d), RES, 0.0, TOP).select("fid", "step", "row", "col")


@query(
    "j12b_rasterised_lines",
    f"""WITH {LINES}, i AS (SELECT fid, CAST(x1 AS BIGINT) AS u, CAST({TOP} - y1 AS BIGINT) AS v, CAST(x2 - x1 AS BIGINT) AS du, CAST(y1 - y2 AS BIGINT) AS dv FROM lin),
        c AS (SELECT *, unnest(generate_series(least(u, u + du) // 10 - 1, greatest(u, u + du) // 10 + 1)) AS col FROM (SELECT *, unnest(generate_series(least(v, v + dv) // 10 - 1, greatest(v, v + dv) // 10 + 1)) AS row FROM i)),
        s AS (SELECT *, greatest(abs(du), 1) AS lu, greatest(abs(dv), 1) AS lv FROM c WHERE (du <> 0 OR u BETWEEN 10 * col AND 10 * col + 9) AND (dv <> 0 OR v BETWEEN 10 * row AND 10 * row + 9)),
        t AS (SELECT fid, row, col, list_sort([struct_pack(t := CAST(0 AS BIGINT), o := 0)] || CASE WHEN du > 0 THEN [struct_pack(t := (10 * col - u) * lv, o := 0)] WHEN du < 0 THEN [struct_pack(t := (u - 10 * col - 10) * lv, o := 1)] ELSE [] END
                || CASE WHEN dv > 0 THEN [struct_pack(t := (10 * row - v) * lu, o := 0)] WHEN dv < 0 THEN [struct_pack(t := (v - 10 * row - 10) * lu, o := 1)] ELSE [] END)[-1] AS lo,
            list_sort([struct_pack(t := lu * lv, o := 1)] || CASE WHEN du > 0 THEN [struct_pack(t := (10 * col + 10 - u) * lv, o := 0)] WHEN du < 0 THEN [struct_pack(t := (u - 10 * col) * lv, o := 1)] ELSE [] END
                || CASE WHEN dv > 0 THEN [struct_pack(t := (10 * row + 10 - v) * lu, o := 0)] WHEN dv < 0 THEN [struct_pack(t := (v - 10 * row) * lu, o := 1)] ELSE [] END)[1] AS hi FROM s)
        SELECT fid, CAST(row_number() OVER (PARTITION BY fid ORDER BY lo.t, hi.t) - 1 AS INTEGER) AS step, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col FROM t WHERE lo.t < hi.t OR lo.t = hi.t AND lo.o = 0 AND hi.o = 1""",
)
def j12b(spark, d):
    """Every cell that a line has a point in, those that it only cuts at a corner too."""
    return rasterise.line_cells(tables.lines(spark, d), RES, 0.0, TOP)


#: A box over the points of interest.
_BOX = (-500.0, 1000.0, 4500.0, 7000.0)


@query("s06_shape_points", f"WITH {POINTS} SELECT fid, x, y FROM poi WHERE x BETWEEN {_BOX[0]} AND {_BOX[2]} AND y BETWEEN {_BOX[1]} AND {_BOX[3]}")
def s06(spark, d):
    """The points of interest as shape files, those in a box read back in parts of 500 records."""
    path = stores.scratch(spark)
    shapes.write(tables.points(spark, d).select(F.col("fid").alias("id"), F.array(F.struct("x", "y")).alias("points")), path)
    return shapes.read(spark, path, _BOX, records=500).select(F.col("id").alias("fid"), F.col("points")[0]["x"].alias("x"), F.col("points")[0]["y"].alias("y"))


@query("s06b_shape_lines", f"WITH {LINES} SELECT fid, x1, y1, x2, y2 FROM lin")
def s06b(spark, d):
    """The transects as shape files, read back by their end points."""
    path = stores.scratch(spark)
    end = lambda k: F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y"))
    shapes.write(tables.lines(spark, d).select(F.col("fid").alias("id"), F.array(end(1), end(2)).alias("points")), path)
    a, b = F.col("points")[0], F.element_at("points", -1)
    return shapes.read(spark, path, records=7).select(F.col("id").alias("fid"), a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))


@query(
    "f14_s14_transect_profile",
    f"""WITH {LINES}, {GRID} SELECT fid, CAST(row_number() OVER (PARTITION BY fid ORDER BY step) AS INTEGER) AS place, CASE WHEN value > 0 AND mask = 1 THEN value ELSE 0 END AS value
        FROM lcl JOIN grid USING (row, col)""",
)
def f14(spark, d):
    from pyspark.sql import Window

    cells = spatial.line_cells(tables.lines(spark, d), RES, 0.0, TOP).join(tables.part_grid(spark, d), ["row", "col"])
    place = F.row_number().over(Window.partitionBy("fid").orderBy("step"))
    return cells.select("fid", place.alias("place"), F.when((F.col("value") > 0) & (F.col("mask") == 1), F.col("value")).otherwise(0.0).alias("value"))


@query(
    "j05b_poi_series",
    f"""WITH {sql_series(WEIGHTS['poly'])}, {POINTS}, {GRIDS}, {PLACED}, s AS (SELECT px, count(*) AS n, sum(v) AS total, min(t) AS first_t FROM sv WHERE v IS NOT NULL GROUP BY px)
        SELECT fid, n, total, first_t FROM pl JOIN s ON px = row * 40 + col""",
)
def j05b(spark, d):
    """The series under each point: cells of the pixels that have points, as one array each."""
    at = tables.points_with_pixels(spark, d)
    s = pipelines.masked(tables.supplier_series(spark, d), WEIGHTS["poly"]).where("v is not null").join(at.select("px").distinct(), "px", "left_semi")
    held = s.groupBy("px").agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("cells"))
    told = held.select("px", F.size("cells").cast("long").alias("n"), F.aggregate("cells", F.lit(0.0), lambda a, c: a + c["v"]).alias("total"), F.col("cells")[0]["t"].alias("first_t"))
    return at.join(told, "px").select("fid", "n", "total", "first_t")


@query(
    "f12_poi_comparison",
    f"""WITH {sql_series(WEIGHTS['poly'])}, {POINTS}, {GRIDS}, {PLACED}, {sql_fill('sv', 'fl')}
        SELECT fid, 1995 + t // 46 AS year, t % 46 AS place, coalesce(v, 0) AS raw, filled AS interpolated FROM pl JOIN fl ON px = row * 40 + col""",
)
def f12(spark, d):
    """Points on grids, the series of the pixels that they are in, cut into years, raw and interpolated."""
    at = tables.points_with_pixels(spark, d)
    s = pipelines.masked(tables.supplier_series(spark, d), WEIGHTS["poly"]).join(at.select("px").distinct(), "px", "left_semi")
    whole = at.join(series.interpolate(s, ("px",)), "px")
    return whole.select("fid", (F.floor(F.col("t") / 46) + 1995).cast("int").alias("year"), (F.col("t") % 46).alias("place"), F.coalesce("v", F.lit(0.0)).alias("raw"), F.col("filled").alias("interpolated"))
