"""Scenes whose target grids are far larger than themselves: work goes by the scenes' cells, not by the grids'."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.operators import projections
from terraloom.plans import calibration, scene_queries
from terraloom.plans.mask_queries import band_map

RES = 30.88751


@pytest.mark.parametrize("zone, south, y0", [(32, 0, 5_330_000.25), (60, 0, 7_900_000.0), (1, 1, 2_000_000.0)])
def test_boxes_of_blocks_hold_all_their_cells_and_little_else(spark, zone, south, y0):
    info = {"zone": zone, "south": south, "x0": 320_000.25, "y0": y0, "res": 30.0, "n_rows": 3000, "n_cols": 50}
    scenes = spark.createDataFrame([("s", *info.values())], "scene string, zone int, south int, x0 double, y0 double, res double, n_rows int, n_cols int")
    info |= projections.target_grids(scenes, RES).first().asDict()
    blocks, area = {}, 0
    for i in range(-(-info["n_rows"] // projections.SOURCE_SIDE)):
        blocks[i] = projections._box(info | {"_si": i, "_sj": 0}, RES)
        r0, r1, c0, c1 = blocks[i]
        area += (r1 - r0) * (c1 - c0)
    n = 0
    for top in range(0, info["t_rows"], 500):
        r, c, sr, _ = projections._mapped(info, np.arange(top, min(top + 500, info["t_rows"])), np.arange(info["t_cols"]), RES)
        n += len(r)
        for i in np.unique(sr // projections.SOURCE_SIDE):
            mine = sr // projections.SOURCE_SIDE == i
            r0, r1, c0, c1 = blocks[i]
            assert r[mine].min() >= r0 and r[mine].max() < r1 and c[mine].min() >= c0 and c[mine].max() < c1
    assert n > 50_000 and area < info["t_rows"] * info["t_cols"]
    if zone == 32:
        assert area < 3 * n


def test_columns_that_repeat_around_the_pole_are_all_looked_at():
    info = {"zone": 31, "south": 0, "x0": 500_000.0, "y0": 9_990_000.0, "res": 30.0, "n_rows": 10, "n_cols": 10, "t_x0": -1_000_000.0, "t_y0": 10_007_000.0, "t_rows": 3000, "t_cols": 65_000, "_si": 0, "_sj": 0}
    assert projections._box(info, RES)[2:] == (0, 65_000)


def test_target_grids_are_not_exploded(spark):
    scenes = spark.createDataFrame([("s", 32, 0, 512_345.5, 5_330_000.25, 30.0, 9000, 3)], "scene string, zone int, south int, x0 double, y0 double, res double, n_rows int, n_cols int")
    cells = spark.range(27_000).select(F.lit("s").alias("scene"), F.floor(F.col("id") / 3).cast("int").alias("row"), (F.col("id") % 3).cast("int").alias("col"), F.col("id").alias("band"))
    out = projections.on_grids(scenes, projections.target_grids(scenes, RES), cells, ("band",), RES)
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() > 24_000


def test_pixels_of_a_boxs_rim_are_those_of_all_its_cells(spark):
    for row0, row1, col0, col1 in ((5, 9, 3, 90), (0, 120, 7, 8), (-3, 60, -20, 50), (2, 2, 1, 1)):
        boxes = spark.createDataFrame([(row0, row1, col0, col1)], "row0 int, row1 int, col0 int, col1 int")
        got = {(r * 31 + c * 7) % 10_007 for r, c in scene_queries._rim(boxes).collect()}
        assert got == {(r * 31 + c * 7) % 10_007 for r in range(row0, row1 + 1) for c in range(col0, col1 + 1)}


def test_a_reference_is_asked_for_blocks_and_neighbours_only(spark, sf_dir):
    scenes, cells, reference = scene_queries._calibrated_scenes(spark, sf_dir)
    asked = []
    told = calibration.pairs(scenes, cells, scene_queries.BANDS, band_map(spark), reference._replace(at=lambda x: asked.append(x) or reference.at(x)), scene_queries.SIZE)
    got = sorted(map(tuple, told.collect()))
    days = {r["scene"]: r["acq_date"] for r in scenes.collect()}
    assert len(asked) == 1 and asked[0].count() == asked[0].distinct().count() and asked[0].select("epoch_date").distinct().count() <= len(days)
    assert asked[0].count() <= 9 * calibration.blocks(scenes, cells, scene_queries.BANDS, reference, scene_queries.SIZE).where("p >= 1").count()
    # the same from a raster that is there as a whole: the asked cells among others, at all epochs
    wide = asked[0].select("row", "col").distinct().crossJoin(reference.epochs)
    whole = calibration.Reference.of(reference.at(wide), reference.x0, reference.y0, reference.res)
    assert got and sorted(map(tuple, calibration.pairs(scenes, cells, scene_queries.BANDS, band_map(spark), whole, scene_queries.SIZE).collect())) == got
