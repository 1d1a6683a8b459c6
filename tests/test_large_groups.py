"""Operators whose groups may be of any size, with tiny bounds so that every round takes place; scenes on grids."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_without_sql import left_by_grubbs, to_utm

from terraloom.operators import projections, quantiles, robust
from terraloom.plans import scene_queries


def many_values(seed=4):
    r = random.Random(seed)
    rows = [("even", 0.1 + i / 1000) for i in range(50)] + [("even", 0.45)]
    rows += [("odd", r.gauss(0, 1)) for _ in range(301)] + [("odd", 1e6), ("odd", 1e6), ("odd", -1e5)]
    rows += [("one", 3.5)] * 7 + [("two", 1.0), ("two", 2.0)] + [(None, 4.25), (None, None), (None, float("nan"))] + [("none", None)]
    rows += [("outliers", r.gauss(10, 0.5)) for _ in range(400)] + [("outliers", 50.0 + i * i) for i in range(40)] + [("outliers", -(1000.0 + i)) for i in range(9)]
    rows += [("wide", s * 10.0**e) for e in range(-300, 300, 7) for s in (-1, 1, 1)]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def valued(spark):
    return spark.createDataFrame(many_values(), "g string, v double").repartition(6)


def by_group():
    out = {}
    for g, v in many_values():
        out.setdefault(g, []).append(v)
    return out


@pytest.mark.parametrize("small, bins", [(2, 16), (25, 64), (10_000, 1024)])
def test_medians_by_refined_histograms(valued, small, bins):
    got = {r["g"]: (r["n"], r["middle"]) for r in quantiles.medians(valued, ("g",), "v", small, bins).collect()}
    for g, values in by_group().items():
        seen = [v for v in values if v is not None and not math.isnan(v)]
        assert got.pop(g) == (len(seen), statistics.median(seen) if seen else None)
    assert not got


def test_median_of_all_rows_and_of_none(valued):
    seen = [v for _, v in many_values() if v is not None and not math.isnan(v)]
    assert [tuple(r) for r in quantiles.medians(valued, (), "v", 25, 64).collect()] == [(len(seen), statistics.median(seen))]
    assert quantiles.medians(valued.where("false"), ("g",), "v").count() == 0


@pytest.mark.parametrize("ends, alpha, ddof", [(9, 0.05, 0), (256, 0.003, 1)])
def test_grubbs_by_rounds_of_extremes(valued, ends, alpha, ddof):
    known = valued.where("g IS NOT NULL AND g <> 'wide'")
    got = {r["g"]: r for r in robust.grubbs_bounds(known, ("g",), "v", alpha, ddof, ends).collect()}
    for g, values in by_group().items():
        seen = [v for v in values if v is not None]
        if g in (None, "wide", "none"):
            continue
        kept, mean, sd = left_by_grubbs(seen, alpha, ddof)
        r = got.pop(g)
        assert (r["total"], r["low"], r["high"]) == (len(seen), kept[0], kept[-1])
        assert r["mean"] == pytest.approx(mean, rel=1e-9) and (math.isnan(sd) or r["sd"] == pytest.approx(sd, rel=1e-9, abs=1e-12))
    assert not got


def test_fractional_outlier_goes_without_a_step(valued):
    kept = robust.grubbs(valued.where("g = 'even'"), ("g",), "v").collect()
    assert len(kept) == 50 and max(r["v"] for r in kept) < 0.2


def test_grubbs_sees_condensed_groups_only(valued):
    plan = robust.grubbs_bounds(valued.where("g IS NOT NULL"), ("g",), "v", ends=4)
    assert plan.count() > 0
    v, n = np.arange(10_000.0), np.ones(10_000, np.int64)
    g, x, c, m = robust._condensed(np.zeros(10_000, np.int64), v, n, 4)
    assert len(g) == 9 and c.sum() == 10_000 and (m >= 0).sum() == 1


def test_projections_there_and_back():
    r = np.random.default_rng(3)
    zone = r.integers(31, 35, 500)
    lat = np.radians(r.uniform(1, 75, 500))
    lon = np.radians(zone * 6 - 183 + r.uniform(-3.5, 3.5, 500))
    for south in (0, 1):
        signed = -lat if south else lat
        east, north = projections.to_utm(lon, signed, zone, south, projections.ARRAYS)
        back = projections.from_utm(east, north, zone, south, projections.ARRAYS)
        assert np.abs(back[0] - lon).max() < 1e-9 and np.abs(back[1] - signed).max() < 1e-9
    for i in range(100):
        e, n = to_utm(lon[i], lat[i], int(zone[i]))
        east, north = projections.to_utm(lon[i : i + 1], lat[i : i + 1], zone[i : i + 1], 0, projections.ARRAYS)
        assert abs(east[0] - e) < 0.02 and abs(north[0] - n) < 0.02
    # A published example, 9 degrees east on its zone's meridian
    assert projections.to_utm(np.radians([9.0]), np.radians([48.0]), np.array([32]), 0, projections.ARRAYS)[0][0] == pytest.approx(500_000.0, abs=1e-6)


def a_scene(spark, n_rows=300, n_cols=410):
    scenes = spark.createDataFrame([("s", 32, 0, 512_345.5, 5_330_000.25, 30.0, n_rows, n_cols), ("far", 33, 1, 300_000.0, 6_000_000.0, 30.0, 3, 2)], "scene string, zone int, south int, x0 double, y0 double, res double, n_rows int, n_cols int")
    cells = spark.range(n_rows * n_cols).select(F.lit("s").alias("scene"), F.floor(F.col("id") / n_cols).cast("int").alias("row"), (F.col("id") % n_cols).cast("int").alias("col"), F.col("id").alias("band"), F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("mask"))
    return scenes, cells.where("id % 11 > 0").unionByName(spark.range(6).select(F.lit("far").alias("scene"), F.floor(F.col("id") / 2).cast("int").alias("row"), (F.col("id") % 2).cast("int").alias("col"), (F.col("id") + 10**6).alias("band"), F.lit(1).cast("long").alias("mask")))


def test_scenes_of_many_blocks_equal_cell_by_cell(spark):
    scenes, cells = a_scene(spark)
    grids = {r["scene"]: r for r in projections.target_grids(scenes, 30.88751).collect()}
    held = {(r["scene"], r["row"], r["col"]): (r["band"], r["mask"]) for r in cells.collect()}
    got = {(r["scene"], r["row"], r["col"]): (r["band"], r["mask"]) for r in projections.on_grids(scenes, projections.target_grids(scenes, 30.88751), cells, ("band", "mask"), 30.88751).collect()}
    want = {}
    for s in scenes.collect():
        g = grids[s["scene"]]
        rows, cols = np.meshgrid(np.arange(g["t_rows"]), np.arange(g["t_cols"]), indexing="ij")
        lat = (g["t_y0"] - (rows + 0.5) * 30.88751) / 6371007.18
        lon = (g["t_x0"] + (cols + 0.5) * 30.88751) / (6371007.18 * np.cos(lat))
        east, north = projections.to_utm(lon, lat, s["zone"], s["south"], projections.ARRAYS)
        sr, sc = np.floor((s["y0"] - north) / 30), np.floor((east - s["x0"]) / 30)
        for r, c, i, k in zip(rows.ravel(), cols.ravel(), sr.ravel(), sc.ravel(), strict=True):
            if (s["scene"], i, k) in held:
                want[s["scene"], int(r), int(c)] = held[s["scene"], i, k]
    assert len(want) > 100_000 and got == want


def test_blocks_not_cells_are_exchanged(spark):
    scenes, cells = a_scene(spark)
    out = projections.on_grids(scenes, projections.target_grids(scenes, 30.88751), cells, ("band",), 30.88751)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan or "BroadcastHashJoin" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
    n_blocks = cells.groupBy("scene", F.floor(F.col("row") / projections.SOURCE_SIDE), F.floor(F.col("col") / projections.SOURCE_SIDE)).count().count()
    assert n_blocks == 3 * 4 + 1


def test_denser_outlines_hold_every_cell(spark):
    scenes = a_scene(spark, 4000, 4000)[0].withColumn("x0", F.lit(440_000.0))  # across its zone's meridian, where the upper edge is highest
    few, many = ({r["scene"]: r for r in projections.target_grids(scenes, 30.88751, k).collect()} for k in (1, 64))
    assert all(many[s]["t_x0"] <= few[s]["t_x0"] + 1e-6 and many[s]["t_y0"] >= few[s]["t_y0"] - 1e-6 for s in few)
    assert many["s"]["t_y0"] > few["s"]["t_y0"] or many["s"]["t_rows"] > few["s"]["t_rows"]


def test_offset_to_the_first_whole_reference_cell(spark):
    row = spark.range(1).select(*projections.grid_offset(F.lit(1030.0), F.lit(5970.0), 0.0, 10_000.0, 300.0, 15)).first()
    assert tuple(row) == ((10_000 - 5970) % 300 and (300 - (10_000 - 5970) % 300) / 20 // 1 + ((300 - (10_000 - 5970) % 300) / 20 % 1 > 0.5), round((300 - 1030 % 300) / 20))
    assert scene_queries.FINE == 30.88751


def test_kernels_see_a_bounded_number_of_blocks(spark):
    from terraloom.operators import spectral

    blocks = spark.range(2000).coalesce(1).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vs"))
    out = spectral._kernel(blocks, "seen", lambda vs, _: np.stack([vs[:, 0], np.full(len(vs), float(len(vs)))], axis=1)).collect()
    assert all(r["seen"][0] == r["id"] for r in out) and len(out) == 2000
    assert max(r["seen"][1] for r in out) <= 512
