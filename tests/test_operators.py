"""Operators without SQL against brute force and golden values."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.operators import masks, regress, robust, series, spatial, spectral, temporal, window_fit
from terraloom.plans import join_queries, pipelines, spatial_queries, store_queries
from terraloom.sources import stores, tables
from terraloom.streaming import sliding


def brute_grubbs(values, alpha=0.05, ddof=0):
    v = np.array([np.nan if x is None else x for x in values], float)
    critical = robust.grubbs_critical(len(v), alpha)
    while np.isfinite(v).sum() > ddof:
        far = np.abs(v - np.nanmean(v))
        if not np.nanstd(v, ddof=ddof) or np.nanmax(far) / np.nanstd(v, ddof=ddof) <= critical:
            break
        v[far >= np.nanmax(far) * (1 - 1e-12)] = np.nan
    return sorted(v[np.isfinite(v)].tolist())


def test_grubbs_critical_values():
    for n, want in ((10, 2.28995), (20, 2.70825), (100, 3.38408)):
        assert robust.grubbs_critical(n) == pytest.approx(want, abs=2e-5)


def test_grubbs(spark):
    rng = np.random.default_rng(4)
    groups = {1: [10, 11, 9, 10, 12, 8, 10, 11, 9, 30], 2: [5] * 8, 3: [1.0, None], 4: [None] * 4, 5: [0, 100, 50, 50, 50, 50, 50, 50, 50, 50], 6: rng.normal(100, 5, 400).round().tolist() + [900, 900, 950, -400]}
    df = spark.createDataFrame([(g, i, None if x is None else float(x)) for g, v in groups.items() for i, x in enumerate(v)], "g int, i int, v double")
    got = robust.grubbs(df, ("g",), "v").groupBy("g").agg(F.sort_array(F.collect_list("v")).alias("v")).collect()
    assert {r["g"]: r["v"] for r in got} == {g: b for g, v in groups.items() if (b := brute_grubbs(v))}


def test_regressions(spark):
    df = spark.createDataFrame([("a", float(x), y) for x, y in zip(range(1, 6), (2.1, 3.9, 6.2, 7.8, 10.1), strict=True)] + [("b", float(x), 3.0 + 2.0 * x) for x in range(9)] + [("c", 1.0, None)], "g string, x double, y double")
    rows = {r["g"]: r for r in regress.lines(df, ("g",)).collect()}
    a, b = rows["a"], rows["b"]
    assert (a["odr_b1"], a["odr_b0"], a["ols_b1"], a["ols_b0"], a["r2"]) == pytest.approx((1.994295, 0.037116, 1.99, 0.05, 0.997305), abs=1e-6)
    assert (b["ols_b0"], b["ols_b1"], b["odr_b0"], b["odr_b1"]) == pytest.approx((3, 2, 3, 2))
    assert regress.orthogonal_stats(df, regress.lines(df, ("g",)), ("g",)).where("g = 'a'").first()["sum_square"] == pytest.approx(0.021535 / 1, abs=1e-6)


def one_series(spark, values, quals=None):
    quals = quals or [0] * len(values)
    return spark.createDataFrame([(1, t, v, q) for t, (v, q) in enumerate(zip(values, quals, strict=True))], "px int, t int, value int, qual int")


def test_window_fit_golden(spark):
    df = one_series(spark, [500, 510, 530, 525, 560, 580, 900, 600, 620, 615, 640, 650, 660, 655, 670], [0, 0, 1, 0, 0, 1, 3, 0, 0, 2, 0, 0, 255, 0, 0])
    f = series.fit_window(series.frames(pipelines.masked(df, (1, 0.5, 0.25, 0.01)), ("px",)), "c")
    f = f.withColumn("all", series.fitted("frame", "c"))
    f = series.fit_window(series.reweight(f, "again", "c"), "c2", "again").first()
    assert f["c"]["a0"] == pytest.approx(601.6211, abs=1e-4)
    assert f["all"] == [492, 510, 528, 544, 560, 575, 589, 602, 614, 625, 636, 645, 654, 662, 669]
    assert f["c2"]["a0"] == pytest.approx(602.8289, abs=1e-4)


def test_parabola_is_exact(spark):
    df = one_series(spark, [3 * t * t + 2 * t + 1 for t in range(20)])
    got = pipelines.poly_lin(df).where("t between 7 and 12").collect()
    assert [(r["t"], r["smooth"]) for r in sorted(got)] == [(t, 3 * t * t + 2 * t + 1) for t in range(7, 13)]


@pytest.mark.parametrize("values, want", [([350, 360, None, None, 390, 400, None, None, 380], [350, 360, 370, 380, 390, 400, 393, 387, 380]), ([None, None, 10, None, 20, None], [10, 10, 10, 15, 20, 20]), ([None] * 3, [None] * 3)])
def test_interpolation(spark, values, want):
    df = spark.createDataFrame([(1, t, v) for t, v in enumerate(values)], "px int, t int, v int")
    assert [r["filled"] for r in series.interpolate(df, ("px",)).orderBy("t").collect()] == want
    filled = spectral.fill_rows(np.array([[np.nan if v is None else v for v in values]], float))[0]
    assert [None if np.isnan(x) else x for x in filled] == want


def test_fourier_filter_and_harmonics():
    t = np.arange(1, 47)
    v = 1000 + 300 * np.cos(2 * np.pi * t / 46) + 100 * np.sin(4 * np.pi * t / 46)
    assert spectral.low_pass(v[None])[0] == pytest.approx(1000 + 300 * np.cos(2 * np.pi * t / 46), abs=1e-6)
    assert spectral.low_pass(np.full((1, 46), 7.0))[0] == pytest.approx(np.full(46, 7.0))
    w = np.random.default_rng(1).uniform(0.1, 1, 46)
    assert spectral.harmonic_fit(v[None], w[None], 3)[0] == pytest.approx(v, abs=1e-6)
    assert spectral.harmonic_fit(v[None], np.zeros((1, 46)), 3)[0] == pytest.approx(v)


def test_harmonic_years_follow_least_squares(spark, sf_dir):
    df = tables.supplier_series(spark, sf_dir).where("px <= 3")
    got = {(r["px"], r["block"], r["k"]): r["fitted"] for r in pipelines.dft_year(df).collect()}
    held = {}
    for r in pipelines.masked(df, (1, 0.5, 0.25, 0.01), missing=0.0).collect():
        held.setdefault((r["px"], r["t"] // 46), {})[r["t"] % 46] = (r["v"], r["w"])
    for (px, block), cells in held.items():
        if len(cells) < 46:
            continue
        v = spectral.fill_rows(np.array([[np.nan if cells[k][0] is None else cells[k][0] for k in range(46)]]))[0]
        s = np.sqrt([cells[k][1] or 0 for k in range(46)])
        a = spectral.harmonic_basis(46, 3)
        x = np.linalg.lstsq(a * s[:, None], v * s, rcond=None)[0]
        assert [got[px, block, k + 1] for k in range(46)] == pytest.approx(np.rint(a @ x), abs=1)


def test_fallback_golden(spark):
    fit = [None, 70, 30, 30, None, None, 30, None, None, None, 30, 30, 30, 58, None, 30]
    lin = [46, 70, 47, 1, 10, 45, 42, 27, 32, 22, 6, 5, 5, 58, 56, 22]
    df = spark.createDataFrame([(i, f, x) for i, (f, x) in enumerate(zip(fit, lin, strict=True))], "i int, f int, x int")
    assert [r[0] for r in df.orderBy("i").select(masks.fit_or_interpolation(F.col("f"), F.col("x"))).collect()] == [46, 70, 30, 30, 10, 45, 30, 27, 32, 22, 30, 30, 30, 58, 56, 30]


def test_domains(spark):
    df = spark.createDataFrame([(x,) for x in (-5.0, 0.0, 9999.0, 10000.0, 12000.0, None)], "v double")
    rows = df.select(masks.valid_or_fill(F.col("v")).alias("a"), masks.floored(F.col("v")).alias("b")).collect()
    assert [r["a"] for r in rows] == [32767, 0, 9999, 32767, 32767, 32767] and [r["b"] for r in rows] == [0, 0, 9999, 10000, 12000, 32767]


def test_calendar(spark):
    rows = temporal.calendar(spark).orderBy("epoch_seq").collect()
    assert len(rows) == 927 and str(rows[0]["epoch_date"]) == "2000-02-26" and str(rows[-1]["epoch_date"]) == "2020-04-14"


def test_point_to_cell(spark):
    row, col = spatial.cell_of(F.lit(600000.0), F.lit(5300000.0), F.lit(0.0), F.lit(5559752.597460333), F.lit(463.31271652750013))
    assert tuple(spark.range(1).select(row, col).first()) == (560, 1295)


def test_utm(spark):
    """Known values: the central meridian maps to 500 km, and the meridian arc to 45 degrees north is 4,984,944.38 m."""
    east, north = spatial.utm(F.lit(math.radians(9.0)), F.lit(math.radians(45.0)), 32)
    e, n = spark.range(1).select(east, north).first()
    assert e == pytest.approx(500000.0, abs=1e-6) and n == pytest.approx(4984944.378 * 0.9996, abs=0.01)
    lon, lat = spatial.sinusoidal_inverse(*spatial.sinusoidal(F.lit(0.3), F.lit(0.8)))
    assert tuple(spark.range(1).select(lon, lat).first()) == pytest.approx((0.3, 0.8))


def shape_file(kind, records):
    body = b""
    for number, points in enumerate(records, 1):
        if kind == 1:
            content = struct.pack("<i2d", 1, *points[0])
        else:
            xs, ys = zip(*points, strict=True)
            content = struct.pack("<i4d2ii", 3, min(xs), min(ys), max(xs), max(ys), 1, len(points), 0) + b"".join(struct.pack("<2d", *p) for p in points)
        body += struct.pack(">2i", number, len(content) // 2) + content
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<2i8d", 1000, kind, *[0.0] * 8) + body


def test_shapes(spark, tmp_path):
    (tmp_path / "p.shp").write_bytes(shape_file(1, [[(1.5, 2.5)], [(-3.0, 4.0)]]))
    (tmp_path / "l.shp").write_bytes(shape_file(3, [[(0.0, 0.0), (5.0, 1.0), (9.0, 7.0)]]))
    assert sorted(map(tuple, stores.read_points(spark, str(tmp_path)).collect())) == [(1, 1.5, 2.5), (2, -3.0, 4.0)]
    assert [tuple(r) for r in stores.read_lines(spark, str(tmp_path)).collect()] == [(1, 0.0, 0.0, 9.0, 7.0)]


def test_windowed_reads_are_pushed_down(spark, tmp_path):
    df = spark.range(400).selectExpr("'raw' fit_product", "'h18v04' tile", "1 band", "2000 year", "cast(id / 20 as int) row", "cast(id % 20 as int) col", "date'2000-02-26' epoch_date", "0 epoch_seq", "cast(id as int) value")
    stores.write_pixels(df, str(tmp_path / "px"))
    cut = stores.read_pixels(spark, str(tmp_path / "px"), box=(2, 3, 4, 5)).where("band = 1")
    plan = cut._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThanOrEqual(row,2)" in plan and "PartitionFilters: [isnotnull(band" in plan
    assert cut.count() == 4


def test_stream_equals_batch_and_goes_on(spark, tmp_path):
    df = pipelines.masked(one_series(spark, [100 + 7 * (t % 5) + t for t in range(40)]), (1.0, 0.5, 0.01, 0.01))
    source, target, mark = (str(tmp_path / d) for d in ("in", "out", "mark"))
    df.where("t < 22").coalesce(1).write.option("maxRecordsPerFile", 22).parquet(source)
    assert sliding.run_once(spark, source, target, mark).count() == 8
    df.where("t >= 22").coalesce(1).write.mode("append").parquet(source)
    got = {r["t"]: r["fit"] for r in sliding.run_once(spark, source, target, mark).collect()}
    want = {r["t"]: r["c"]["a0"] for r in series.fit_window(series.frames(df, ("px",)), "c").collect()}
    assert got.keys() == want.keys() and all(got[t] == pytest.approx(want[t]) for t in want)


def test_all_series_are_streamed(spark):
    sf_dir = "/root/testdata/sf0.01"
    n = tables.supplier_series(spark, sf_dir).groupBy("px").count().collect()
    got = {r["px"]: r["count"] for r in store_queries.s02c(spark, sf_dir).groupBy("px").count().collect()}
    assert len(n) > 21 and got == {r["px"]: r["count"] - 14 for r in n}


def test_every_cell_of_the_raster_is_aligned(spark):
    sf_dir = "/root/testdata/sf0.01"
    cells = {(r["row"], r["col"]) for r in tables.part_grid(spark, sf_dir).collect()}
    got = spatial_queries.j06b(spark, sf_dir).collect()
    assert sorted((r["row"], r["col"]) for r in got) == sorted(cells) and max(r for r, _ in cells) > 1
    assert all(0 <= r["tile_row"] < 40 and 0 <= r["tile_col"] < 40 for r in got)


def test_scenes_at_both_ends_have_their_neighbours(spark):
    sf_dir = "/root/testdata/sf0.001"
    epochs = sorted(r[0] for r in tables.epochs(spark, sf_dir).collect())
    scenes = tables.scene_dates(spark, sf_dir).collect()
    want = set()
    for s in scenes:
        want |= {(s["scene"], "pre", k, str(e)) for k, e in enumerate([e for e in epochs if e < s["acq_date"]][-1:-4:-1], 1)}
        want |= {(s["scene"], "post", k, str(e)) for k, e in enumerate([e for e in epochs if e >= s["acq_date"]][:3], 1)}
    got = join_queries.j04(spark, sf_dir).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert any(str(s["acq_date"]) < "1995-06-01" for s in scenes) and any(str(s["acq_date"]) > "2001-06-01" for s in scenes)


def test_neighbours_beyond_the_epochs(spark):
    days = spark.createDataFrame([(f"2000-01-{d:02}",) for d in (5, 13, 21, 29)], "d string").selectExpr("cast(d as date) e")
    scenes = spark.createDataFrame([(1, "1990-01-01"), (2, "2000-01-13"), (3, "2010-01-01")], "scene long, d string").selectExpr("scene", "cast(d as date) a")
    got = {(r["scene"], r["side"], r["rank"], r["day"].day) for r in temporal.neighbours(scenes, days, "a", "e", 3, "scene").collect()}
    assert got == {(1, "post", 1, 5), (1, "post", 2, 13), (1, "post", 3, 21), (2, "pre", 1, 5), (2, "post", 1, 13), (2, "post", 2, 21), (2, "post", 3, 29), (3, "pre", 1, 29), (3, "pre", 2, 21), (3, "pre", 3, 13)}


def test_calibration_finds_the_line(spark):
    df = spark.createDataFrame([("s", i, float(x), 3.0 + 2.0 * x) for i, x in enumerate(range(1, 60))] + [("s", 99, 9000.0, 5.0)], "scene string, id int, x double, y double")
    rows, stats = pipelines.calibrate(df, ("scene",))
    s = stats.first()
    assert (s["n"], s["odr_b0"], s["odr_b1"], s["mse"]) == pytest.approx((59, 3, 2, 0))
    assert rows.where("id = 4").first()["calibrated"] == 13


def test_kernels_equal_expressions(spark):
    """The fits of whole series as matrices against the same by expressions over each row's window, gaps and lengths included."""
    rng = np.random.default_rng(4)
    rows = [
        (px, t, None if rng.random() < 0.3 else float(rng.integers(0, 9000)), None if rng.random() < 0.2 else float(rng.choice([1.0, 0.5, 0.01])))
        for px, n in ((1, 40), (2, 40), (3, 22), (4, 9), (5, 15)) for t in range(n)
    ]
    df = spark.createDataFrame(rows, "px long, t int, v double, w double")
    f = series.fit_window(series.frames(df, ("px",)), "c")
    f = series.fit_window(series.reweight(f, "again", "c"), "c2", "again")
    want = {(r["px"], r["t"]): (r["c"]["a0"], r["c"]["a1"], r["c"]["a2"], r["c2"]["a0"]) for r in f.collect()}

    def run(v, w):
        vs, ws = window_fit.around(v), window_fit.around(w)
        return dict(zip("abcd", [*window_fit.coefficients(vs, ws), window_fit.refit(vs, ws)[0][0]], strict=True))

    got = {(r["px"], r["t"]): tuple(r)[2:] for r in window_fit.over_series(df, ("px",), run, "abcd").collect()}
    assert got == want and len(got) == 26 + 26 + 8 + 1


def test_reordered_repeated_and_late_rows_of_a_stream(spark):
    """Rows within the lag complete windows in any order, repeated ones come out as late, those behind the watermark leave; state ends."""
    batches = [[0, 1, 2, 3, 5, 4, 6, 7, 8, 9, 10, 11, 12, 13, 14, 16], [15, 17, 14, 18], [19, 18, 16, 21, 22, 23, 24, 25, 26], [20, 27, 28, 29, 30, 31, 32, 33, 35, 36, 37, 38, 39, 40, 41], [34], [90], [91]]
    source, target, check, told = *(stores.scratch(spark) for _ in range(3)), []
    for i, b in enumerate(batches):
        series = (1, 2, 70, 200) if i == 0 else (1, 2, 70)  # the last one ends, and so does its block
        spark.createDataFrame([(p, x, float(x * x + p), 1.0) for x in b for p in series if (p, x) != (70, 3)], "px long, t int, v double, w double").coalesce(1).write.mode("append").parquet(source)
        out = sliding.run_once(spark, source, target, check, lag=7, progress=told)
    rows = out.collect()
    for p in (1, 2, 70):
        assert sorted(r["t"] for r in rows if r["px"] == p and not r["late"]) == list(range(11 if p == 70 else 7, 27))
        assert sorted(r["t"] for r in rows if r["px"] == p and r["late"]) == [14, 16, 18]
    assert all(abs(r["fit"] - r["t"] ** 2 - r["px"]) < 1e-6 for r in rows if not r["late"])
    operators = [p.stateOperators[0] for p in told if p.stateOperators]
    assert sum(o.numRowsDroppedByWatermark for o in operators) == 3  # epoch 34, of each series
    assert max(o.numRowsTotal for o in operators) == 3 and operators[-1].numRowsTotal == 2  # blocks with state: one has been closed


def test_a_missing_epoch_makes_no_wider_window():
    px, t = np.zeros(19, int), np.array([x for x in range(20) if x != 16])
    out = sliding.completed(px, t, t * 1.0, np.ones(19), np.ones(19, bool))
    assert out["t"].tolist() == [7, 8]
