"""Queries of aggregates (A), outlier tests, regressions and relative calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraloom.operators import masks, regress, robust, series, spectral
from terraloom.plans import pipelines
from terraloom.plans.catalog import EV, PAIR, PX, query, sql_grubbs, sql_series, sql_steps, steps
from terraloom.schema import WEIGHTS
from terraloom.sources import stores, tables

SCENE = ("scene",)

_LINES = """
sm AS (SELECT scene, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS sxx, var_pop(y) AS syy, covar_pop(y, x) AS sxy FROM pair GROUP BY scene),
lc AS (SELECT *, sxy / sxx AS ols_b1, (syy - sxx + sqrt((syy - sxx) * (syy - sxx) + 4 * sxy * sxy)) / (2 * sxy) AS odr_b1, sxy / sqrt(sxx * syy) AS r FROM sm),
ln AS (SELECT scene, n, my, my - ols_b1 * mx AS ols_b0, ols_b1, my - odr_b1 * mx AS odr_b0, odr_b1, r, r * r AS r2 FROM lc)"""


@query("a08_a20_describe", f"WITH {EV} SELECT px, count(v) AS n, {sql_steps('avg(v)')} AS mean, {sql_steps('stddev_pop(v)')} AS sd, min(v) AS low, max(v) AS high, median(v) AS middle, count(DISTINCT t) AS n_days FROM ev GROUP BY px")
def a08(spark, d):
    s = tables.event_series(spark, d)
    days = s.groupBy("px").agg(F.count_distinct("t").alias("n_days"))
    return robust.describe(s, ("px",), "v").join(days, "px").select("px", "n", steps(F.col("mean")).alias("mean"), steps(F.col("sd")).alias("sd"), "low", "high", "middle", "n_days")


@query(
    "a09_a10_a11_regression_lines",
    f"WITH {PAIR}, {_LINES} SELECT scene, n, {', '.join(f'{sql_steps(c, 10000)} AS {c}' for c in ('ols_b0', 'ols_b1', 'odr_b0', 'odr_b1', 'r', 'r2'))} FROM ln",
)
def a09(spark, d):
    s = regress.lines(tables.scene_pairs(spark, d), SCENE)
    return s.select("scene", "n", *(steps(F.col(c), 10000).alias(c) for c in ("ols_b0", "ols_b1", "odr_b0", "odr_b1", "r", "r2")))


@query(
    "a10b_weighted_regression",
    f"""WITH {PAIR}, w AS (SELECT scene, sum(p) AS a11, sum(p * x) AS a12, sum(p * x * x) AS a22, sum(p * y) AS v0, sum(p * x * y) AS v1
        FROM (SELECT *, CASE WHEN id % 3 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS p FROM pair) GROUP BY scene)
        SELECT scene, {sql_steps('(a22 * v0 - a12 * v1) / (a11 * a22 - a12 * a12)', 10000)} AS b0, {sql_steps('(a11 * v1 - a12 * v0) / (a11 * a22 - a12 * a12)', 10000)} AS b1 FROM w""",
)
def a10b(spark, d):
    pairs = tables.scene_pairs(spark, d).withColumn("p", F.when(F.col("id") % 3 == 0, 1.0).otherwise(0.5))
    s = regress.weighted_line(pairs, SCENE)
    return s.select("scene", *(steps(F.col(c), 10000).alias(c) for c in ("b0", "b1")))


_RESIDUALS = """
rs AS (SELECT scene, ln.n, y, my, round_even(ols_b0 + ols_b1 * x, 0) AS f FROM pair JOIN ln USING (scene)),
st AS (SELECT scene, count(*) AS n, avg(f - y) AS res_mean, sum((f - y) * (f - y)) / count(*) AS mse, sum((f - y) * (f - y)) / (count(*) - 2) AS res_var, sqrt(sum((f - y) * (f - y)) / (count(*) - 2)) AS res_std,
    avg(abs(f - y)) AS mae, avg(CASE WHEN y <> 0 THEN abs(f - y) / y END) AS mre, stddev_pop(f) / avg(f) AS cv_fit, stddev_pop(y) / avg(y) AS cv_obs, stddev_pop(y) AS std_obs,
    sum((f - my) * (f - my)) / count(*) AS var_explained, sum((f - y) * (f - y)) / count(*) AS var_error, var_pop(y) AS var_total FROM rs GROUP BY scene)"""
_STATS = ("res_mean", "mse", "res_var", "res_std", "mae", "mre", "cv_fit", "cv_obs", "std_obs", "var_explained", "var_error", "var_total")


@query("a12_a13_a14_a15_residual_statistics", f"WITH {PAIR}, {_LINES}, {_RESIDUALS} SELECT scene, n, {', '.join(f'{sql_steps(c, 10000)} AS {c}' for c in _STATS)} FROM st")
def a12(spark, d):
    pairs = tables.scene_pairs(spark, d)
    s = regress.residual_stats(pairs, regress.lines(pairs, SCENE), SCENE, "ols_b0", "ols_b1")
    return s.select("scene", "n", *(steps(F.col(c), 10000).alias(c) for c in _STATS))


@query(
    "a12b_orthogonal_statistics",
    f"""WITH {PAIR}, {_LINES}, q AS (SELECT scene, odr_b1 * odr_b1 AS b2, sum((y - odr_b0 - odr_b1 * x) * (y - odr_b0 - odr_b1 * x)) AS rr, count(*) AS m FROM pair JOIN ln USING (scene) GROUP BY scene, odr_b1)
        SELECT scene, {sql_steps('b2 * rr / ((1 + b2) * (1 + b2))')} AS sum_square_delta, {sql_steps('rr / ((1 + b2) * (1 + b2))')} AS sum_square_eps, {sql_steps('rr / (1 + b2)')} AS sum_square, {sql_steps('rr / (1 + b2) / (m - 2)')} AS res_var FROM q""",
)
def a12b(spark, d):
    pairs = tables.scene_pairs(spark, d)
    s = regress.orthogonal_stats(pairs, regress.lines(pairs, SCENE), SCENE)
    return s.select("scene", *(steps(F.col(c)).alias(c) for c in ("sum_square_delta", "sum_square_eps", "sum_square", "res_var")))


@query("a16_median_distance", f"WITH {EV}, m AS (SELECT *, median(v) OVER (PARTITION BY px) AS m FROM ev) SELECT px, t, CASE WHEN m = 0 OR abs(v - m) / m < 0.5 THEN v END AS kept FROM m")
def a16(spark, d):
    return robust.median_distance(tables.event_series(spark, d), ("px",), "v", 0.5).select("px", "t", "kept")


@query("a17_o05_grubbs", f"WITH RECURSIVE {EV}, {sql_grubbs('ev', 'gb', 0.05, 0)} SELECT ev.px, t, v FROM ev JOIN gb ON gb.px = ev.px AND v BETWEEN low AND high")
def a17(spark, d):
    return robust.grubbs(tables.event_series(spark, d), ("px",), "v").select("px", "t", "v")


@query("a17b_grubbs_bounds", f"WITH RECURSIVE {EV}, {sql_grubbs('ev', 'gb', 0.003, 1)} SELECT px, total, low, high, {sql_steps('mean')} AS mean, {sql_steps('sd')} AS sd FROM gb")
def a17b(spark, d):
    b = robust.grubbs_bounds(tables.event_series(spark, d), ("px",), "v", alpha=0.003, ddof=1)
    return b.select("px", "total", "low", "high", steps(F.col("mean")).alias("mean"), steps(F.col("sd")).alias("sd"))


@query(
    "a18_three_sigma_density",
    f"""WITH {EV}, s AS (SELECT px, avg(v) AS mean, stddev_pop(v) AS sd FROM ev GROUP BY px)
        SELECT px, t, CAST(v BETWEEN mean - 3 * sd AND mean + 3 * sd AS INTEGER) AS inside, {sql_steps('exp(-((v - mean) * (v - mean)) / (2 * sd * sd)) / (sd * sqrt(2 * pi()))', 1000000)} AS density
        FROM ev JOIN s USING (px) WHERE v IS NOT NULL AND sd > 0""",
)
def a18(spark, d):
    s = tables.event_series(spark, d)
    about = robust.moments(s, ("px",), "v").select("px", "mean", "sd").where("sd > 0")
    v, m, sd = F.col("v"), F.col("mean"), F.col("sd")
    return s.where(v.isNotNull()).join(about, "px").select("px", "t", v.between(m - F.lit(3.0) * sd, m + F.lit(3.0) * sd).cast("int").alias("inside"), steps(robust.normal_pdf(v, m, sd), 1000000).alias("density"))


@query(
    "a19_histogram",
    f"WITH {PX}, x AS (SELECT value AS v FROM px WHERE value <> 32767), e AS (SELECT min(v) AS lo, max(v) AS hi FROM x) SELECT CAST(least(floor((v - lo) / (hi - lo) * 45), 44) AS INTEGER) AS bin, count(*) AS n FROM x, e GROUP BY 1",
)
def a19(spark, d):
    return robust.histogram(tables.supplier_series(spark, d).where("value <> 32767"), "value")


@query(
    "a23_count_unsolvable",
    f"""WITH {sql_series(WEIGHTS['dft'], '0')}, b AS (SELECT px, t // 46 AS block, count(*) AS n, count(v) AS seen, count(*) FILTER (w > 0) AS weighted FROM sv GROUP BY 1, 2)
        SELECT count(*) FILTER (seen = 0 OR weighted < 7) AS singular, count(*) AS blocks FROM b WHERE n = 46""",
)
def a23(spark, d):
    """Blocks of a year whose weighted harmonic fit the solver gave up: the ones without enough observations of any weight."""
    years = series.tumbling(pipelines.masked(tables.supplier_series(spark, d), WEIGHTS["dft"], missing=0.0), ("px",), 46)
    told = spectral.dft_solvable(spectral.to_blocks(years, ["px", "block"], weight="w"), 3)
    return told.agg(F.count_if(F.col("solvable")[0] == 0).alias("singular"), F.count("*").alias("blocks"))


@query("a24_sums_of_squares", "SELECT p_partkey AS id, CAST(p_size AS BIGINT) * (p_size + 1) * (2 * p_size + 1) // 6 AS total FROM part")
def a24(spark, d):
    """The sum of the squares up to each part's size."""
    squares = F.aggregate(F.sequence(F.lit(1).cast("long"), F.col("p_size").cast("long")), F.lit(0).cast("long"), lambda total, i: total + i * i)
    return tables.read(spark, d, "part").select(F.col("p_partkey").alias("id"), squares.alias("total"))


_PAIR_W = f"""WITH {PAIR}, {_LINES} SELECT scene, id, x, CAST(coalesce(least(greatest(round_even(odr_b0 + odr_b1 * x, 0), 0), 10000), 0) AS INTEGER) AS calibrated FROM pair JOIN ln USING (scene)"""


@query("g06_p04_calibrate_scene", _PAIR_W)
def g06(spark, d):
    pairs = tables.scene_pairs(spark, d)
    lines = regress.lines(pairs, SCENE).select("scene", "odr_b0", "odr_b1")
    return pairs.join(lines, "scene").select("scene", "id", "x", masks.calibrated_range(F.col("odr_b0") + F.col("odr_b1") * F.col("x")).alias("calibrated"))


@query("g05_difference", f"WITH {PAIR}, {_LINES} SELECT scene, id, x, y - CAST(coalesce(least(greatest(round_even(odr_b0 + odr_b1 * x, 0), 0), 10000), 0) AS INTEGER) AS difference FROM pair JOIN ln USING (scene)")
def g05(spark, d):
    pairs = tables.scene_pairs(spark, d)
    lines = regress.lines(pairs, SCENE).select("scene", "odr_b0", "odr_b1")
    return pairs.join(lines, "scene").select("scene", "id", "x", (F.col("y") - masks.calibrated_range(F.col("odr_b0") + F.col("odr_b1") * F.col("x"))).alias("difference"))


def _calibration(spark, d):
    """Scene pairs with one gross error per scene, so that the outlier test has work."""
    pairs = tables.scene_pairs(spark, d)
    return pairs.withColumn("x", F.when(F.col("id") == 1, F.lit(9000.0)).otherwise(F.col("x")))


@query("f10_calibrated_rows")
def f10(spark, d):
    return pipelines.calibrate(_calibration(spark, d), SCENE)[0].select("scene", "id", "x", "calibrated")


@query("f10_k06_calibration_report")
def f10_report(spark, d):
    stats = pipelines.calibrate(_calibration(spark, d), SCENE)[1]
    return stats.select("scene", "n", *(steps(F.col(c), 1000).alias(c) for c in ("ols_b0", "ols_b1", "odr_b0", "odr_b1", "r", "r2", *_STATS)))


@query("f15_point_cloud_statistics")
def f15(spark, d):
    """Distances per axis from a separated list: the outlier test, moments of what it leaves, three-sigma bounds, density at the
    bounds, and the counts of 45 equally wide bins."""
    path = stores.scratch(spark)
    axes = F.posexplode(F.array(F.col("x").cast("double"), F.col("y").cast("double"))).alias("axis", "v")
    listed = tables.scene_pairs(spark, d).select(axes, F.lit(None).cast("string").alias("_c2")).select("axis", (F.col("v") / 100).alias("dist"), "_c2")
    listed.write.option("sep", ";").csv(path, header=True)
    return pipelines.distance_statistics(stores.read_list(spark, path), ("axis",), "dist").select(
        "axis", "total", "n", "low", "high", "bins", *(steps(F.col(c), 10000).alias(c) for c in ("mean", "sd", "left", "right", "density_mean", "density_bound"))
    )


@query("f10_relative_calibration")
def f10_whole(spark, d):
    """Scenes of the parts' raster against the suppliers' series of the epoch nearest to their day: from fine cells to lines."""
    return pipelines.calibration_lines(*_scenes_and_reference(spark, d), size=3).select("scene", "n", *(steps(F.col(c), 1000).alias(c) for c in ("odr_b0", "odr_b1", "r2", "res_std", "mae")))


@query("f10_relative_calibration_rows")
def f10_whole_rows(spark, d):
    """The scenes' cells as calibrated by their lines."""
    scenes, reference = _scenes_and_reference(spark, d)
    lines = pipelines.calibration_lines(scenes, reference, size=3)
    return pipelines.calibrated_scenes(scenes, lines).select("scene", "row", "col", "calibrated")


def _scenes_and_reference(spark, d):
    """scene, acq_date, row, col, value, mask: a scene per ship mode, its day that of its first shipment, on the parts'
    raster. epoch_date, brow, bcol, value: the suppliers' series as a raster of 16 columns, a cell per block of a scene."""
    days = tables.read(spark, d, "lineitem").groupBy(F.concat_ws("-", "l_returnflag", "l_linenumber").alias("scene")).agg((F.min(F.col("l_shipdate").cast("date")) + F.expr("interval 900 days")).cast("date").alias("acq_date"))
    shade = F.pmod(F.crc32("scene"), F.lit(7)) + 4
    # 21 scenes at most: flags and line numbers
    scenes = tables.part_grid(spark, d).crossJoin(F.broadcast(days)).select("scene", "acq_date", "row", "col", (F.col("value") / 100 * shade / 8).alias("value"), "mask")
    day = F.date_add(F.lit("1992-01-01").cast("date"), F.col("t") * 8)
    reference = tables.supplier_series(spark, d).where("value <> 32767").select(
        day.alias("epoch_date"), F.floor(F.col("px") / 16).cast("int").alias("brow"), (F.col("px") % 16).cast("int").alias("bcol"), F.col("value").cast("double").alias("value"), masks.weight(F.col("qual"), WEIGHTS["poly"]).alias("weight")
    )
    return scenes, reference
