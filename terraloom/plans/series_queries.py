"""Queries of window and series operators (W), their aggregates (A01-A03) and the fitting pipelines (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraloom.operators import masks, series, spectral, window_fit
from terraloom.plans import pipelines
from terraloom.plans.catalog import EV, PX, query, sql_fill, sql_fit, sql_low_pass, sql_reweight, sql_series, sql_steps, sql_windows, steps
from terraloom.schema import HALF, WEIGHTS
from terraloom.sources import tables

KEYS = ("px",)
W = WEIGHTS["poly_lin"]


def _series(spark, d, weights=W, missing=None):
    return pipelines.masked(tables.supplier_series(spark, d), weights, missing=missing)


_STATS = """st AS (
    SELECT *, min(v) OVER a AS v_min, max(v) OVER a AS v_max, count(w) OVER l AS n_left, count(w) OVER r AS n_right, count(w) OVER c AS n_centre, count(w) OVER a AS n_window
    FROM sv WINDOW a AS (PARTITION BY px ORDER BY t ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING), l AS (PARTITION BY px ORDER BY t ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
        r AS (PARTITION BY px ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING), c AS (PARTITION BY px ORDER BY t ROWS BETWEEN CURRENT ROW AND CURRENT ROW)
)"""
_LINEAR = "(n_left <= 3 OR n_right <= 3 OR n_centre = 0 OR n_window <= 7)"


@query("a01_a02_p12_window_stats", f"WITH {sql_series(W)}, {_STATS} SELECT px, t, v_min, v_max, n_left, n_right, n_centre, n_window, CAST({_LINEAR} AS INTEGER) AS linear FROM st")
def a01(spark, d):
    s = series.window_stats(_series(spark, d), KEYS)
    return s.select("px", "t", "v_min", "v_max", "n_left", "n_right", "n_centre", "n_window", series.linear_is_due().cast("int").alias("linear"))


@query("w01_full_windows", f"WITH {sql_series(W)}, {sql_windows()} SELECT px, t, count(*) AS n_rows, sum(v) AS v_sum FROM win GROUP BY px, t")
def w01(spark, d):
    f = series.frames(_series(spark, d), KEYS)
    total = F.aggregate("frame", F.lit(0.0), lambda a, x: a + F.coalesce(x["v"], F.lit(0.0)))
    some = F.exists("frame", lambda x: x["v"].isNotNull())
    return f.select("px", "t", F.size("frame").cast("long").alias("n_rows"), F.when(some, total).alias("v_sum"))


@query("w02_tumbling_years", f"WITH {PX}, b AS (SELECT px, t, value, t // 46 AS block, t % 46 + 1 AS k, count(*) OVER (PARTITION BY px, t // 46) AS n FROM px) SELECT px, CAST(block AS INTEGER) AS block, CAST(k AS INTEGER) AS k, value FROM b WHERE n = 46")
def w02(spark, d):
    return series.tumbling(tables.supplier_series(spark, d), KEYS, 46).select("px", "block", "k", "value")


@query(
    "w03_a03_weighted_parabola",
    f"WITH {sql_series(W)}, {sql_windows()}, {sql_fit('win', 'c1')} SELECT px, t, {sql_steps('a0')} AS a0, {sql_steps('a1', 1000)} AS a1, {sql_steps('a2', 1000)} AS a2 FROM c1",
)
def w03(spark, d):
    run = lambda v, w: dict(zip(("a0", "a1", "a2"), window_fit.coefficients(window_fit.around(v), window_fit.around(w)), strict=True))
    f = window_fit.over_series(_series(spark, d), KEYS, run, ["a0", "a1", "a2"])
    return f.select("px", "t", steps(F.col("a0")).alias("a0"), steps(F.col("a1"), 1000).alias("a1"), steps(F.col("a2"), 1000).alias("a2"))


@query("w04_a10b_weighted_line", f"WITH {sql_series(W)}, {_STATS}, {sql_windows()}, {sql_fit('win', 'c1', 1)} SELECT px, t, {sql_steps('a0')} AS a0, {sql_steps('a1', 1000)} AS a1 FROM c1 JOIN st USING (px, t) WHERE {_LINEAR}")
def w04(spark, d):
    f = series.frames(series.window_stats(_series(spark, d), KEYS), KEYS).where(series.linear_is_due())
    return series.fit_window(f, "c", degree=1).select("px", "t", steps(F.col("c.a0")).alias("a0"), steps(F.col("c.a1"), 1000).alias("a1"))


@query(
    "w05_residual_weights",
    f"WITH {sql_series(W)}, {sql_windows()}, {sql_fit('win', 'c1')}, {sql_reweight('win', 'c1', 'win2')} SELECT px, t, {sql_steps('w')} AS w_centre FROM win2 WHERE k = 0",
)
def w05(spark, d):
    def run(v, w):
        vs = window_fit.around(v)
        return {"w": window_fit.reweighted(vs, window_fit.fitted(window_fit.coefficients(vs, window_fit.around(w))))[HALF]}

    return window_fit.over_series(_series(spark, d), KEYS, run, ["w"]).select("px", "t", steps(F.col("w")).alias("w_centre"))


@query("w06_interpolate", f"WITH {sql_series(W)}, {sql_fill('sv', 'fl')} SELECT px, t, filled FROM fl")
def w06(spark, d):
    return series.interpolate(_series(spark, d), KEYS).select("px", "t", "filled")


@query(
    "w07_interpolate_online",
    f"""WITH {sql_series(W)}, h AS (SELECT *, CASE WHEN t < 15 THEN v END AS hv FROM sv), {sql_fill('h', 'fl', 'hv')}
        SELECT px, t, CASE WHEN t < 15 THEN coalesce(v, filled) ELSE coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY px ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), filled) END AS filled FROM fl""",
)
def w07(spark, d):
    return series.interpolate(_series(spark, d), KEYS, online_after=15).select("px", "t", "filled")


_BLOCKS = "bl AS (SELECT px, t // 46 AS blk, t % 46 AS k, v, count(*) OVER (PARTITION BY px, t // 46) AS n FROM sv), full_bl AS (SELECT px, blk, k, v FROM bl WHERE n = 46)"


@query(
    "w09_f04_fft_year",
    f"""WITH {sql_series(W)}, {_BLOCKS}, {sql_fill('full_bl', 'fl', keys='px, blk', time='k')}, {sql_low_pass('fl', 'lp', 46)}
        SELECT px, CAST(blk AS INTEGER) AS block, CAST(k + 1 AS INTEGER) AS k, {sql_steps('z')} AS filtered FROM full_bl LEFT JOIN lp USING (px, blk, k)""",
)
def w09(spark, d):
    return pipelines.fft_year(tables.supplier_series(spark, d), rounded=False).select("px", "block", F.col("k").cast("int").alias("k"), steps(F.col("filtered")).alias("filtered"))


@query(
    "w09b_fft_half_largest",
    f"""WITH {sql_series(W)}, {_BLOCKS}, {sql_fill('full_bl', 'fl', keys='px, blk', time='k')}, {sql_low_pass('fl', 'lp', 46, limit='trunc(top) / 2')}
        SELECT px, CAST(blk AS INTEGER) AS block, CAST(k + 1 AS INTEGER) AS k, {sql_steps('z')} AS filtered FROM full_bl LEFT JOIN lp USING (px, blk, k)""",
)
def w09b(spark, d):
    """The older threshold: half the whole part of the strongest frequency's power."""
    years = spectral.to_blocks(series.tumbling(_series(spark, d), KEYS, 46), ["px", "block"])
    out = spectral.from_blocks(spectral.fft_filter(years, threshold="half_largest", rounded=False), ["px", "block"], "filtered")
    return out.select("px", "block", F.col("k").cast("int").alias("k"), steps(F.col("filtered")).alias("filtered"))


_EVW = """ew AS (
    SELECT * FROM (SELECT a.px, a.t AS blk, b.t - a.t + 7 AS k, b.v, count(*) OVER (PARTITION BY a.px, a.t) AS n FROM ev a JOIN ev b ON b.px = a.px AND b.t BETWEEN a.t - 7 AND a.t + 7) WHERE n = 15
)"""


def _event_windows(spark, d):
    s = tables.event_series(spark, d).withColumn("w", F.lit(1.0))
    return series.frames(s, KEYS).select("px", "t", F.col("frame.v").alias("vs"))


@query(
    "f05_fft_window",
    f"WITH {EV}, {_EVW}, {sql_fill('ew', 'fl', keys='px, blk', time='k')}, {sql_low_pass('fl', 'lp', 15)} SELECT ew.px, CAST(ew.blk AS INTEGER) AS t, {sql_steps('z')} AS smooth FROM ew LEFT JOIN lp USING (px, blk, k) WHERE k = 7",
)
def f05(spark, d):
    return spectral.fft_filter(_event_windows(spark, d), rounded=False).select("px", "t", steps(F.col("filtered")[HALF]).alias("smooth"))


@query(
    "f06_w10_fft_twice",
    f"""WITH {EV}, {_EVW}, {sql_fill('ew', 'fl', keys='px, blk', time='k')}, {sql_low_pass('fl', 'lp', 15)}, again AS (SELECT px, blk, k, round_even(z, 0) AS filled FROM lp),
        {sql_low_pass('again', 'lq', 15)} SELECT ew.px, CAST(ew.blk AS INTEGER) AS t, {sql_steps('z')} AS smooth FROM ew LEFT JOIN lq USING (px, blk, k) WHERE k = 7""",
)
def f06(spark, d):
    return spectral.fft_filter(_event_windows(spark, d), passes=2, rounded=False).select("px", "t", steps(F.col("filtered")[HALF]).alias("smooth"))


_SV_WINDOWS = f"{sql_windows()}, ewn AS (SELECT px, t AS blk, k + 7 AS k, v FROM win), {sql_fill('ewn', 'fl', keys='px, blk', time='k')}, {sql_low_pass('fl', 'lp', 15)}"


@query(
    "f05_single_fft_sg_suppliers",
    f"""WITH {sql_series(W)}, {_SV_WINDOWS}, mid AS (SELECT px, blk, sum(re * cos(2 * pi() * b * 7 / 15) - im * sin(2 * pi() * b * 7 / 15)) / 15 AS z FROM lp_k GROUP BY px, blk)
        SELECT px, CAST(blk AS INTEGER) AS t, CAST(coalesce(CASE WHEN round_even(z, 0) >= 0 AND round_even(z, 0) <= 9999 THEN round_even(z, 0) END, 32767) AS INTEGER) AS smooth
        FROM (SELECT px, blk FROM ewn WHERE k = 7) LEFT JOIN mid USING (px, blk)""",
)
def f05_suppliers(spark, d):
    return pipelines.fft_window(tables.supplier_series(spark, d)).select("px", "t", masks.valid_or_fill(F.col("smooth")).alias("smooth"))


@query(
    "w09c_spectrum",
    f"""WITH {sql_series(W)}, {_BLOCKS}, {sql_fill('full_bl', 'fl', keys='px, blk', time='k')}, {sql_low_pass('fl', 'lp', 46)}
        SELECT px, CAST(blk AS INTEGER) AS block, CAST(b AS INTEGER) AS bin, {sql_steps('pw', 1)} AS power, CAST(round(lim) AS BIGINT) AS half_second
        FROM (SELECT *, coalesce(max(pw) FILTER (pw < top * (1 - 1e-12)) OVER (PARTITION BY px, blk), 0) / 2 AS lim FROM lp_p) WHERE b <= 23 AND pw > 1e-3""",
)
def w09c(spark, d):
    filled = series.interpolate(series.tumbling(_series(spark, d), KEYS, 46), ("px", "block"))
    angle = F.col("bin") * (F.col("k") - 1) * (2 * 3.141592653589793 / 46)
    bins = filled.where("filled is not null").select("px", "block", "k", "filled", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("bin"))
    power = bins.groupBy("px", "block", "bin").agg(F.sum(F.col("filled") * F.cos(angle)).alias("re"), F.sum(F.col("filled") * F.sin(angle)).alias("im")).select("px", "block", "bin", ((F.col("re") * F.col("re") + F.col("im") * F.col("im")) / 46).alias("pw"))
    from pyspark.sql import Window

    by = Window.partitionBy("px", "block")
    top = power.select("*", F.max("pw").over(by).alias("top"))
    lim = top.select("*", (F.coalesce(F.max(F.when(F.col("pw") < F.col("top") * (1 - 1e-12), F.col("pw"))).over(by), F.lit(0.0)) / 2).alias("lim"))
    return lim.where("pw > 1e-3").select("px", "block", "bin", steps(F.col("pw"), 1).alias("power"), F.round("lim").cast("long").alias("half_second"))


@query(
    "w11_harmonics_equal_weights",
    f"""WITH {sql_series(W)}, {_BLOCKS}, {sql_fill('full_bl', 'fl', keys='px, blk', time='k')}
        SELECT px, CAST(blk AS INTEGER) AS block, {sql_steps('avg(filled)')} AS c0,
            {", ".join(f"{sql_steps(f'sum(filled * {fn}(2 * pi() * {h} * (k + 1) / 46)) * 2 / 46')} AS {n}{h}" for h in (1, 2, 3) for fn, n in (("cos", "a"), ("sin", "b")))}
        FROM fl GROUP BY px, blk""",
)
def w11(spark, d):
    filled = series.interpolate(series.tumbling(_series(spark, d), KEYS, 46), ("px", "block"))
    sums = filled.groupBy("px", "block").agg(*spectral.equal_weight_harmonics(F.col("filled"), F.col("k"), 46, 3))
    return sums.select("px", "block", *(steps(F.col(c)).alias(c) for c in sums.columns[2:]))


def sql_harmonics(harmonics: int, weights: tuple[float, ...], missing: str) -> str:
    """The weighted harmonics of whole years: normal equations, and their elimination a column a step; too few weights: interpolated."""
    m = 2 * harmonics + 1
    basis = ", ".join(["1.0::DOUBLE", *(f"{f}(2 * pi() * {h} * (k + 1) / 46)" for h in range(1, harmonics + 1) for f in ("cos", "sin"))])
    sums = ", ".join(f"sum(w * a[r] * {x})" for x in [*(f"a[{c}]" for c in range(1, m + 1)), "filled"])
    steps_ = ", ".join(
        f"""g{p} AS MATERIALIZED (SELECT x.px, x.blk, x.r, CASE WHEN x.r = {p} THEN list_transform(x.s, lambda v: v / x.s[{p}]) ELSE list_transform(list_zip(x.s, y.s), lambda z: z[1] - z[2] * (x.s[{p}] / y.s[{p}])) END AS s
            FROM g{p - 1} x JOIN g{p - 1} y ON x.px = y.px AND x.blk = y.blk AND y.r = {p})"""
        for p in range(1, m + 1)
    )
    weighted = _BLOCKS.replace("t % 46 AS k, v,", "t % 46 AS k, v, w,").replace("SELECT px, blk, k, v FROM bl", "SELECT px, blk, k, v, w FROM bl")
    return f"""WITH {sql_series(weights, missing)}, {weighted}, {sql_fill('full_bl', 'fl', keys='px, blk', time='k')},
        bs AS MATERIALIZED (SELECT k, [{basis}] AS a FROM (SELECT unnest(generate_series(0, 45)) AS k)),
        ok AS (SELECT px, blk FROM fl GROUP BY ALL HAVING count(*) FILTER (w > 0) >= {m} AND count(filled) > 0),
        g0 AS MATERIALIZED (SELECT px, blk, r, [{sums}] AS s FROM fl SEMI JOIN ok USING (px, blk) JOIN bs USING (k), (SELECT unnest(generate_series(1, {m})) AS r) GROUP BY px, blk, r), {steps_},
        co AS (SELECT px, blk, list(s[{m + 1}] ORDER BY r) AS c FROM g{m} GROUP BY px, blk),
        ft AS (SELECT px, blk, k, CASE WHEN c IS NULL THEN filled ELSE list_inner_product(c, a) END AS f FROM fl JOIN bs USING (k) LEFT JOIN co USING (px, blk))
        SELECT px, CAST(blk AS INTEGER) AS block, CAST(k + 1 AS INTEGER) AS k, CAST(coalesce(round_even(greatest(round_even(f, 0), 0), 0), 32767) AS INTEGER) AS fitted FROM ft"""


@query("w11_w12_f07_dft", sql_harmonics(3, WEIGHTS["dft"], "0.0"))
def f07(spark, d):
    return pipelines.dft_year(tables.supplier_series(spark, d)).select("px", "block", "k", masks.floored(F.col("fitted")).alias("fitted"))


@query("w13_f09_fourier7", sql_harmonics(7, WEIGHTS["fourier7"], "0.0001"))
def f09(spark, d):
    return pipelines.dft_year(tables.supplier_series(spark, d), harmonics=7, weights=WEIGHTS["fourier7"], missing=0.0001).select("px", "block", "k", masks.floored(F.col("fitted")).alias("fitted"))


def _sparse_weights(spark, d):
    """Years of the series whose weights are lost for every seventh pixel in odd years."""
    lost = (F.col("px") % 7 == 0) & (F.col("block") % 2 == 1)
    years = series.tumbling(pipelines.masked(tables.supplier_series(spark, d), WEIGHTS["fourier7"], missing=0.0001), KEYS, 46)
    return spectral.to_blocks(years.withColumn("w", F.when(lost, 0.0).otherwise(F.col("w"))), ["px", "block"], weight="w")


@query(
    "w12b_neighbour_fallback",
    f"""WITH {sql_series(WEIGHTS["fourier7"], "0.0001")}, {_BLOCKS}, {sql_fill('full_bl', 'fl', keys='px, blk', time='k')},
        un AS (SELECT DISTINCT px, blk, CASE px % 16 WHEN 15 THEN 1 WHEN 14 THEN 2 ELSE 3 END AS reach FROM fl f WHERE px % 7 = 0 AND blk % 2 = 1 OR NOT EXISTS (SELECT 1 FROM fl g WHERE g.px = f.px AND g.blk = f.blk AND filled IS NOT NULL))
        SELECT un.px, CAST(un.blk AS INTEGER) AS block, CAST(k + 1 AS INTEGER) AS k, {sql_steps('avg(filled)')} AS fitted
        FROM un JOIN fl ON fl.blk = un.blk AND fl.px BETWEEN un.px - reach AND un.px + reach AND fl.px // 16 = un.px // 16 GROUP BY ALL""",
)
def w12b(spark, d):
    """Years that the harmonic solver gave up, as the means of their neighbours in squares of 4 x 4 pixels."""
    told = spectral.with_neighbours(_sparse_weights(spark, d), 7, side=4).where(~F.col("solvable"))
    return spectral.from_blocks(told, ["px", "block"], "fitted").select("px", "block", "k", steps(F.col("fitted")).alias("fitted"))


@query("w14_cubic_curves")
def w14(spark, d):
    """Cubic curves through the known values of each year."""
    years = series.tumbling(pipelines.masked(tables.supplier_series(spark, d), WEIGHTS["poly_lin"]), KEYS, 46)
    curves = spectral.spline(spectral.to_blocks(years, ["px", "block"]))
    return spectral.from_blocks(curves, ["px", "block"], "curve").select("px", "block", "k", steps(F.col("curve")).alias("curve"))


@query("w15_w16_positional_years", f"WITH {PX}, y AS (SELECT px, t, value, 1995 + t // 46 AS year FROM px) SELECT px, CAST(year AS INTEGER) AS year, CAST(t - (year - 1995) * 46 AS INTEGER) AS k, value FROM y WHERE year BETWEEN 1996 AND 1998")
def w15(spark, d):
    year = (F.floor(F.col("t") / 46) + 1995).cast("int")
    return tables.supplier_series(spark, d).withColumn("year", year).where(F.col("year").between(1996, 1998)).select("px", "year", (F.col("t") - (F.col("year") - 1995) * 46).cast("int").alias("k"), "value")


@query(
    "f01_poly_lin",
    f"""WITH {sql_series(W)}, {sql_windows()}, {sql_fit('win', 'c1')}, {sql_reweight('win', 'c1', 'win2')}, {sql_fit('win2', 'c2')},
        r AS (SELECT px, t, round_even(a0, 0) AS fit FROM c2), {sql_fill('r', 'fl', 'fit')}
        SELECT px, t, CAST(coalesce(CASE WHEN filled >= 0 AND filled <= 9999 THEN filled END, 32767) AS INTEGER) AS value FROM fl""",
)
def f01(spark, d):
    return pipelines.poly_lin(tables.supplier_series(spark, d)).select("px", "t", masks.valid_or_fill(F.col("smooth")).alias("value"))


@query(
    "f01_poly_lin_refit_on_fit",
    f"""WITH {sql_series(W)}, {sql_windows()}, {sql_fit('win', 'c1')}, {sql_reweight('win', 'c1', 'win2', 'fit')}, {sql_fit('win2', 'c2')},
        r AS (SELECT px, t, round_even(a0, 0) AS fit FROM c2), {sql_fill('r', 'fl', 'fit')}
        SELECT px, t, CAST(coalesce(CASE WHEN filled >= 0 AND filled <= 9999 THEN filled END, 32767) AS INTEGER) AS value FROM fl""",
)
def f01_fit(spark, d):
    return pipelines.poly_lin(tables.supplier_series(spark, d), second="fit").select("px", "t", masks.valid_or_fill(F.col("smooth")).alias("value"))


LP = WEIGHTS["lin_poly"]


@query(
    "f02_p11_lin_poly_lin",
    f"""WITH {sql_series(LP)}, {sql_fill('sv', 'fl')}, fv AS (SELECT px, t, filled AS v, w FROM fl), {sql_windows('fv')}, {sql_fit('win', 'c1')},
        {sql_reweight('win', 'c1', 'win2', 'fit')}, {sql_fit('win2', 'c2')}
        SELECT px, t, CAST(coalesce(CASE WHEN s >= 0 AND s <= 9999 THEN s END, 32767) AS INTEGER) AS value FROM (
            SELECT px, t, CASE WHEN coalesce(round_even(a0, 0), 0) < 1 THEN v ELSE round_even(a0, 0) END AS s FROM c2 JOIN fv USING (px, t))""",
)
def f02(spark, d):
    return pipelines.lin_poly(tables.supplier_series(spark, d)).select("px", "t", masks.valid_or_fill(F.col("smooth")).alias("value"))


@query(
    "f02_lin_poly_online",
    f"""WITH {sql_series(LP)}, h AS (SELECT *, CASE WHEN t < 15 THEN v END AS hv FROM sv), {sql_fill('h', 'fl', 'hv')},
        fv AS (SELECT px, t, w, CASE WHEN t < 15 THEN coalesce(v, filled) ELSE coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY px ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), filled) END AS v FROM fl),
        {sql_windows('fv')}, {sql_fit('win', 'c1')}, {sql_reweight('win', 'c1', 'win2', 'fit')}, {sql_fit('win2', 'c2')}
        SELECT px, t, CAST(coalesce(CASE WHEN s >= 0 AND s <= 9999 THEN s END, 32767) AS INTEGER) AS value FROM (
            SELECT px, t, CASE WHEN coalesce(round_even(a0, 0), 0) < 1 THEN v ELSE round_even(a0, 0) END AS s FROM c2 JOIN fv USING (px, t))""",
)
def f02_online(spark, d):
    return pipelines.lin_poly(tables.supplier_series(spark, d), online=True).select("px", "t", masks.valid_or_fill(F.col("smooth")).alias("value"))


SG = WEIGHTS["sg_fft_poly"]


@query(
    "f03_sg_fft_poly",
    f"""WITH {sql_series(SG)}, {_SV_WINDOWS}, fw AS (SELECT px, t, win.k, round_even(z, 0) AS v, w FROM win LEFT JOIN (SELECT px, blk AS t, k - 7 AS k, z FROM lp) USING (px, t, k)),
        {sql_fit('fw', 'c1')}, {sql_reweight('fw', 'c1', 'win2')}, {sql_fit('win2', 'c2')}
        SELECT px, t, CAST(coalesce(CASE WHEN round_even(a0, 0) >= 0 AND round_even(a0, 0) <= 9999 THEN round_even(a0, 0) END, 32767) AS INTEGER) AS value FROM c2""",
)
def f03(spark, d):
    return pipelines.sg_fft_poly(tables.supplier_series(spark, d)).select("px", "t", masks.valid_or_fill(F.col("smooth")).alias("value"))


_F08 = f"""WITH {sql_series(WEIGHTS['poly'])}, {_STATS}, {sql_windows()}, {sql_fit('win', 'c1')}, {sql_reweight('win', 'c1', 'win2', 'fit')}, {sql_fit('win2', 'c2')},
    {sql_reweight('win2', 'c2', 'win3', 'fit')}, {sql_fit('win3', 'c3')}, {sql_reweight('win3', 'c3', 'win4', 'fit')}, {sql_fit('win4', 'c4')},
    lf AS (SELECT px, t, k, round_even(a0 + a1 * k + a2 * (k * k), 0) AS v, w FROM win4 JOIN c4 USING (px, t)), {sql_fit('lf', 'l1', 1)},
    chosen AS (SELECT px, t, v_min, v_max, round_even(CASE WHEN {_LINEAR} THEN l1.a0 ELSE c4.a0 END, 0) AS fit FROM c4 JOIN l1 USING (px, t) JOIN st USING (px, t)),
    held AS (SELECT px, t, CASE WHEN fit > v_max THEN v_max WHEN fit < v_min THEN v_min ELSE fit END AS s FROM chosen)
    SELECT px, t, CAST(coalesce(CASE WHEN s >= 0 AND s <= 9999 THEN s END, 32767) AS INTEGER) AS value FROM held"""


@query("f08_p03_poly", _F08)
def f08(spark, d):
    return pipelines.poly(tables.supplier_series(spark, d)).select("px", "t", masks.valid_or_fill(F.col("smooth")).alias("value"))


@query("p03_clamp_to_extremes", f"WITH {sql_series(W)}, {_STATS} SELECT px, t, CASE WHEN 1.1 * v > v_max THEN v_max WHEN 1.1 * v < v_min THEN v_min ELSE 1.1 * v END AS clamped FROM st")
def p03(spark, d):
    s = series.window_stats(_series(spark, d), KEYS)
    return s.select("px", "t", masks.between_extremes(F.col("v") * 1.1, F.col("v_min"), F.col("v_max")).alias("clamped"))
