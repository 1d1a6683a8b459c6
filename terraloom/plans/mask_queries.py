"""Queries of projections, filters and predicates (P) and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraloom.operators import masks, temporal
from terraloom.plans.catalog import EPOCHS, EV, GRID, NAMES, PX, SCENES, query, sql_weight
from terraloom.schema import WEIGHTS
from terraloom.sources import tables


@query("p01_mask_fill", f"WITH {PX} SELECT px, t, CASE WHEN value <> 32767 THEN value END AS v FROM px")
def p01(spark, d):
    return tables.supplier_series(spark, d).select("px", "t", masks.no_fill(F.col("value")).alias("v"))


@query(
    "p02_quality_weights",
    f"""WITH {PX} SELECT px, t, qual, CAST({sql_weight((1.0, 0.5, 0.25, 0.01))} AS DOUBLE) AS w,
        CAST(CASE qual WHEN 0 THEN 0.5 WHEN 1 THEN 0.5 WHEN 2 THEN 0.25 WHEN 3 THEN 0.01 END AS DOUBLE) AS w_chained,
        CAST({sql_weight((1.0, 0.5, 0.25, 0.01), "0.0")} AS DOUBLE) AS w_zero, CAST(CASE qual WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.25 WHEN 3 THEN 0.01 WHEN 4 THEN 4.0 END AS DOUBLE) AS w_code4,
        CAST(CASE qual WHEN 0 THEN 0.99 WHEN 1 THEN 0.5 WHEN 2 THEN 0.01 WHEN 3 THEN 0.01 ELSE 0.0001 END AS DOUBLE) AS w_fourier7
        FROM px""",
)
def p02(spark, d):
    q, w = F.col("qual"), WEIGHTS["lin_poly"]
    return tables.supplier_series(spark, d).select(
        "px", "t", "qual", masks.weight(q, w).alias("w"), masks.weight(q, w, recode="chained").alias("w_chained"), masks.weight(q, w, missing=0.0).alias("w_zero"),
        masks.weight(q, w, keep_code4=True).alias("w_code4"), masks.weight(q, WEIGHTS["fourier7"], missing=0.0001).alias("w_fourier7"),
    )


@query(
    "p04_p05_p06_p25_ranges",
    f"""WITH {PX}, x AS (SELECT px, t, CASE WHEN value <> 32767 THEN 1.25 * value - 700 END AS f FROM px)
        SELECT px, t, CAST(coalesce(least(greatest(round_even(f, 0), 0), 10000), 0) AS INTEGER) AS calibrated,
            CAST(CASE WHEN f IS NOT NULL THEN least(round_even(greatest(f, 0), 0), 32767) ELSE 0 END AS INTEGER) AS block_calibrated,
            CAST(coalesce(CASE WHEN f >= 0 AND f <= 9999 THEN round_even(f, 0) END, 32767) AS INTEGER) AS domain,
            CAST(CASE WHEN f IS NOT NULL THEN round_even(greatest(f, 0), 0) ELSE 32767 END AS INTEGER) AS floored,
            CASE WHEN f IS NULL THEN 0.0 WHEN f > 0 AND f < 10000 THEN f ELSE 0 END AS extracted,
            CAST(coalesce(least(greatest(round_even(f, 0), -32768), 32767), 0) AS INTEGER) AS int16
        FROM x""",
)
def p04(spark, d):
    s = tables.supplier_series(spark, d).select("px", "t", (masks.no_fill(F.col("value")) * 1.25 - 700).alias("f"))
    f = F.col("f")
    block = F.when(f.isNull(), F.lit(0)).otherwise(masks.calibrated_block(f))
    return s.select(
        "px", "t", masks.calibrated_range(f).alias("calibrated"), block.alias("block_calibrated"), masks.valid_or_fill(f).alias("domain"),
        F.when(f.isNull(), F.lit(32767)).otherwise(masks.floored(f)).alias("floored"), masks.extracted(f).alias("extracted"), masks.to_int16(f).alias("int16"),
    )


@query("p07_epoch_slice", f"WITH {PX}, n AS (SELECT max(t) + 1 AS n FROM px) SELECT px, t, value FROM px, n WHERE t >= 39 AND t < n - 14")
def p07(spark, d):
    s = tables.supplier_series(spark, d)
    size = s.agg((F.max("t") + 1).alias("n"))
    return s.crossJoin(F.broadcast(size)).where((F.col("t") >= 39) & (F.col("t") < F.col("n") - 14)).select("px", "t", "value")


@query(
    "p08_p13_p22_date_filters",
    f"""WITH {SCENES}, {EPOCHS} SELECT scene, CAST(acq_date AS VARCHAR) AS acq_date, CAST(year(acq_date) AS INTEGER) AS year, CAST(dayofyear(acq_date) AS INTEGER) AS doy FROM scn
        WHERE year(acq_date) BETWEEN 1996 AND 2000 AND dayofyear(acq_date) BETWEEN 120 AND 270 AND acq_date >= (SELECT min(epoch_date) FROM epo)""",
)
def p08(spark, d):
    first = tables.epochs(spark, d).agg(F.min("epoch_date").alias("first"))
    day = F.col("acq_date")
    return (
        tables.scene_dates(spark, d)
        .where(F.year(day).between(1996, 2000) & F.dayofyear(day).between(120, 270))
        .crossJoin(F.broadcast(first))
        .where(day >= F.col("first"))
        .select("scene", day.cast("string").alias("acq_date"), F.year(day).alias("year"), F.dayofyear(day).alias("doy"))
    )


@query("p09_cloud_mask", f"WITH {GRID} SELECT row, col, CASE WHEN mask <> 2 AND mask <> 0 AND value <> 0 THEN value END AS v FROM grid")
def p09(spark, d):
    return tables.part_grid(spark, d).select("row", "col", masks.mask_out(F.col("value"), F.col("mask")).alias("v"))


@query("p10_quality_without_data", f"WITH {PX} SELECT px, t, CAST(value = 32767 AND CASE WHEN qual = 255 AND t % 3 = 0 THEN 0 ELSE qual END <> 255 AS INTEGER) AS mismatch FROM px")
def p10(spark, d):
    qual = F.when((F.col("qual") == 255) & (F.col("t") % 3 == 0), 0).otherwise(F.col("qual"))
    return tables.supplier_series(spark, d).select("px", "t", masks.quality_mismatch(F.col("value"), qual).cast("int").alias("mismatch"))


@query(
    "p14_p15_band_maps",
    """WITH m(sensor, scene_band, ref_band) AS (VALUES ('LE7', 1, 3), ('LE7', 2, 4), ('LE7', 3, 1), ('LE7', 4, 2), ('LE7', 5, 6), ('LE7', 6, 7),
            ('LT5', 1, 3), ('LT5', 2, 4), ('LT5', 3, 1), ('LT5', 4, 2), ('LT5', 5, 6), ('LT5', 6, 7),
            ('LC8', 2, 3), ('LC8', 3, 4), ('LC8', 4, 1), ('LC8', 5, 2), ('LC8', 6, 6), ('LC8', 7, 7)),
        s AS (SELECT DISTINCT l_suppkey AS scene, CASE l_suppkey % 3 WHEN 0 THEN 'LE7' WHEN 1 THEN 'LT5' ELSE 'LC8' END AS sensor FROM lineitem)
        SELECT scene, sensor, scene_band, ref_band, sensor || '.' || v.v || '.band_' || CAST(ref_band AS VARCHAR) AS variant
        FROM s JOIN m USING (sensor), (VALUES ('ols_500'), ('odr_500')) v(v)""",
)
def p14(spark, d):
    bands = band_map(spark)
    sensor = F.when(F.col("scene") % 3 == 0, "LE7").when(F.col("scene") % 3 == 1, "LT5").otherwise("LC8")
    scenes = tables.read(spark, d, "lineitem").select(F.col("l_suppkey").alias("scene")).distinct().withColumn("sensor", sensor)
    variants = F.explode(F.array(F.lit("ols_500"), F.lit("odr_500"))).alias("v")
    return scenes.join(F.broadcast(bands), "sensor").select("*", variants).select("scene", "sensor", "scene_band", "ref_band", F.concat("sensor", F.lit("."), "v", F.lit(".band_"), F.col("ref_band").cast("string")).alias("variant"))


def band_map(spark):
    """Which reference band each scene band is calibrated to, by sensor: 18 rows."""
    # Reference bands in the order of the sensors' bands; the last sensor's bands start at 2.
    reference = (3, 4, 1, 2, 6, 7)
    rows = [(s, i + first, r) for s, first in (("LE7", 1), ("LT5", 1), ("LC8", 2)) for i, r in enumerate(reference)]
    return spark.createDataFrame(rows, "sensor string, scene_band int, ref_band int")


@query(
    "p17_p18_weight_filter",
    f"""WITH {PX} SELECT px, t, value, CASE WHEN p < 1 THEN 0.0 ELSE p END AS p FROM (
        SELECT px, t, CASE WHEN value <> 32767 THEN value END AS value, CAST({sql_weight((1.0, 0.5, 0.01, 0.01), "0.0")} AS DOUBLE) AS p FROM px) WHERE p >= 1 AND value IS NOT NULL""",
)
def p17(spark, d):
    s = tables.supplier_series(spark, d).select("px", "t", masks.no_fill(F.col("value")).alias("value"), masks.only_full_weight(masks.weight(F.col("qual"), WEIGHTS["poly_lin"], missing=0.0)).alias("p"))
    return s.where((F.col("p") >= 1) & F.col("value").isNotNull())


@query("p20_unpaired_epochs", f"WITH {PX} SELECT count(*) AS unpaired FROM (SELECT px, t FROM px WHERE value <> 32767) a ANTI JOIN (SELECT px, t FROM px WHERE qual <> 255) b USING (px, t)")
def p20(spark, d):
    s = tables.supplier_series(spark, d)
    return s.where("value <> 32767").select("px", "t").join(s.where("qual <> 255").select("px", "t"), ["px", "t"], "left_anti").agg(F.count("*").alias("unpaired"))


@query(
    "p21_s10_file_names",
    f"""WITH {NAMES} SELECT name, split_part(name, '.', 1) AS product, CAST(substr(split_part(name, '.', 2), 2, 4) AS INTEGER) AS year, CAST(substr(split_part(name, '.', 2), 6, 3) AS INTEGER) AS doy,
            split_part(name, '.', 3) AS tile, CAST(substr(split_part(name, '.', 3), 2, 2) AS INTEGER) AS h, CAST(substr(split_part(name, '.', 3), 5, 2) AS INTEGER) AS v,
            split_part(name, '.', 1) || '.' || split_part(name, '.', 2) || '.' || split_part(name, '.', 3) || '.band_1.tif' AS band_file
        FROM nam WHERE split_part(name, '.', 3) IN ('h18v04', 'h19v04') AND name NOT LIKE '%.jpg'""",
)
def p21(spark, d):
    from terraloom.functions.names import parts

    n = tables.file_names(spark, d).where(~F.col("name").rlike(r"\.jpg$"))
    p = parts(F.col("name"))
    return n.select("name", *(p[c].alias(c) for c in ("product", "year", "doy", "tile", "h", "v")), F.concat_ws(".", p["product"], p["epoch"], p["tile"], F.lit("band_1.tif")).alias("band_file")).where(F.col("tile").isin("h18v04", "h19v04"))


@query("p23_plot_levels", f"WITH {PX} SELECT px, t, CASE qual WHEN 0 THEN 300.0 WHEN 1 THEN 200.0 WHEN 2 THEN 100.0 WHEN 3 THEN 50.0 WHEN 4 THEN 0.1 * 100 ELSE 0.0 END AS level FROM px")
def p23(spark, d):
    return tables.supplier_series(spark, d).select("px", "t", masks.plot_level(F.col("qual")).cast("double").alias("level"))


@query("p24_half_even", f"WITH {EV} SELECT px, t, round_even(v / 2, 0) AS half FROM ev")
def p24(spark, d):
    return tables.event_series(spark, d).select("px", "t", F.rint(F.col("v") / 2).alias("half"))


@query(
    "fn_dates",
    f"""WITH {SCENES} SELECT scene, CAST(year(acq_date) * 1000 + dayofyear(acq_date) AS INTEGER) AS year_day, CAST(acq_date AS VARCHAR) AS back,
            CAST(year(acq_date) AS VARCHAR) || '-' || CAST(month(acq_date) AS VARCHAR) || '-' || CAST(day(acq_date) AS VARCHAR) AS unpadded,
            CAST(dayofyear(make_date(year(acq_date), 12, 31)) AS INTEGER) AS days_in_year, CASE WHEN scene % 7 <> 0 THEN CAST(acq_date AS VARCHAR) END AS parsed
        FROM scn""",
)
def fn_dates(spark, d):
    from terraloom.functions.dates import days_in_year, parse_date, unpadded

    day = F.col("acq_date")
    number = temporal.year_day(day)
    written = [F.date_format(day, f"yyyy{sep}MM{sep}dd") for sep in "-. "]
    text = F.when(F.col("scene") % 7 == 0, "no date").when(F.col("scene") % 3 == 0, written[0]).when(F.col("scene") % 3 == 1, written[1]).otherwise(written[2])
    return tables.scene_dates(spark, d).select(
        "scene", number.alias("year_day"), temporal.from_year_day(number).cast("string").alias("back"), unpadded(day).alias("unpadded"), days_in_year(day).alias("days_in_year"), parse_date(text).cast("string").alias("parsed")
    )


@query(
    "fn_strings",
    f"""WITH {NAMES} SELECT name, 'http://host/' || split_part(name, '.', 1) || '/' || name AS url, regexp_extract(name, 'A([0-9]{{7}})', 1) AS token, replace(name, '.hdf', '.tif') AS renamed,
            printf('%s.weights.%.2f_%.2f', split_part(name, '.', 1), 1.0, 0.5) AS fit_name FROM nam""",
)
def fn_strings(spark, d):
    from terraloom.functions.names import join_url

    name = F.col("name")
    return tables.file_names(spark, d).select(
        "name", join_url(F.lit("http://host/"), F.split_part(name, F.lit("."), F.lit(1)), name).alias("url"), F.regexp_extract(name, "A([0-9]{7})", 1).alias("token"),
        F.replace(name, F.lit(".hdf"), F.lit(".tif")).alias("renamed"), F.format_string("%s.weights.%.2f_%.2f", F.split_part(name, F.lit("."), F.lit(1)), F.lit(1.0), F.lit(0.5)).alias("fit_name"),
    )
