"""Queries of sources and sinks (S, K): written to the shared scratch folder and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraloom.functions.names import fit_name
from terraloom.plans import pipelines
from terraloom.plans.catalog import NAMES, PX, query, sql_fit, sql_series, sql_steps, sql_windows, steps
from terraloom.schema import DATA_FILL, WEIGHTS
from terraloom.sources import stores, tables
from terraloom.streaming import sliding

#: Epochs that arrive at once in the stream of all series; files that one batch reads.
SPAN, SPAN_FILES = 46, 64


def _pixels(spark, d):
    """The suppliers' series as pixels of two tiles, seven bands' layout and a raster of 40 columns."""
    s = tables.supplier_series(spark, d)
    day = F.date_add(F.lit("1995-01-01").cast("date"), F.col("t") * 8)
    return s.select(
        F.lit("raw").alias("fit_product"), F.when(F.col("px") % 2 == 0, "h18v04").otherwise("h18v03").alias("tile"), F.lit(1).alias("band"), F.year(day).alias("year"), F.col("px").cast("int").alias("px"),
        F.floor(F.col("px") / 40).cast("int").alias("row"), (F.col("px") % 40).cast("int").alias("col"), day.alias("epoch_date"), F.col("t").alias("epoch_seq"), "value", "qual",
    )


@query(
    "s01_s05_k01_pixel_store",
    f"""WITH {PX} SELECT CASE WHEN px % 2 = 0 THEN 'h18v04' ELSE 'h18v03' END AS tile, CAST(px AS INTEGER) AS px, t AS epoch_seq, CASE WHEN value <= 9999 THEN value ELSE {DATA_FILL} END AS value
        FROM px WHERE t BETWEEN 10 AND 60 AND px // 40 = 0 AND px % 40 BETWEEN 2 AND 20""",
)
def s01(spark, d):
    path = stores.scratch(spark)
    stores.write_pixels(_pixels(spark, d), path)
    cut = stores.read_pixels(spark, path, 10, 60, (0, 0, 2, 20))
    return cut.select("tile", "px", "epoch_seq", F.col("value").cast("int").alias("value"))


@query("k02_floored_year_store", f"WITH {PX} SELECT CAST(px AS INTEGER) AS px, t AS epoch_seq, CAST(CASE WHEN value = 32767 THEN 32767 ELSE greatest(value - 900, 0) END AS INTEGER) AS value FROM px")
def k02(spark, d):
    path = stores.scratch(spark)
    shifted = _pixels(spark, d).withColumn("value", F.when(F.col("value") != DATA_FILL, F.col("value") - 900))
    stores.write_pixels(shifted, path, domain="floored")
    return spark.read.parquet(path).select("px", "epoch_seq", F.col("value").cast("int").alias("value"))


@query("k09_p22_copied_years", f"WITH {PX} SELECT CAST(px AS INTEGER) AS px, t AS epoch_seq FROM px WHERE year(DATE '1995-01-01' + 8 * t) BETWEEN 1996 AND 1998")
def k09(spark, d):
    source, target = stores.scratch(spark), stores.scratch(spark)
    stores.write_pixels(_pixels(spark, d), source)
    stores.copy_years(spark, source, target, 1996, 1998)
    return spark.read.parquet(target).select("px", "epoch_seq")


@query("k01b_k02_resumed_store", f"WITH {PX} SELECT CAST(px AS INTEGER) AS px, t AS epoch_seq, CASE WHEN value <= 9999 THEN value ELSE {DATA_FILL} END AS value FROM px")
def k01b(spark, d):
    """A store that grows by years: some are there, writing others was broken off with wrong values, one has to be redone."""
    path, whole = stores.scratch(spark), _pixels(spark, d)
    years, wrong = ("fit_product", "tile", "band", "year"), whole.withColumn("value", F.lit(1))
    stores.add_pieces(whole.where("year <= 1996").unionByName(wrong.where("year = 1997")), path, years)
    stores.add_pieces(wrong.where("year BETWEEN 1998 AND 1999"), path, years, announce=False)
    stores.add_pieces(whole, path, years)
    stores.add_pieces(whole.where("year = 1997"), path, years, redo=True)
    return stores.read_pieces(spark, path, years).select("px", "epoch_seq", F.col("value").cast("int").alias("value"))


@query("s07_k06_separated_lists", "SELECT r_regionkey AS key, r_name AS name FROM region")
def s07(spark, d):
    path = stores.scratch(spark)
    tables.read(spark, d, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("_c2")).write.option("sep", ";").csv(path, header=True)
    return stores.read_list(spark, path)


@query("s09_file_inventory", f"WITH {PX} SELECT DISTINCT CASE WHEN px % 2 = 0 THEN 'h18v04' ELSE 'h18v03' END AS tile, CAST(year(DATE '1995-01-01' + 8 * t) AS INTEGER) AS year FROM px")
def s09(spark, d):
    path = stores.scratch(spark)
    stores.write_pixels(_pixels(spark, d), path)
    return stores.inventory(spark, path, "*.parquet").select(F.regexp_extract("path", "tile=([^/]*)/", 1).alias("tile"), F.regexp_extract("path", "year=([0-9]*)/", 1).cast("int").alias("year")).distinct()


@query(
    "s04_p15_sub_datasets",
    f"WITH {NAMES}, f AS (SELECT DISTINCT name FROM nam) SELECT name, CASE WHEN name LIKE 'MCD43A2.%' THEN 'byte' ELSE 'int16' END AS type, unnest(CASE WHEN name LIKE 'MCD43A2.%' THEN generate_series(11, 17) ELSE generate_series(7, 13) END)::INTEGER AS dataset FROM f",
)
def s04(spark, d):
    f = tables.file_names(spark, d).distinct().withColumn("s", stores.sub_datasets(F.col("name")))
    return f.select("name", "s.type", F.explode(F.sequence("s.first", "s.last")).alias("dataset"))


@query("k13_fit_names", f"WITH {NAMES} SELECT name, replace(replace(name, '.hdf', ''), '.jpg', '') || '.poly_lin_win15.weights.1_0.5_0.01_0.01.tif' AS fit_name FROM nam")
def k13(spark, d):
    return tables.file_names(spark, d).select("name", fit_name(F.col("name"), "poly_lin_win15", (1.0, 0.5, 0.01, 0.01)).alias("fit_name"))


@query(
    "s16_random_cube",
    "SELECT px, CAST(t AS INTEGER) AS t, CAST((px * 15 + t) * 48271 % 2147483647 % 10000 AS INTEGER) AS value FROM (SELECT CAST(s_suppkey AS BIGINT) AS px, unnest(generate_series(0, 14)) AS t FROM supplier)",
)
def s16(spark, d):
    """A cube of random reflectances: 15 epochs of a pixel per supplier, the same each time."""
    cells = tables.read(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("px"), F.explode(F.sequence(F.lit(0), F.lit(14))).alias("t"))
    return cells.select("px", "t", ((F.col("px") * 15 + F.col("t")) * 48271 % 2147483647 % 10000).cast("int").alias("value"))


def _streamed(spark, d, weights):
    """The series as a stream of files: spans of epochs arrive one after the other, each in files dealt by series."""
    staged, source = stores.scratch(spark), stores.scratch(spark)
    pipelines.masked(tables.supplier_series(spark, d), weights).withColumn("span", F.floor(F.col("t") / SPAN)).write.partitionBy("span").parquet(staged)
    rows = spark.read.parquet(staged)
    for (span,) in rows.select("span").distinct().orderBy("span").collect():
        rows.where(F.col("span") == span).drop("span").repartition("px").write.mode("append").parquet(source)
    return sliding.run_once(spark, source, stores.scratch(spark), stores.scratch(spark), files_per_batch=SPAN_FILES, lag=SPAN).where("not late")


_MEANS = f"""WITH {PX}, w AS (SELECT px, t, avg(CASE WHEN value <> 32767 THEN value END) OVER a AS mean, count(*) OVER a AS n FROM px WINDOW a AS (PARTITION BY px ORDER BY t ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING))
    SELECT px, t, CAST(floor(mean * 100 + 0.37129) AS BIGINT) AS mean FROM w WHERE n = 15"""
_STREAMED = WEIGHTS["poly_lin"]


@query("s02_streamed_windows", _MEANS)
def s02(spark, d):
    """The sliding window as a stream: epochs arrive as files, the state holds fifteen of them."""
    return _streamed(spark, d, _STREAMED).select("px", "t", steps(F.col("mean")).alias("mean"))


@query("s02c_streamed_windows_of_all_series", f"WITH {sql_series(_STREAMED)}, {sql_windows()}, {sql_fit('win', 'c1')} SELECT px, t, {sql_steps('a0', 10)} AS fit FROM c1")
def s02c(spark, d):
    """The weighted parabola at the centre of each streamed window."""
    return _streamed(spark, d, _STREAMED).select("px", "t", steps(F.col("fit"), 10).alias("fit"))


@query(
    "k03_grid_metadata",
    f"WITH {PX} SELECT 463.3127::DOUBLE AS res, CAST(max(px // 40) + 1 AS INTEGER) AS n_rows, CAST(max(px % 40) + 1 AS INTEGER) AS n_cols, 32767 AS no_data, 'sinusoidal' AS projection, count(*) AS n FROM px",
)
def k03(spark, d):
    """The grid that a store's pixels belong to, as large as these ask for, is kept in the store's schema and comes back with it."""
    path, pixels = stores.scratch(spark), _pixels(spark, d)
    size = pixels.agg((F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols")).first()
    stores.write_pixels(pixels, path, grid={"projection": "sinusoidal", "res": 463.3127, **size.asDict()})
    back = stores.read_pixels(spark, path)
    g = stores.grid_of(back)
    return back.agg(F.count("*").alias("n")).select(*(F.lit(g[c]).alias(c) for c in ("res", "n_rows", "n_cols", "no_data", "projection")), "n")


_CATALOGUE = ", ".join(f"('{n}', {', '.join(f'{x!r}::DOUBLE' for x in w)}, {15 if n in ('poly_lin', 'lin_poly', 'sg_fft_poly', 'poly') else 46})" for n, w in WEIGHTS.items())


@query(
    "fn_fit_catalogue",
    f"""WITH {PX}, c(product, w0, w1, w2, w3, width) AS (VALUES {_CATALOGUE}), s AS (SELECT px, count(*) AS n FROM px GROUP BY px)
        SELECT px, product, w0, w1, w2, w3, width, CAST(CASE WHEN width = 15 THEN greatest(n - 14, 0) ELSE n // 46 * 46 END AS BIGINT) AS fitted FROM s, c""",
)
def fn_fit_catalogue(spark, d):
    """What each product of the catalogue makes of each series: its weights, its width, and the number of epochs that it fits."""
    known = pipelines.catalogue(spark).select("product", *(F.col("weights")[i].alias(f"w{i}") for i in range(4)), "width")  # six rows
    series = tables.supplier_series(spark, d).groupBy("px").agg(F.count("*").alias("n"))
    fitted = F.when(F.col("width") == 15, F.greatest(F.col("n") - 14, F.lit(0).cast("long"))).otherwise(F.floor(F.col("n") / 46) * 46)
    return series.crossJoin(F.broadcast(known)).select("px", "product", "w0", "w1", "w2", "w3", "width", fitted.cast("long").alias("fitted"))
