"""Views of the test tables as the raster model: series, grids, scenes, points, lines, file names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.operators import spatial
from terraloom.schema import DATA_FILL, QUALITY_FILL


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(column: str):
    return F.datediff(F.col(column).cast("date"), F.lit("1992-01-01").cast("date"))


def supplier_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """px, t, value, qual: a series per supplier over 8-day epochs without gaps, fill values where nothing was shipped.
    The quality code comes from the number of shipments."""
    cells = (
        read(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("px"), F.floor(day("l_shipdate") / 8).cast("int").alias("epoch"))
        .agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"), F.count("*").alias("n"))
    )
    extent = cells.agg(F.min("epoch").alias("lo"), F.max("epoch").alias("hi"))
    axis = cells.select("px").distinct().crossJoin(F.broadcast(extent)).select("px", "lo", F.explode(F.sequence("lo", "hi")).alias("epoch"))
    value = F.least(F.rint(F.col("cents") / F.col("n") / 1000.0), F.lit(float(DATA_FILL)))
    code = (
        F.when(F.col("n").isNull(), QUALITY_FILL)
        .when((F.col("px") + F.col("epoch")) % 17 == 0, 4)
        .when((F.col("px") + F.col("epoch")) % 11 == 0, 3)
        .when(F.col("n") >= 3, 0)
        .when(F.col("n") == 2, 1)
        .otherwise(2)
    )
    # joined by a shuffle, so that tasks are cut by the cells' size, not by that of the list of suppliers
    dense = axis.join(cells.hint("merge"), ["px", "epoch"], "left")
    return dense.select("px", (F.col("epoch") - F.col("lo")).cast("int").alias("t"), F.coalesce(value, F.lit(float(DATA_FILL))).cast("int").alias("value"), code.cast("int").alias("qual"))


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """px, t, v: a series per user over the days of the events, NULL on days without."""
    cells = (
        read(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("px"), F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("t"))
        .agg(F.sum(F.round(F.col("value") * 1000).cast("long")).alias("s"), F.count("*").alias("n"))
    )
    axis = cells.select("px").distinct().select("px", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("t"))
    return axis.join(cells.hint("merge"), ["px", "t"], "left").select("px", "t", F.rint(F.col("s") / F.col("n") / 100.0).alias("v"))


def part_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row, col, value, mask: the parts as a raster of 50 columns with a cloud mask (0 outside, 2 cloud)."""
    mask = F.when(F.col("p_partkey") % 23 == 0, 0).when(F.col("p_size") == 7, 2).otherwise(1)
    return read(spark, sf_dir, "part").select(
        F.floor(F.col("p_partkey") / 50).cast("int").alias("row"), (F.col("p_partkey") % 50).cast("int").alias("col"), F.round(F.col("p_retailprice") * 100).cast("long").cast("double").alias("value"), mask.alias("mask")
    )


def scene_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene, id, x, y: per return flag and line number, quantities against days of transport as a pair to regress."""
    x = F.col("l_quantity")
    y = F.col("l_quantity") * 2 + F.col("l_linenumber") + (F.col("l_orderkey") % 13)
    return read(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_returnflag", "l_linenumber").alias("scene"), F.col("l_orderkey").alias("id"), x.alias("x"), y.cast("double").alias("y"))


def scene_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene, acq_date: the orders as scenes."""
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scene"), F.col("o_orderdate").cast("date").alias("acq_date"))


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """epoch_date: the first days of the 8-day epochs in which anything was shipped."""
    e = F.floor(day("l_shipdate") / 8).cast("int")
    return read(spark, sf_dir, "lineitem").select(F.date_add(F.lit("1992-01-01").cast("date"), e * 8).alias("epoch_date")).distinct()


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name: file names such as a product archive has, made of the orders' keys and dates."""
    o = read(spark, sf_dir, "orders")
    return o.select(
        F.concat(
            F.when(F.col("o_orderkey") % 2 == 0, "MCD43A4").otherwise("MCD43A2"), F.lit(".A"), F.date_format(F.col("o_orderdate").cast("date"), "yyyyDDD"),
            F.lit(".h"), F.lpad((F.col("o_custkey") % 3 + 17).cast("string"), 2, "0"), F.lit("v04.006."),
            (F.col("o_orderkey") % 5 + 2015000).cast("string"), F.when(F.col("o_orderkey") % 10 == 3, ".jpg").otherwise(".hdf"),
        ).alias("name")
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fid, x, y: the customers as points of interest."""
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("fid"), F.col("c_acctbal").alias("x"), ((F.col("c_custkey") * 37) % 10000).cast("double").alias("y"))


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tile, x0, y0, res, n_rows, n_cols: the nations as tiles of 40 x 40 cells side by side."""
    n = F.col("n_nationkey")
    return read(spark, sf_dir, "nation").select(
        F.col("n_name").alias("tile"), (n % 5 * 2000).cast("double").alias("x0"), (F.floor(n / 5) * 2000 + 2000).cast("double").alias("y0"), F.lit(50.0).alias("res"), F.lit(40).alias("n_rows"), F.lit(40).alias("n_cols")
    )


def points_with_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fid, tile, px: points with the pixel of the tile's 40 x 40 cells that they are in."""
    placed = spatial.points_on_grid(points(spark, sf_dir), grids(spark, sf_dir), 2000.0)
    return placed.select("fid", "tile", (F.col("row") * 40 + F.col("col")).alias("px"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fid, x1, y1, x2, y2: the suppliers as transects over the parts' raster, in all four directions."""
    k = F.col("s_suppkey")
    x1, y1 = (k % 50 * 10 + 3).cast("double"), (k * 17 % 40 * 10 + 7).cast("double")
    return read(spark, sf_dir, "supplier").select(k.alias("fid"), x1.alias("x1"), y1.alias("y1"), (x1 + (k % 7 - 3) * 41).alias("x2"), (y1 + (k % 5 - 2) * 63).alias("y2"))


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """px, epoch, band, value: quantities by supplier, month and line number, as seven bands with gaps."""
    return (
        read(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("px"), F.trunc(F.col("l_shipdate").cast("date"), "quarter").alias("epoch"), F.col("l_linenumber").alias("band"))
        .agg(F.sum(F.col("l_quantity").cast("long")).alias("value"))
    )
