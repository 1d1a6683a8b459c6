"""Reading and writing of pixel stores, lists, file inventories and shapes."""

from __future__ import annotations

import struct
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.operators.masks import floored, valid_or_fill
from terraloom.schema import DATA_FILL

#: Folders of a pixel store, coarse to fine.
LAYOUT = ("fit_product", "tile", "band", "year")


def scratch(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``. Only a session on one machine (tests) may leave that unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/store-{uuid.uuid4().hex}"
    _MADE.add(path)
    return path


#: Scratch folders of this session that are still there.
_MADE: set[str] = set()


def clear(spark: SparkSession) -> None:
    """Delete all scratch folders of this session. Results that are not written yet can't be read afterwards."""
    for path in list(_MADE):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        _MADE.discard(path)


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared scratch folder and read again, for what later steps read more than once."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _spread(n: Column) -> Column:
    """The lower 16 bits of a number with a zero between each two."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        n = n.bitwiseOR(F.shiftleft(n, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return n


def morton(row: Column, col: Column) -> Column:
    """Place of a cell on the Z-shaped curve, along which cells that are close by are close in both directions. Rasters of up to 65,536
    rows and columns."""
    return F.shiftleft(_spread(row.cast("long")), 1).bitwiseOR(_spread(col.cast("long")))


def box_intervals(box: tuple[int, int, int, int], most: int = 64) -> list[tuple[int, int]]:
    """Intervals of the curve, ``most`` at most, that hold all cells of a box (row0, row1, col0, col1; both ends included): squares in the
    box are whole intervals, squares on its edge are quartered, the largest first, as long as there may be more intervals."""
    row0, row1, col0, col1 = box

    def place(r: int, c: int) -> int:
        return sum(((r >> i & 1) << (2 * i + 1)) | ((c >> i & 1) << (2 * i)) for i in range(16))

    def inside(r: int, c: int, side: int) -> int:
        """2: wholly, 1: partly, 0: not."""
        if r > row1 or r + side <= row0 or c > col1 or c + side <= col0:
            return 0
        return 2 if row0 <= r and r + side - 1 <= row1 and col0 <= c and c + side - 1 <= col1 else 1

    whole, partly = [], [(0, 0, 1 << 16)] if inside(0, 0, 1 << 16) else []
    while partly and len(whole) + len(partly) < most:
        r, c, side = partly.pop(0)
        half = side // 2
        if inside(r, c, side) == 2 or not half:
            whole.append((r, c, side))
            continue
        partly += [q for q in ((r, c, half), (r, c + half, half), (r + half, c, half), (r + half, c + half, half)) if inside(*q)]
    spans = sorted((place(r, c), place(r, c) + side * side - 1) for r, c, side in [*whole, *partly])
    out: list[tuple[int, int]] = []
    for lo, hi in spans:
        if out and lo == out[-1][1] + 1:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


#: Places on the curve that one task writes at most: a square of 256 x 256 cells.
SQUARE = 1 << 16


def _laid_out(df: DataFrame, layout: Sequence[str], domain: str | None, grid: dict | None) -> DataFrame:
    """``df`` in its domain, with ``z``, dealt out by folder and square, sorted along the curve."""
    if domain:
        df = df.withColumn("value", (valid_or_fill if domain == "valid" else floored)(F.col("value")).cast("short"))
    df = df.withColumn("value", F.col("value").alias("value", metadata={"no_data": DATA_FILL, **(grid or {})})).withColumn("z", morton(F.col("row"), F.col("col")))
    return df.repartition(*layout, F.floor(F.col("z") / SQUARE)).sortWithinPartitions(*layout, "z", "epoch_date")


def write_pixels(df: DataFrame, path: str, layout: Sequence[str] = LAYOUT, domain: str | None = "valid", mode: str = "overwrite", grid: dict | None = None, row_group: int | None = None) -> None:
    """Write pixels in folders by ``layout``, rows of a folder sorted along a Z-shaped curve over the raster so that windowed reads skip
    row groups in both directions. ``domain``: 'valid' turns values outside 0..9999 into fill, 'floored' negative ones into 0.
    Folders are dealt out by key and square of the raster, so a folder as large as a tile spreads over tasks. ``grid``:
    projection, corner, size of the raster, kept with the fill value in the schema of the column ``value``. ``row_group``: bytes."""
    writer = _laid_out(df, layout, domain, grid).write.mode(mode).partitionBy(*layout)
    (writer.option("parquet.block.size", row_group) if row_group else writer).parquet(path)


#: Columns that name a piece of a store that grows; what is written, redone or resumed is a whole piece.
PIECES = ("fit_product", "tile", "band", "year", "epoch_seq")


def add_pieces(df: DataFrame, path: str, pieces: Sequence[str] = PIECES, domain: str | None = "valid", redo: bool = False, announce: bool = True) -> None:
    """Write the pieces of ``df`` (epochs of a product, tile and band) that the store at ``path`` doesn't have yet, or with ``redo`` all.

    Pieces replace folders of their own; those of other pieces stay. When they are there, a manifest is told of each with the name of
    this run, which its rows have too. A piece that is in the folders but not in the manifest, or with another run's name, was
    interrupted: readers pass over it, and the next call writes it again. So calls may be repeated or broken off at any point.
    ``announce`` False breaks off there."""
    spark, run = df.sparkSession, uuid.uuid4().hex
    rows = df.drop("run")
    if not redo:
        known = manifest(spark, path, pieces)
        rows = rows if known is None else rows.join(known.join(_held(spark, path, pieces), [*pieces, "run"]).select(*pieces), list(pieces), "left_anti").select(rows.columns)
    out = _laid_out(rows.withColumn("run", F.lit(run)), pieces, domain, None).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*pieces)
    out.parquet(f"{path}/pixels")
    if announce:
        told = _held(spark, path, pieces).where(F.col("run") == run)
        told.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*pieces).parquet(f"{path}/manifest")


def _there(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/*=*")))


def _held(spark: SparkSession, path: str, pieces: Sequence[str]) -> DataFrame:
    """The pieces in the folders: run and number of rows."""
    return spark.read.parquet(f"{path}/pixels").groupBy(*pieces, "run").agg(F.count("*").alias("n"))


def manifest(spark: SparkSession, path: str, pieces: Sequence[str] = PIECES) -> DataFrame | None:
    """(pieces, run, n) of the pieces that are complete; None before the first."""
    if not _there(spark, f"{path}/manifest"):
        return None
    return spark.read.parquet(f"{path}/manifest").select(*pieces, "run", "n")


def read_pieces(spark: SparkSession, path: str, pieces: Sequence[str] = PIECES) -> DataFrame:
    """The rows of complete pieces."""
    known = manifest(spark, path, pieces)
    if known is None:
        raise ValueError(f"{path} holds no complete piece")
    return spark.read.parquet(f"{path}/pixels").join(known.select(*pieces, "run"), [*pieces, "run"]).drop("run", "z")


def grid_of(df: DataFrame) -> dict:
    """What a store was told of the grid of its pixels, and their fill value."""
    return dict(df.schema["value"].metadata)


def read_pixels(spark: SparkSession, path: str, since: int | None = None, until: int | None = None, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Pixels of a store, cut to epochs since..until and to rows and columns (row0, row1, col0, col1), both ends included; all
    cuts reach the Parquet scan. A box is also told as intervals of the curve that rows are sorted along."""
    df = spark.read.parquet(path)
    if since is not None:
        df = df.where(F.col("epoch_seq") >= since)
    if until is not None:
        df = df.where(F.col("epoch_seq") <= until)
    if box:
        df = df.where(F.col("row").between(box[0], box[1]) & F.col("col").between(box[2], box[3]))
        if "z" in df.columns:
            spans = F.lit(False)
            for lo, hi in box_intervals(box):
                spans = spans | F.col("z").between(lo, hi)
            df = df.where(spans)
    return df


def copy_years(spark: SparkSession, source: str, target: str, first: int, last: int, layout: Sequence[str] = LAYOUT) -> None:
    """Copy the folders of some years from store to store."""
    spark.read.parquet(source).where(F.col("year").between(first, last)).write.mode("append").partitionBy(*layout).parquet(target)


def read_list(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """A separated list with a header; the nameless column that a trailing separator makes goes."""
    df = spark.read.option("sep", sep).option("inferSchema", True).csv(path, header=True)
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c and not (c.startswith("_c") and c[2:].isdigit())))


def inventory(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, name, length, modified of all files below ``path``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.col("modificationTime").alias("modified"))


def sub_datasets(name: Column) -> Column:
    """(first, last, type) of the seven band data sets inside a granule: quality products keep bytes further back."""
    quality = F.split_part(name, F.lit("."), F.lit(1)).endswith("A2")
    return F.when(quality, F.struct(F.lit(11).alias("first"), F.lit(17).alias("last"), F.lit("byte").alias("type"))).otherwise(F.struct(F.lit(7).alias("first"), F.lit(13).alias("last"), F.lit("int16").alias("type")))


def shapes_of(data: bytes) -> list[tuple[int, list[tuple[float, float]]]]:
    """(record number, points) of the points and polylines of an ESRI shape file."""
    out, at = [], 100
    while at + 12 <= len(data):
        number, words = struct.unpack_from(">2i", data, at)
        kind = struct.unpack_from("<i", data, at + 8)[0]
        if kind in (1, 11, 21):
            out.append((number, [struct.unpack_from("<2d", data, at + 12)]))
        elif kind in (3, 13, 23):
            parts, n = struct.unpack_from("<2i", data, at + 44)
            start = at + 52 + 4 * parts
            out.append((number, [struct.unpack_from("<2d", data, start + 16 * i) for i in range(n)]))
        at += 8 + 2 * words
    return out


def read_shapes(spark: SparkSession, path: str) -> DataFrame:
    """file, fid, points (array of x, y) of the shape files below ``path``: one row per point or line. Files are read by Spark,
    one task each; a shape file holds 2 GB at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
        for b in batches:
            for file, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = shapes_of(data)
                pts = [[{"x": x, "y": y} for x, y in p] for _, p in found]
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(found), pa.string()), pa.array([n for n, _ in found], pa.int64()), pa.array(pts, kind)], names=["file", "fid", "points"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.shp").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInArrow(run, "file string, fid long, points array<struct<x: double, y: double>>")


def read_points(spark: SparkSession, path: str) -> DataFrame:
    p = F.col("points")[0]
    return read_shapes(spark, path).where(F.size("points") == 1).select("fid", p["x"].alias("x"), p["y"].alias("y"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines by their end points."""
    a, b = F.col("points")[0], F.element_at("points", -1)
    return read_shapes(spark, path).where(F.size("points") > 1).select("fid", a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))
