"""ESRI shape files as a data source that is read in parts: the index file says where records are, so a file is as many
tasks as it has ranges of records, and a bounding box given as filters on the records' boxes is applied while reading.

Files are opened where tasks run, so their folder has to be one that all executors see (a mounted store).
"""

from __future__ import annotations

import glob
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from terraloom.sources.stores import shapes_of

SCHEMA = "file string, fid long, id long, x_min double, y_min double, x_max double, y_max double, points array<struct<x: double, y: double>>"
#: Records of a task, and of a batch.
RECORDS, BATCH = 100_000, 4096
_BOX = ("x_min", "y_min", "x_max", "y_max")
_TESTS = {GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal}


@dataclass
class Part(InputPartition):
    """Records ``first`` to ``last`` - 1 of a file."""

    file: str
    first: int
    last: int


def _ids(file: str, first: int, last: int) -> list[int | None]:
    """The numeric attribute ``Id`` of records, from the table beside a shape file; without one none."""
    table = file[:-4] + ".dbf"
    if not os.path.exists(table):
        return [None] * (last - first)
    with open(table, "rb") as f:
        head = f.read(32)
        start, size = struct.unpack_from("<2H", head, 8)
        at, where = 1, None
        for _ in range((start - 33) // 32):
            field = f.read(32)
            if field[:11].split(b"\0")[0].lower() == b"id":
                where = slice(at, at + field[16])
            at += field[16]
        f.seek(start + first * size)
        rows = f.read((last - first) * size)
    told = [rows[i * size : (i + 1) * size][where].strip() for i in range(last - first)] if where else [b""] * (last - first)
    return [int(float(x)) if x else None for x in told]


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.records, self.tests = options["path"].removeprefix("file://"), int(options.get("records", RECORDS)), []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _TESTS and f.attribute[0] in _BOX:
                self.tests.append((f.attribute[0], type(f).__name__, float(f.value)))
            else:
                yield f

    def partitions(self) -> list[Part]:
        files = [self.path] if self.path.endswith(".shp") else sorted(glob.glob(os.path.join(glob.escape(self.path), "**", "*.shp"), recursive=True))
        parts = []
        for file in files:
            n = (os.path.getsize(file[:-4] + ".shx") - 100) // 8
            parts += [Part(file, i, min(n, i + self.records)) for i in range(0, n, self.records)]
        return parts

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        with open(partition.file[:-4] + ".shx", "rb") as f:
            f.seek(100 + 8 * partition.first)
            index = np.frombuffer(f.read(8 * (partition.last - partition.first)), ">i4").reshape(-1, 2).astype(np.int64) * 2
        tests = {k.__name__: t for k, t in _TESTS.items()}
        with open(partition.file, "rb") as f:
            for lo in range(0, len(index), BATCH):
                ends = index[lo : lo + BATCH]
                f.seek(ends[0, 0])
                found = shapes_of(bytes(100) + f.read(int(ends[-1, 0] + ends[-1, 1] + 8 - ends[0, 0])))
                ids = dict(zip(range(partition.first + lo + 1, partition.first + lo + len(ends) + 1), _ids(partition.file, partition.first + lo, partition.first + lo + len(ends)), strict=True))
                boxes = {c: np.array([pick(p[axis] for p in points) for _, points in found]) for c, pick, axis in zip(_BOX, (min, min, max, max), (0, 1, 0, 1), strict=True)}
                kept = np.ones(len(found), bool)
                for column, test, value in self.tests:
                    kept &= tests[test](boxes[column], value)
                rows = [found[i] for i in np.flatnonzero(kept)]
                points = pa.array([[{"x": x, "y": y} for x, y in p] for _, p in rows], pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([partition.file] * len(rows), pa.string()), pa.array([n for n, _ in rows], pa.int64()), pa.array([ids.get(n) for n, _ in rows], pa.int64()), *(pa.array(boxes[c][kept], pa.float64()) for c in _BOX), points],
                    names=["file", "fid", "id", *_BOX, "points"],
                )


class Shapes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shapes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def read(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, records: int = RECORDS) -> DataFrame:
    """Shapes below ``path``, of those whose boxes meet (x0, y0, x1, y1)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Shapes)
    df = spark.read.format("shapes").option("records", records).load(path)
    return df if box is None else df.where((F.col("x_max") >= box[0]) & (F.col("x_min") <= box[2]) & (F.col("y_max") >= box[1]) & (F.col("y_min") <= box[3]))


def write(df: DataFrame, path: str) -> None:
    """Write ``df`` (id, points: array of x, y) as shape files with index and attribute table, one per task: a row of one point as a
    point, others as lines. Tasks that run again write the same file again."""
    folder = path.removeprefix("file://")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = [r for b in batches for r in b.to_pylist()]
        for kind, name in ((1, "points"), (3, "lines")):
            own = [r for r in rows if (len(r["points"]) == 1) == (kind == 1)]
            if not own:
                continue
            bodies = []
            for r in own:
                p = [(q["x"], q["y"]) for q in r["points"]]
                xs, ys = zip(*p, strict=True)
                flat = [v for q in p for v in q]
                bodies.append(struct.pack("<i2d", 1, *p[0]) if kind == 1 else struct.pack(f"<i4d3i{len(flat)}d", 3, min(xs), min(ys), max(xs), max(ys), 1, len(p), 0, *flat))
            every = [(q["x"], q["y"]) for r in own for q in r["points"]]
            xs, ys = zip(*every, strict=True)
            head = lambda size: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, size // 2) + struct.pack("<2i8d", 1000, kind, min(xs), min(ys), max(xs), max(ys), 0, 0, 0, 0)  # noqa: E731, B023
            starts = np.cumsum([100, *(8 + len(b) for b in bodies)])
            base = os.path.join(folder, f"{name}-{TaskContext.get().partitionId():05d}")
            os.makedirs(folder, exist_ok=True)
            files = {
                ".shp": head(int(starts[-1])) + b"".join(struct.pack(">2i", i, len(b) // 2) + b for i, b in enumerate(bodies, 1)),
                ".shx": head(100 + 8 * len(bodies)) + b"".join(struct.pack(">2i", int(s) // 2, len(b) // 2) for s, b in zip(starts, bodies, strict=False)),
                ".dbf": struct.pack("<4BI2H20x", 3, 100, 1, 1, len(own), 65, 19) + b"Id".ljust(11, b"\0") + b"N" + bytes(4) + bytes([18, 0]) + bytes(14) + b"\r" + b"".join(b" " + str(r["id"]).rjust(18).encode() for r in own) + b"\x1a",
            }
            for end, data in files.items():
                with open(f"{base}{end}.tmp", "wb") as f:
                    f.write(data)
                os.replace(f"{base}{end}.tmp", base + end)
        yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64())], names=["n"])

    df.select(F.col("id").cast("long").alias("id"), "points").mapInArrow(run, "n long").agg(F.sum("n")).collect()
