"""Stores: the curve that rows are sorted along, boxes as its intervals, pieces that are redone and resumed."""

import random

import pytest
from pyspark.sql import functions as F

from terraloom.sources import stores


def place(r, c):
    return sum(((r >> i & 1) << (2 * i + 1)) | ((c >> i & 1) << (2 * i)) for i in range(16))


def test_curve(spark):
    r = random.Random(1)
    cells = [(r.randrange(1 << 16), r.randrange(1 << 16)) for _ in range(200)] + [(0, 0), (65535, 65535), (0, 65535)]
    got = spark.createDataFrame(cells, "row int, col int").select("row", "col", stores.morton(F.col("row"), F.col("col")).alias("z")).collect()
    assert all(x["z"] == place(x["row"], x["col"]) for x in got)


@pytest.mark.parametrize("most", [4, 64, 100_000])
def test_intervals_hold_the_box_and_nothing_else_if_there_may_be_enough(most):
    r = random.Random(2)
    for _ in range(30):
        row0, col0 = r.randrange(60), r.randrange(60)
        box = (row0, row0 + r.randrange(20), col0, col0 + r.randrange(20))
        spans = stores.box_intervals(box, most)
        inside = lambda z: any(lo <= z <= hi for lo, hi in spans)
        held = {(i, k) for i in range(90) for k in range(90) if inside(place(i, k))}
        want = {(i, k) for i in range(box[0], box[1] + 1) for k in range(box[2], box[3] + 1)}
        assert want <= held and len(spans) <= most
        if most == 100_000:
            assert held == want
    assert stores.box_intervals((0, 65535, 0, 65535)) == [(0, 2**32 - 1)]


def raster(spark, side=512, epochs=1):
    cells = spark.range(side * side * epochs).select(
        F.lit("raw").alias("fit_product"), F.lit("h18v04").alias("tile"), F.lit(1).alias("band"), F.lit(2000).alias("year"), F.floor(F.col("id") % (side * side) / side).cast("int").alias("row"), (F.col("id") % side).cast("int").alias("col"),
        F.lit("2000-02-26").cast("date").alias("epoch_date"), F.floor(F.col("id") / (side * side)).cast("int").alias("epoch_seq"), (F.xxhash64("id") % 5000 + 5000).cast("int").alias("value"),
    )
    return cells


@pytest.mark.parametrize("box", [(0, 511, 40, 47), (200, 207, 0, 511), (100, 115, 300, 315)])
def test_narrow_boxes_read_few_row_groups_in_both_directions(spark, tmp_path, box):
    path = str(tmp_path / "store")
    stores.write_pixels(raster(spark), path, row_group=64 * 1024)
    cut = stores.read_pixels(spark, path, box=box)
    assert len(cut.collect()) == (box[1] - box[0] + 1) * (box[3] - box[2] + 1)
    leaves = cut._jdf.queryExecution().executedPlan().collectLeaves()
    read = leaves.apply(0).metrics().apply("numOutputRows").value()
    assert read <= 0.35 * 512 * 512


def test_pieces_are_written_once_resumed_and_redone(spark, tmp_path):
    path, whole = str(tmp_path / "grown"), raster(spark, 8, 4)
    values = lambda: sorted((r["epoch_seq"], r["row"], r["col"], r["value"]) for r in stores.read_pieces(spark, path).collect())
    want = sorted((r["epoch_seq"], r["row"], r["col"], r["value"]) for r in whole.collect())
    with pytest.raises(ValueError):
        stores.read_pieces(spark, path)
    stores.add_pieces(whole.where("epoch_seq = 0"), path)
    first = stores.manifest(spark, path).collect()
    stores.add_pieces(whole.withColumn("value", F.lit(3)).where("epoch_seq = 1"), path, announce=False)  # broken off
    assert values() == [r for r in want if r[0] == 0]
    for _ in range(2):  # a repeated call changes nothing
        stores.add_pieces(whole, path)
        assert values() == want
    assert first[0] in stores.manifest(spark, path).collect()  # the complete piece was left alone
    stores.add_pieces(whole.withColumn("value", F.lit(3)).where("epoch_seq = 2"), path, redo=True, announce=False)
    assert values() == [r for r in want if r[0] != 2]  # being redone, broken off: not shown
    stores.add_pieces(whole, path)
    assert values() == want
