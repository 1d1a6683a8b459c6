"""F10 in one chain: scenes in UTM against a fitted series on the reference grid, for all bands, from original cells to calibrated ones."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.operators import masks, projections, regress, robust, spatial, temporal
from terraloom.sources.stores import kept

KEYS = ("scene", "scene_band")


class Reference(NamedTuple):
    """A fitted series as a raster: its epochs (epoch_date), ``at``, which gives its cells (epoch_date, band, row, col, value) among
    those asked for (epoch_date, row, col; each once), the grid's corner and cell."""

    epochs: DataFrame
    at: Callable[[DataFrame], DataFrame]
    x0: float
    y0: float
    res: float

    @classmethod
    def of(cls, cells: DataFrame, x0: float, y0: float, res: float) -> Reference:
        """Of a raster that is there with all its cells."""
        return cls(cells.select("epoch_date").distinct(), lambda asked: cells.join(asked.hint("merge"), ["epoch_date", "row", "col"], "left_semi"), x0, y0, res)


def usable(scenes: DataFrame, epochs: DataFrame) -> DataFrame:
    """Scenes that are not older than the first fitted epoch."""
    first = epochs.agg(F.min("epoch_date").alias("_first"))  # one row
    return scenes.crossJoin(F.broadcast(first)).where("acq_date >= _first").drop("_first")


def blocks(scenes: DataFrame, cells: DataFrame, bands: Mapping[int, str], reference: Reference, size: int = 15) -> DataFrame:
    """(scene, row, col, a mean per band, p): a scene's cells brought to the reference grid ``size`` times finer, masked, and averaged
    over the reference cells, whose ``row`` and ``col`` these are; ``p`` is the blocks' weight. Blocks begin at the first
    whole reference cell; what is in the target grid but not in the scene counts as not covered."""
    fine = round(reference.res / size, 5)
    grids = kept(projections.target_grids(scenes, fine))
    down, right = projections.grid_offset(F.col("t_x0"), F.col("t_y0"), reference.x0, reference.y0, reference.res, size)
    placed = grids.select("scene", "t_x0", "t_y0", "t_rows", "t_cols", down.alias("_down"), right.alias("_right"))
    first = placed.select(
        "scene", "t_rows", "t_cols", "_down", "_right",
        F.rint((F.lit(reference.y0) - F.col("t_y0") + F.col("_down") * fine) / reference.res).cast("int").alias("_r0"), F.rint((F.col("t_x0") + F.col("_right") * fine - F.lit(reference.x0)) / reference.res).cast("int").alias("_c0"),
    )
    near = projections.on_grids(scenes, grids, cells, (*bands.values(), "mask"), fine).join(first, "scene").where("row >= _down AND col >= _right")
    inside = near.withColumn("_br", spatial.block_of(F.col("row") - F.col("_down"), size)).withColumn("_bc", spatial.block_of(F.col("col") - F.col("_right"), size))
    shares = inside.groupBy("scene", "_br", "_bc", "_r0", "_c0", "t_rows", "t_cols", "_down", "_right").agg(
        *(F.avg(masks.mask_out(F.col(c), F.col("mask"))).alias(c) for c in bands.values()), F.count_if(F.col("mask") == 2).alias("_cloud"), F.count_if(F.col("mask") != 0).alias("_seen")
    )
    n = F.least(F.lit(size), F.col("t_rows") - F.col("_down") - F.col("_br") * size) * F.least(F.lit(size), F.col("t_cols") - F.col("_right") - F.col("_bc") * size)
    cloud, cover = F.col("_cloud") / n, F.col("_seen") / n
    return shares.select("scene", (F.col("_br") + F.col("_r0")).alias("row"), (F.col("_bc") + F.col("_c0")).alias("col"), *bands.values(), F.when(cloud >= 1e-5, 0.0).otherwise(F.abs(cloud - cover)).alias("p"))


def pairs(scenes: DataFrame, cells: DataFrame, bands: Mapping[int, str], band_map: DataFrame, reference: Reference, size: int = 15) -> DataFrame:
    """(scene, scene_band, ref_band, row, col, x, y): blocks that are seen in full beside the 3 x 3 means of the reference's epoch
    nearest to the scene's day. The reference is asked for these blocks and their neighbours only. ``band_map`` (sensor, scene_band, ref_band) is a table of fixed size."""
    epochs = kept(reference.epochs)
    scenes = kept(usable(scenes, epochs))
    seen = kept(blocks(scenes, cells, bands, reference, size).where("p >= 1"))
    near = kept(temporal.nearest(scenes.select("scene", "sensor", "acq_date"), epochs, "acq_date", "epoch_date").select("scene", "sensor", F.col("nearest").alias("epoch_date")))
    around = lambda c: F.explode(F.array(*(F.col(c) + i for i in (-1, 0, 1)))).alias(c)
    asked = kept(seen.join(near, "scene").select("epoch_date", around("row"), "col").select("epoch_date", "row", around("col")).distinct())
    means = spatial.focal_mean(reference.at(asked), ("epoch_date", "band")).select("epoch_date", F.col("band").alias("ref_band"), "row", "col", F.col("focal").alias("y"))
    told = seen.select("scene", "row", "col", F.explode(F.array(*(F.struct(F.lit(b).alias("scene_band"), F.col(c).alias("x")) for b, c in bands.items()))).alias("_b")).select("scene", "row", "col", "_b.scene_band", "_b.x")
    mapped = told.join(near, "scene").join(F.broadcast(band_map), ["sensor", "scene_band"])
    # joined by a shuffle: the size that is reckoned with leaves out what explode makes
    return mapped.join(means.hint("merge"), ["epoch_date", "ref_band", "row", "col"]).where("x > 0 AND y > 0").select("scene", "scene_band", "ref_band", "row", "col", "x", "y")


def fits(left: DataFrame) -> DataFrame:
    """(scene, scene_band, method, n, b0, b1, r, r2): both regressions of ``left``, a row each; those without a slope go."""
    both = regress.lines(left, KEYS)
    one = (F.struct(F.lit(m).alias("method"), F.col(f"{m}_b0").alias("b0"), F.col(f"{m}_b1").alias("b1")) for m in ("ols", "odr"))
    return both.select(*KEYS, "n", "r", "r2", F.explode(F.array(*one)).alias("_f")).select(*KEYS, "_f.method", "n", "_f.b0", "_f.b1", "r", "r2").where("b1 IS NOT NULL")


def coefficients(found: DataFrame, alpha: float = 0.05) -> DataFrame:
    """``fits`` of what Grubbs' test leaves of ``pairs``, for those who don't ask for residuals. ``found`` is read twice."""
    return fits(robust.grubbs(found, KEYS, "x", alpha))


def lines(found: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(scene, scene_band, method, n, b0, b1, r, r2, residual statistics): both regressions of what Grubbs' test leaves of ``pairs``."""
    left = kept(robust.grubbs(kept(found), KEYS, "x", alpha))
    both, keys = kept(fits(left)), (*KEYS, "method")
    # each row once for either method, so that one plan tells the residuals of both
    rows = left.withColumn("method", F.explode(F.array(F.lit("ols"), F.lit("odr"))))
    return both.join(regress.residual_stats(rows, both, keys, "b0", "b1").drop("n"), list(keys))


def calibrated(cells: DataFrame, bands: Mapping[int, str], fitted: DataFrame, method: str = "odr") -> DataFrame:
    """(scene, scene_band, row, col, calibrated): original cells on the reference's scale, in 0..10000; scenes and bands without a line go."""
    told = cells.select("scene", "row", "col", F.explode(F.array(*(F.struct(F.lit(b).alias("scene_band"), F.col(c).cast("double").alias("value")) for b, c in bands.items()))).alias("_b"))
    one = kept(fitted.where(F.col("method") == method).select(*KEYS, "b0", "b1"))
    value = F.when(F.col("value") != 0, F.col("value"))
    return told.select("scene", "row", "col", "_b.scene_band", "_b.value").join(one, list(KEYS)).select(*KEYS, "row", "col", masks.calibrated_range(F.col("b0") + F.col("b1") * value).alias("calibrated"))


def difference(found: DataFrame, fitted: DataFrame, method: str = "odr") -> DataFrame:
    """(scene, scene_band, row, col, difference): the reference's means less the calibrated blocks."""
    one = kept(fitted.where(F.col("method") == method).select(*KEYS, "b0", "b1"))
    return found.join(one, list(KEYS)).select(*KEYS, "row", "col", (F.col("y") - masks.calibrated_block(F.col("b0") + F.col("b1") * F.col("x"))).alias("difference"))


def write_report(fitted: DataFrame, path: str) -> None:
    """The statistics as separated lists with a header, in a folder per scene."""
    fitted.repartition("scene").sortWithinPartitions("scene", "scene_band", "method").write.partitionBy("scene").option("sep", ";").csv(path, header=True)
