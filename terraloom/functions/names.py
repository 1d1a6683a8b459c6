"""File names of product archives as columns: ``product.AYYYYDDD.tile.collection.version.ext``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(name: Column) -> dict[str, Column]:
    token = lambda i: F.split_part(name, F.lit("."), F.lit(i))
    epoch, tile = token(2), token(3)
    return {
        "product": token(1),
        "epoch": epoch,
        "year": F.substring(epoch, 2, 4).cast("int"),
        "doy": F.substring(epoch, 6, 3).cast("int"),
        "epoch_date": F.to_date(F.substring(epoch, 2, 7), "yyyyDDD"),
        "tile": tile,
        "h": F.substring(tile, 2, 2).cast("int"),
        "v": F.substring(tile, 5, 2).cast("int"),
        "collection": token(4),
        "version": token(5),
        "ext": token(6),
    }


def join_url(*pieces: Column) -> Column:
    """Pieces joined by single slashes."""
    return F.concat_ws("/", *(F.rtrim(p, F.lit("/")) for p in pieces))


def fit_name(name: Column, algorithm: str, weights: tuple[float, ...]) -> Column:
    """Name of a fitted raster: the input's without its extension, the algorithm and its weights."""
    return F.concat(F.regexp_replace(name, r"\.[^.]+$", ""), F.lit(f".{algorithm}.weights." + "_".join(f"{w:g}" for w in weights)), F.lit(".tif"))
