"""Lines on grids, cell by cell, as a table function."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql.functions import udtf


def traversed(u0: Fraction, v0: Fraction, u1: Fraction, v1: Fraction) -> list[tuple[int, int]]:
    """(row, col) of all cells that the segment from (u0, v0) to (u1, v1) has a point in, in its order; a cell holds its upper and left
    edge. Exact: the places where the segment meets a grid line cut it into pieces, and each cut and each piece is in one cell."""

    def cuts(a: Fraction, b: Fraction) -> Iterator[Fraction]:
        if a != b:
            yield from (Fraction(k - a) / (b - a) for k in range(math.ceil(min(a, b)), math.floor(max(a, b)) + 1))

    at = sorted({Fraction(0), Fraction(1), *cuts(u0, u1), *cuts(v0, v1)})
    at = sorted([*at, *((a + b) / 2 for a, b in zip(at, at[1:], strict=False))])
    cells = ((math.floor(v0 + (v1 - v0) * t), math.floor(u0 + (u1 - u0) * t)) for t in at)
    return list(dict.fromkeys(cells))


@udtf(returnType="step int, row int, col int")
class RasteriseLine:
    """(step, row, col) of the cells of side ``res`` that a line crosses on a north-up grid with upper-left corner (x0, y0)."""

    def eval(self, x1: float, y1: float, x2: float, y2: float, res: float, x0: float, y0: float):
        if any(v is None or not math.isfinite(v) for v in (x1, y1, x2, y2)):
            return
        size = Fraction(res)
        col, row = (lambda x: (Fraction(x) - Fraction(x0)) / size), (lambda y: (Fraction(y0) - Fraction(y)) / size)
        for step, (r, c) in enumerate(traversed(col(x1), row(y1), col(x2), row(y2))):
            yield step, r, c


def line_cells(lines: DataFrame, res: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """(fid, step, row, col) of all lines (fid, x1, y1, x2, y2)."""
    spark = lines.sparkSession
    spark.udtf.register("rasterise_line", RasteriseLine)
    return spark.sql("SELECT fid, step, row, col FROM {lines}, LATERAL rasterise_line(x1, y1, x2, y2, CAST({res} AS DOUBLE), CAST({x0} AS DOUBLE), CAST({y0} AS DOUBLE))", lines=lines, res=res, x0=x0, y0=y0)
