"""Joins without exchanges, shape files in parts, lines cell by cell, windows over gaps, times that are no dates."""

import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.operators import rasterise, temporal, window_fit
from terraloom.plans import join_queries
from terraloom.sources import shapes, stores


@pytest.mark.parametrize("query", [join_queries.j01b, join_queries.j02b])
def test_bucketed_tables_meet_without_an_exchange(spark, sf_dir, query):
    out = query(spark, sf_dir)
    assert out.count() > 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    by_pixel = out.groupBy("px").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in by_pixel


def test_shape_files_are_read_in_parts_with_the_box_pushed_down(spark):
    path = stores.scratch(spark)
    rows = [(i, [(float(i), float(-i))]) for i in range(50)] + [(100 + i, [(float(i), 0.0), (float(i) + 5, 9.0), (2.0, 3.0)]) for i in range(20)]
    shapes.write(spark.createDataFrame(rows, "id long, points array<struct<x: double, y: double>>").coalesce(1), path)
    every = shapes.read(spark, path, records=8)
    assert every.rdd.getNumPartitions() == 7 + 3  # ranges of eight records of two files
    assert sorted((r["id"], [tuple(p) for p in r["points"]]) for r in every.collect()) == sorted(rows)
    box = (10.0, -15.0, 20.0, 1.0)
    got = shapes.read(spark, path, box, records=8)
    meets = lambda p: max(x for x, _ in p) >= box[0] and min(x for x, _ in p) <= box[2] and max(y for _, y in p) >= box[1] and min(y for _, y in p) <= box[3]
    assert sorted(r["id"] for r in got.collect()) == sorted(i for i, p in rows if meets(p))
    reader = shapes.Reader({"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual

    assert [type(f) for f in reader.pushFilters([GreaterThanOrEqual(("x_max",), 10.0), EqualTo(("id",), 3)])] == [EqualTo] and len(reader.tests) == 1


def touched(u0, v0, u1, v1):
    """Cells whose half-open square has a point of the segment, tested one by one."""
    found = []
    for row in range(min(v0, v1).__floor__() - 1, max(v0, v1).__floor__() + 2):
        for col in range(min(u0, u1).__floor__() - 1, max(u0, u1).__floor__() + 2):
            lo, hi, lo_in, hi_in = Fraction(0), Fraction(1), True, True
            for a, d, k in ((u0, u1 - u0, col), (v0, v1 - v0, row)):
                if not d:
                    if not k <= a < k + 1:
                        lo, hi = Fraction(2), Fraction(1)
                    continue
                first, last = sorted(((k - a) / d, (k + 1 - a) / d))
                first_in, last_in = d > 0, d < 0
                if first > lo or first == lo and not first_in:
                    lo, lo_in = first, first_in
                if last < hi or last == hi and not last_in:
                    hi, hi_in = last, last_in
            if lo < hi or lo == hi and lo_in and hi_in:
                found.append(((lo, hi), (row, col)))
    return [cell for _, cell in sorted(found)]


def test_traversal_equals_intersection():
    r = random.Random(6)
    number = lambda: Fraction(r.randrange(-12, 40), r.choice((1, 1, 2, 3, 7)))
    for _ in range(400):
        segment = [number() / 3 for _ in range(4)]
        assert rasterise.traversed(*segment) == touched(*segment)
    assert rasterise.traversed(*map(Fraction, (0, 0, 2, 2))) == [(0, 0), (1, 1), (2, 2)]
    assert rasterise.traversed(*map(Fraction, (2, 0, 0, 2))) == [(0, 2), (0, 1), (1, 1), (1, 0), (2, 0)]


def test_lines_without_coordinates_cross_no_cell(spark):
    lines = spark.createDataFrame([(1, None, 0.0, 1.0, 1.0), (2, 1.0, 1.0, 1.0, 1.0)], "fid long, x1 double, y1 double, x2 double, y2 double")
    assert [tuple(r) for r in rasterise.line_cells(lines, 10.0, 0.0, 10.0).collect()] == [(2, 0, 0, 0)]


def test_windows_over_a_missing_epoch_go(spark):
    rows = [(1, t, float(t), 1.0) for t in range(40) if t != 20] + [(2, t, float(t), 1.0) for t in range(39)]
    df = spark.createDataFrame(rows, "px long, t int, v double, w double")
    out = window_fit.over_series(df, ("px",), lambda v, w: {"a0": window_fit.coefficients(window_fit.around(v), window_fit.around(w))[0]}, ["a0"])
    got = {(r["px"], r["t"]): r["a0"] for r in out.collect()}
    assert {t for p, t in got if p == 1} == {*range(7, 13), *range(28, 33)} and {t for p, t in got if p == 2} == set(range(7, 32))
    assert all(np.isclose(a, t) for (_, t), a in got.items())


def test_times_that_are_no_dates_are_refused(spark):
    days = spark.range(1).select(F.current_date().alias("e"))
    with pytest.raises(TypeError):
        temporal.around(spark.range(1).select(F.current_timestamp().alias("a")), days, "a", "e")
