"""What queries of calibrated scenes hand to the driver: relations of fixed size only, and coefficients without residuals."""

import pytest

import __spark_entry__ as entry
from terraloom.plans import calibration

#: Rows of the largest relation that may be broadcast: scenes, bands and methods are few, blocks and cells are many.
FEW = 64


def _broadcasts(spark, run):
    """Rows of each relation that ``run`` broadcasts."""
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    began = {store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())}
    run()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    held, rows = store.executionsList(), []
    for i in (held.apply(k).executionId() for k in range(held.size())):
        if i in began:
            continue
        values, nodes = store.executionMetrics(i), store.planGraph(i).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            if node.name().startswith("BroadcastExchange"):
                for metric in (node.metrics().apply(k) for k in range(node.metrics().size())):
                    told = values.get(metric.accumulatorId())
                    if metric.name() == "number of output rows" and told.isDefined():
                        rows.append(int(told.get().replace(",", "")))
    return rows


@pytest.mark.parametrize("name", ["f10c_calibrated_scenes", "f10c_g05_differences", "f10c_k06_scene_report"])
def test_relations_on_the_driver_are_of_fixed_size(spark, sf_dir, name):
    rows = _broadcasts(spark, lambda: entry.queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    assert rows and max(rows) <= FEW


def test_coefficients_are_those_of_the_lines(spark):
    rows = [("a", 1, float(i), 2.0 * i + i % 3) for i in range(1, 40)] + [("a", 2, 5.0, float(i)) for i in range(9)] + [("b", 1, float(i), 7.0 - i) for i in range(5)]
    found = spark.createDataFrame(rows, "scene string, scene_band int, x double, y double")
    names = ("scene", "scene_band", "method", "n", "b0", "b1")
    alone, whole = (sorted(map(tuple, df.select(*names).collect())) for df in (calibration.coefficients(found), calibration.lines(found)))
    assert [r[:4] for r in alone] == [("a", 1, "odr", 39), ("a", 1, "ols", 39), ("b", 1, "odr", 5), ("b", 1, "ols", 5)]
    assert [r[:4] for r in whole] == [r[:4] for r in alone] and [x for r in whole for x in r[4:]] == pytest.approx([x for r in alone for x in r[4:]])
