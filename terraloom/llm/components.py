"""Connected components by joins: nodes hook to their least neighbour, and the graph is contracted to what they hook to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.llm.common import forget, stored


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for every node of ``edges`` (a, b): the smallest node of its component.

    In each round every node points to its least neighbour, if that is smaller, and on to where that points. Both ends
    of all edges are replaced by what they point to; loops and repeated edges go, so that the graph shrinks from
    round to round and is empty after about log d of them, d the largest diameter, if the order of nodes is random.
    Nodes should be hashes therefore: along a path in the order of its nodes each round goes two steps only. Pointers
    are minima pre-aggregated in the map tasks, so a hub is harmless. Every round is a written table. Without edges
    the result is empty."""
    spark = edges.sparkSession
    left = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    known = table = None
    while True:
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        points = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b")).select("id", F.least("id", "b").alias("hop"))
        moved = stored(points.join(points.select(F.col("id").alias("hop"), F.col("hop").alias("to")), "hop").select("id", "to"))
        to_a, to_b = (moved.select(F.col("id").alias(c), F.col("to").alias(f"to_{c}")) for c in ("a", "b"))
        ends = left.join(to_a, "a").join(to_b, "b").where("to_a <> to_b")
        shrunk = stored(ends.select(F.greatest("to_a", "to_b").alias("a"), F.least("to_a", "to_b").alias("b")).distinct())
        done, over = shrunk.isEmpty(), [left]
        if known is None:
            known, table = moved.select("id", F.col("to").alias("label")), moved
        else:
            known = stored(known.join(moved.select(F.col("id").alias("label"), "to"), "label", "left").select("id", F.coalesce("to", "label").alias("label")))
            over, table = [*over, moved, table], known
        left = shrunk
        forget(spark, *over, *([left] if done else []))
        if done:
            return known
