"""Tables that are dealt out by pixel once, when they are written: joins and groups by pixel then move nothing.

A raster's data, quality and bands share the number of buckets and the key, so data meet their quality, seven bands meet in
a stack, and series meet their windows within the bucket that a task reads. Buckets are hashes of the pixel, so no product,
tile or epoch makes one larger than others.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from terraloom.sources.stores import scratch

#: Whether partitions by a part of a join's keys will do, as buckets by pixel do for joins by pixel and epoch.
PARTIAL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def write(df: DataFrame, buckets: int, keys: Sequence[str] = ("px",), order: Sequence[str] = (), path: str | None = None, name: str | None = None) -> str:
    """Write ``df`` as a table of ``buckets`` buckets by ``keys``, rows of a bucket sorted by them and ``order``; the table's name. Rows are
    dealt out beforehand, so there is one file per bucket, written by one task."""
    name = name or f"bucketed_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, *keys)
    dealt.write.bucketBy(buckets, *keys).sortBy(*keys, *order).option("path", path or scratch(df.sparkSession)).saveAsTable(name)
    return name


def read(spark: SparkSession, name: str) -> DataFrame:
    spark.conf.set(PARTIAL_KEYS, "false")
    return spark.table(name)
