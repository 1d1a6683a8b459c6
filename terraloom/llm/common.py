"""What the training-data operators share: scratch tables, row identities, batch helpers."""

from __future__ import annotations

import gc
import hashlib
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id inside the operators: null ids count as one id that precedes all others.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``. Only a session on one machine (tests) may leave that unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/terraloom-{uuid.uuid4().hex}"


#: Scratch tables of this session that are still there.
_WRITTEN: set[str] = set()


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it again: lineage ends here, lost executors cost nothing. What an
    operator itself no longer needs it forgets; the rest is for ``clear`` once results are written."""
    path = scratch_dir(df.sparkSession)
    _WRITTEN.add(path)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def forget(spark: SparkSession, *written: DataFrame) -> None:
    """Delete scratch tables that nothing lazy reads any more, and let the driver notice which shuffles are over."""
    _delete(spark, [df.scratch_path for df in written])
    release(spark, 1)


def clear(spark: SparkSession) -> None:
    """Delete all scratch tables of this session. Results that are not written yet can't be read afterwards."""
    _delete(spark, list(_WRITTEN))


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _WRITTEN.discard(p)


def release(spark: SparkSession, times: int = 2) -> None:
    """Let the driver notice which shuffles are over: their files stay on the executors' disks until it has collected its
    garbage. The first time may come while listeners still hold the last query, so large shuffles are worth some seconds."""
    for k in range(times):
        if k:
            time.sleep(k)
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def with_id(docs: DataFrame, *keep: str) -> DataFrame:
    """``did`` (never null), ``text`` (never null) and the columns named; clashing extra columns go."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("did"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        *keep,
    )


def quoted(name: str) -> Column:
    """A column by its exact name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def doc_id() -> Column:
    return F.when(F.col("did") != NULL_ID, F.col("did")).alias("doc_id")


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def byte_size(df: DataFrame, column: str = "text") -> int:
    """Bytes of a text column over all rows: one cheap JVM scan that sizes buckets and shards."""
    return int(df.select(F.sum(F.octet_length(column)).alias("b")).first()["b"] or 0)
