"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next stage's documents; all but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.llm import language, line_dedup, near_join, packing, substring_dedup
from terraloom.llm.common import stored


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars``, where the documents have it, is that of the text as it now is."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in no language that can be told go."""
    return language.accepted(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of at least 20 code points that three or more documents share stay in the last of them only."""
    return _counted(line_dedup.dedup(docs).drop("_n_lines", "_n_dropped"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each class of similar documents stays."""
    return near_join.dedup(docs)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words and more stay in the first document that has them; what loses all its words goes."""
    return _counted(substring_dedup.dedup(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences."""
    return packing.packed(docs)


STAGES = [
    ("language ID", language_id),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", drop_passages),
    ("best-fit packing", pack),
]

#: No stage but line dedup can be told in SQL; tests/llm/test_pipeline.py holds the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
