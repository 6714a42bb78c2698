"""The corpus pipeline: documents in, documents fit for training out, with their tokens.

Each stage of STAGES takes (spark, documents, sf_dir) and gives documents with the columns it got,
the last one with tokens, n_tokens and round_trip (whether the tokens decode to the text) besides.
Rows without doc_id are near copies of nothing and stay unless their text is bad; of rows that repeat
a doc_id all go or none. Other columns are kept as they are, whatever their names; empty tables give
empty results.
There is no ORACLE_SQL: quality and personal data are learned, which SQL doesn't express.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.llm import bpe, decontaminate, near_dedup, pii, quality
from siftwork.llm.common import forget, unused, written

ORACLE_SQL = None


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs without those whose doc_id is in dropped; columns keep their order."""
    name = unused("dropped_id", docs)
    gone = dropped.where("doc_id is not null").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality, as learned from all labels."""
    return quality.good(docs, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, at the similarity of op1."""
    found = near_dedup.near_duplicates(docs, shingle_words=3, percent=85)
    return _without(docs, found.where(~F.col("kept")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with [KIND] in place of personal data."""
    return pii.masked(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their tokens."""
    return bpe.encoded(docs).withColumn("round_trip", F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).drop("decoded")


STAGES = [
    ("quality", keep_good),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("pii", mask_personal_data),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
