"""A corpus pipeline: quality rules, line deduplication, near-duplicate removal, secret masking, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvex.llm import line_dedup, near_dup, packing, quality, secrets
from corvex.llm._common import stage, table


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text, which a stage has changed."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.char_length("text").cast(kind))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep(docs)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are in ten documents or more go; every document stays."""
    return _counted(line_dedup.dedup(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return near_dup.keep(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to marks; every document stays."""
    return _counted(secrets.redact(docs))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents in windows of 4096 tokens."""
    return packing.digests(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("drop_common_lines", drop_common_lines),
    ("drop_near_duplicates", drop_near_duplicates),
    ("mask_secrets", mask_secrets),
    ("pack_windows", pack_windows),
]

#: SQL can't express the robust estimates, nor tokens; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
