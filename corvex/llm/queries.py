"""The queries of this subpackage: each takes (spark, sf_dir) and covers its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvex.llm import ann, bpe, line_dedup, lm, near_dup, packing, quality, secrets, token_files, warc
from corvex.llm._common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"))


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(table(spark, sf_dir, "documents"), words=4)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digests(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"))


QUERIES = {"op1_bpe": op1_bpe, "op2_packing": op2_packing, "op3_secrets": op3_secrets, "op4_near_dup": op4_near_dup, "op5_line_dedup": op5_line_dedup, "op6_token_files": op6_token_files, "op7_warc": op7_warc, "op8_lm_scores": op8_lm_scores, "op9_neighbours": op9_neighbours, "op10_quality": op10_quality}

#: DuckDB SQL of those that SQL can express.
ORACLE: dict[str, str] = {"op4_near_dup": near_dup.classes_sql(words=4), "op5_line_dedup": line_dedup.digests_sql(), "op7_warc": warc.round_trip_sql()}
