"""Sources of documents: tables, JDBC, and paragraphs of text files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvex.sources.files import scratch


def table(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    return spark.read.format(fmt).options(**options).load(path)


def jdbc(spark: SparkSession, url: str, name: str, *, key: str | None = None, low: int | None = None, high: int | None = None, parts: int = 1, **options) -> DataFrame:
    """A table of a database, read in parallel by ranges of a numeric key if its bounds are given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    if key is not None and low is not None and high is not None and parts > 1:
        reader = reader.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()


def numbered(rows: DataFrame, order: list[str], name: str = "doc_id", start: int = 0, folder: str | None = None, *, dealt: bool = False, then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """rows with the numbers start + 1, start + 2, ... in the given order, without gathering them in one task.

    Rows are range-partitioned, sorted and written to a folder with their places, so that the numbers are the same each
    time that the result is evaluated, also if executors are lost. Only each partition's size comes to the driver.
    dealt: they are partitioned by ranges of the order already. then: what is done to the rows before they are written.
    """
    spark, folder = rows.sparkSession, folder or scratch(rows.sparkSession, "numbered")
    placed = (rows if dealt else rows.repartitionByRange(*order)).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    placed = then(placed) if then else placed
    placed.write.parquet(folder)
    placed = spark.read.schema(placed.schema).parquet(folder).withColumn("_part", F.shiftright("_place", 33))
    at, firsts = start + 1, []
    for p, c in sorted((r["_part"], r["count"]) for r in placed.groupBy("_part").count().collect()):
        firsts.append((p, at))
        at += c
    known = F.broadcast(spark.createDataFrame(firsts, "_part long, _first long"))  # a row for each partition
    number = F.col("_first") + F.col("_place").bitwiseAND((1 << 33) - 1)
    return placed.join(known, "_part").withColumn(name, number).drop("_part", "_place", "_first")


def paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and doc of the paragraphs of a text file, which blank lines separate, numbered from 1."""
    rows = spark.read.option("lineSep", "\n\n").text(path).select(F.trim(F.regexp_replace("value", r"\s+", " ")).alias("doc"), F.monotonically_increasing_id().alias("_at"))
    return numbered(rows.filter("doc != ''"), ["_at"]).select("doc_id", "doc")
