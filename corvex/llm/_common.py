"""What the operators of this subpackage share: table access, staging in the shared folder, Arrow helpers."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch that are Python objects at one time, and bytes of their texts, beyond which a row is alone.
STEP, STEP_BYTES = 256, 8 << 20
#: The characters that separate words: space and the ASCII controls from tab to carriage return.
BLANK = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir of the session.

    Where it is unset, a local master gets a temporary folder; on a cluster that is an error, as a machine's own
    folder can't be read by the others.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="corvex-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found if ":/" in found else f"file://{found}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/corvex/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: it is computed once, and its lineage ends."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Frees the disks of shuffles that no plan refers to any more, as after ``stage`` and one more job.

    Executors drop such files when the driver's JVM has collected the plans; left alone, that is whenever its heap is full.
    The last job's plan is still referred to.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def slices(batch: pa.RecordBatch, step: int = STEP, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """batch in parts of at most ``step`` rows, and of at most ``most`` bytes of text unless a row alone has more."""
    if batch.nbytes <= most:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
        return
    sizes = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
            sizes += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        room = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))
        to = min(at + step, max(room, at + 1))
        yield batch.slice(at, to - at)
        at = to


def utf8(column: pa.Array) -> list[bytes]:
    """The texts' bytes; a null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


#: Bytes of a scanned table that one task of an explicit repartition gets, about.
TASK_BYTES = 128 << 20


def partitions_for(spark: SparkSession, of: DataFrame | None = None) -> int:
    """Partitions for an explicit repartition: spark.sql.shuffle.partitions, and more if the scanned files of ``of`` are large."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if of is None:
        return n
    size = int(str(of._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(n, -(-size // TASK_BYTES)) if size < 1 << 60 else n
