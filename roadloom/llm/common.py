"""Helpers the corpus operators share: landed tables, checked broadcasts, hashes, ASCII case."""

from __future__ import annotations

import gc
import string
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.session import landing_path

#: rows of at most about 100 bytes that a broadcast may have (some 20 MB)
BROADCAST_ROWS = 200_000


def landed(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back.

    Cuts the lineage (an executor lost later costs no recomputation), and Spark then knows
    the size of the table when it plans the joins that follow.
    """
    path = landing_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Gives what a Python worker's Arrow pool has freed back to the system.

    Workers outlive their tasks, so what one keeps counts against the steps that follow.
    """
    import pyarrow

    pyarrow.default_memory_pool().release_unused()


def discard(*tables: DataFrame) -> None:
    """Deletes landed tables once what was made of them is landed itself."""
    spark = tables[0].sparkSession
    jvm = spark.sparkContext._jvm
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    forget_finished(spark)


def forget_finished(spark: SparkSession) -> None:
    """Full collections: the driver lets go of plans and results of finished steps, and Spark drops their shuffle files.

    The last query is still referred to during the first one, so its files go after the second only.
    """
    gc.collect()
    for pause in (0.3, 0.1):
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a landed table for broadcast if its counted rows allow it; else Spark decides."""
    return F.broadcast(df) if df.count() <= rows else df


def ascii_lower(c: Column | str) -> Column:
    """A-Z to a-z; every other character stays as it is."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def wide_hash(*cols: Column | str) -> Column:
    """128 bits as a struct of two longs."""
    return F.struct(
        F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit("second half"), *cols).alias("b")
    )
