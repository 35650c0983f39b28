"""Session helpers: where iterative jobs cut their lineage, and where files are landed."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; local sessions get their own."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        current = sc._jsc.sc().getCheckpointDir()
        folder = current.get() if current.isDefined() else None
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="roadloom-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and continue from the files."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def landing_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for files a job writes and reads back."""
    return f"{shared_dir(spark).rstrip('/')}/landing/{name}-{uuid.uuid4().hex[:12]}"
