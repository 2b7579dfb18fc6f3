"""The folder that driver and executors share, and tables pinned there."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the folder set for checkpoints. A local session without either gets one of its own."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if path:
        return path
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="loomwork-"))
    return sc.getCheckpointDir()


def pinned(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder, for the steps of an iteration."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)
