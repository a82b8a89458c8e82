"""Cutting lineage through the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir for this application; on a cluster it must be named."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        context.setCheckpointDir(named or "/tmp/strider-checkpoints")
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """`df` computed once and written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
