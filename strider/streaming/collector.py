"""The result collector as a stream: counts by status, snapshots each micro-batch, restart from a checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def results(spark: SparkSession, path: str, schema: str, files_each: int | None = None) -> DataFrame:
    """A stream of Parquet result files; `files_each` bounds a micro-batch."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_each) if files_each else reader).parquet(path)


def status_counts(stream: DataFrame) -> DataFrame:
    return stream.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("time").alias("time"))


def collect(counts: DataFrame, checkpoint: str, snapshot: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Run over all that is there and stop; started again with the same checkpoint it goes on from where it was."""
    return counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(snapshot).start()


def windowed(stream: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """An extra: counts by event time with a watermark."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size), "status").agg(F.count(F.lit(1)).alias("n"))
