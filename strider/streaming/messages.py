"""One stream of typed worker messages: repeats are dropped, kinds go to sinks of their own, done marks end the run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: A message; `seq` numbers a worker's messages.
MESSAGE = "kind string, worker string, seq long, at timestamp, clip string, status string, time double, text string"
#: Columns of each sink.
SINKS = {"result": ["worker", "seq", "clip", "status", "time"], "error": ["worker", "seq", "kind", "clip", "text"], "done": ["worker", "seq", "at"]}


def messages(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """MESSAGE columns of a stream, each (worker, seq) once, as long as a repeat comes within `late` of the first.

    Messages without worker, seq or time cannot be told apart and are left out; a kind that no sink has counts as an error.
    """
    told = stream.select(*(F.col(c.split()[0]) for c in MESSAGE.split(", "))).na.drop(subset=["worker", "seq", "at"])
    return told.withWatermark("at", late).dropDuplicatesWithinWatermark(["worker", "seq"])


def route(found: DataFrame, checkpoint: str, path: str) -> StreamingQuery:
    """Write all that is there to a folder of `path` for each sink, and stop; with the same checkpoint it goes on.

    A micro-batch has a folder of its own in every sink and replaces it, so one that runs again after a failure writes
    the same rows once.
    """
    known = F.col("kind").isin(*SINKS)

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.withColumn("sink", F.when(known, F.col("kind")).otherwise("error")).persist()  # the state is read once
        try:
            for sink, columns in SINKS.items():
                batch.where(F.col("sink") == sink).select(*columns).write.mode("overwrite").parquet(f"{path}/{sink}/batch={number}")
        finally:
            batch.unpersist()

    return found.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def sink(spark: SparkSession, path: str, name: str) -> DataFrame:
    """What one sink holds: its columns and the batch."""
    types = dict(c.split() for c in MESSAGE.split(", "))
    return spark.read.schema(", ".join(f"{c} {types[c]}" for c in SINKS[name]) + ", batch long").parquet(f"{path}/{name}")


def missing(workers: DataFrame, done: DataFrame) -> DataFrame:
    """The workers that have sent no done mark; the run has ended when there are none."""
    return workers.select("worker").distinct().join(done.select("worker"), "worker", "left_anti")
