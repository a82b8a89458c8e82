"""A dense index over any sort order, without one task that sorts all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stored import stored


def indexed(df: DataFrame, keys: list[str], out: str = "index", pieces: int | None = None) -> DataFrame:
    """Adds `out`: positions 0 to n - 1 in the order of `keys`, which may be texts.

    Spark samples the splitters of key ranges; rows are numbered inside their range, the result is stored, and the
    counts of the ranges before, one row for each, are added. Rows of equal keys share a range: end the keys with
    something that tells rows apart. Null keys come first.
    """
    n = pieces or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    schema = df.schema.simpleString()[len("struct<") : -1]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(np.arange(at, at + b.num_rows))], [*b.schema.names, "__part", "__place"])
            at += b.num_rows

    placed = stored(sorted_.mapInArrow(number, f"{schema}, __part: int, __place: bigint"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    first = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    return placed.join(F.broadcast(first), "__part").select(*df.columns, (F.col("__first") + F.col("__place")).alias(out))  # `pieces` rows at most
