"""Named shards against the rule in plain Python: names, sizes, order, and what failed or repeated runs leave."""

import io
import math
import os

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from strider.sources import shards


def _read(folder, name):
    return pq.ParquetFile(io.BytesIO((folder / name).read_bytes())).read().to_pylist()


def test_shards_are_named_full_and_sorted(spark, tmp_path):
    rows = [(f"class_{k * 7 % 5}", f"{k:04d}", float(k)) for k in range(103)] + [(None, None, None), ("class_1", "0003", -1.0)]
    df = spark.createDataFrame(rows, "action_class string, shard string, v double").repartition(6)
    assert shards.write_named(df, str(tmp_path), "train", ["action_class", "shard"], bytes_each=400, bytes_row=16) == 5
    assert sorted(os.listdir(tmp_path)) == [f"train-{k:05d}-of-00005.parquet" for k in range(5)]
    got = [_read(tmp_path, f) for f in sorted(os.listdir(tmp_path))]
    assert [len(x) for x in got] == [25, 25, 25, 25, 5]
    back = [tuple(r.values()) for x in got for r in x]
    key = lambda r: tuple((x is not None, x or "") for x in r[:2])
    assert [key(r) for r in back] == sorted(map(key, rows)) and sorted(back, key=str) == sorted(rows, key=str)
    assert spark.read.parquet(str(tmp_path)).columns == df.columns


def test_size_comes_from_the_first_rows(spark, tmp_path):
    df = spark.range(1000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h"))
    first = df.orderBy("id").limit(100).toArrow()
    each = int(20_000 / shards.bytes_of(first))
    assert shards.write_named(df, str(tmp_path), "val", ["id"], bytes_each=20_000) == math.ceil(1000 / each)
    assert len(_read(tmp_path, sorted(os.listdir(tmp_path))[0])) == each


def test_splits_lie_beside_each_other_and_are_replaced_only_if_asked(spark, tmp_path):
    df, path = spark.range(10), str(tmp_path)
    shards.write_named(df, path, "train", ["id"], bytes_each=5, bytes_row=1)
    shards.write_named(df, path, "val", ["id"], bytes_each=5, bytes_row=1)
    with pytest.raises(Exception, match="overwrite them"):
        shards.write_named(df, path, "val", ["id"], bytes_each=5, bytes_row=1)
    shards.write_named(df, path, "val", ["id"], bytes_each=10, bytes_row=1, overwrite=True)
    assert sorted(os.listdir(path)) == ["train-00000-of-00002.parquet", "train-00001-of-00002.parquet", "val-00000-of-00001.parquet"]


def test_failed_tasks_and_empty_tables_leave_nothing(spark, tmp_path):
    path = str(tmp_path)
    assert shards.write_named(spark.range(0), path, "train", ["id"]) == 0 and os.listdir(path) == []

    @F.pandas_udf("long")
    def broken(v: pd.Series) -> pd.Series:
        if (v >= 15).any():
            raise ValueError("broken row")
        return v

    # one task, four rows a batch: three shards are written when it fails
    spark.dataSource.register(shards.NamedShards)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        plan = spark.range(0, 20, 1, 1).select(F.floor(F.col("id") / 5).alias("shard"), broken("id").alias("v"))
        with pytest.raises(Exception, match="broken row"):
            plan.write.format("named_shards").options(split="train", shards=4, column="shard").mode("append").save(path)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert os.listdir(path) == []
    with pytest.raises(ValueError, match="not a name"):
        shards.write_named(spark.range(1), path, "../x", ["id"])


def test_a_task_that_ran_twice_counts_once(tmp_path):
    sink = shards.ShardWriter(str(tmp_path), "train", 2, "shard", False)
    batch = pa.RecordBatch.from_pydict({"v": [1.0, 2.0, 3.0], "shard": pa.array([0, 0, 1], pa.int64())})
    sink.write(iter([batch]))
    assert len(os.listdir(tmp_path / sink.hidden)) == 2 and not sink.older()
    sink.commit([sink.write(iter([batch])), None])
    assert sorted(os.listdir(tmp_path)) == ["train-00000-of-00002.parquet", "train-00001-of-00002.parquet"]
    assert _read(tmp_path, "train-00000-of-00002.parquet") == [{"v": 1.0}, {"v": 2.0}]
