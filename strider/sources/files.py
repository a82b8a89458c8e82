"""File sources: listings, caption files, clip archives, skeleton texts; and sinks for shards and blobs."""

from __future__ import annotations

import io
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Arrays of a clip archive and their Spark types.
CLIP_FIELDS = {
    "indices": "array<int>",
    "bboxes": "array<array<float>>",
    "keypoints2d": "array<array<array<float>>>",
    "scores2d": "array<array<float>>",
    "pose3d": "array<array<array<float>>>",
    "meta": "array<float>",
    "density_ok": "boolean",
    "dynamic_ok": "boolean",
    "quality": "float",
    "has_hard_cuts": "boolean",
    "hard_cut_frames": "array<int>",
}
CLIP_SCHEMA = "clip_id string, action_class string, " + ", ".join(f"{k} {t}" for k, t in CLIP_FIELDS.items()) + ", error string"
_DEFAULTS = {"density_ok": True, "dynamic_ok": True, "quality": 1.0, "has_hard_cuts": False, "hard_cut_frames": [], "pose3d": []}


def listing(spark: SparkSession, root: str, pattern: str = "*.mp4", offset: int = 0, limit: int | None = None) -> DataFrame:
    """Paths below `root` in order, with class (parent folder) and stem; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root).select("path")
    out = files.select("path", F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("class"), F.regexp_extract("path", "([^/]+)\\.[^./]+$", 1).alias("stem")).orderBy("path")
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def caption_files(spark: SparkSession, root: str) -> DataFrame:
    """class, stem and the whole text of caption files."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(root, wholetext=True)
    path = F.input_file_name()
    return raw.select(F.regexp_extract(path, "([^/]+)/[^/]+$", 1).alias("class"), F.regexp_extract(path, "([^/]+)\\.txt$", 1).alias("stem"), F.col("value").alias("caption"))


def _value(array: np.ndarray, kind: str):
    if kind.startswith("array"):
        return np.where(np.isnan(array), None, array).tolist() if array.dtype.kind == "f" else array.tolist()
    return array.reshape(-1)[0].item() if array.size else None


def clips(spark: SparkSession, root: str) -> DataFrame:
    """Clip archives as nested rows. Missing arrays take their defaults, NaN becomes null, and an
    archive that cannot be read gives a row with `error` instead of failing the job."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", True).load(root).select("path", "content")
    schema = T._parse_datatype_string(CLIP_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = path.rstrip("/").split("/")
                row = dict.fromkeys(schema.names) | {"clip_id": parts[-1].removesuffix(".npz"), "action_class": parts[-2] if len(parts) > 1 else None}
                try:
                    with np.load(io.BytesIO(content), allow_pickle=False) as z:
                        pose = "pose3d" if "pose3d" in z else "pose_3d"
                        for k, kind in CLIP_FIELDS.items():
                            name = pose if k == "pose3d" else k
                            row[k] = _value(z[name], kind) if name in z else _DEFAULTS.get(k)
                except (ValueError, OSError, KeyError, zlib.error) as e:
                    row["error"] = f"{type(e).__name__}: {e}"[:200]
                except Exception as e:  # a broken zip file has an error class of its own
                    if type(e).__name__ != "BadZipFile":
                        raise
                    row["error"] = f"BadZipFile: {e}"[:200]
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.mapInArrow(run, schema)


def skeletons(df: DataFrame, text_col: str = "value") -> DataFrame:
    """frame, body, joint, x, y, z, state from nested counted skeleton texts, one text a row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch[text_col]:
                lines = iter((text or "").split("\n"))
                for frame in range(int(next(lines, "0").strip() or 0)):
                    for body in range(int(next(lines, "0").strip() or 0)):
                        next(lines, "")
                        for joint in range(int(next(lines, "0").strip() or 0)):
                            v = next(lines, "").split()
                            if len(v) >= 4:
                                rows.append((frame, body, joint, *map(float, v[:3]), float(v[-1])))
            yield pd.DataFrame(rows, columns=["frame", "body", "joint", "x", "y", "z", "state"])

    return df.select(text_col).mapInPandas(run, "frame long, body long, joint long, x double, y double, z double, state double")


@F.pandas_udf(T.BinaryType())
def zipped(data: pd.Series) -> pd.Series:
    """zlib blob of bytes; Spark has no such function."""
    return data.map(lambda b: None if b is None else zlib.compress(b))


@F.pandas_udf(T.BinaryType())
def unzipped(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else zlib.decompress(b))


def blob(values: Column, kind: str = "<f4") -> Column:
    """Bytes of an array of doubles as float32, or another little-endian kind, zipped."""

    @F.pandas_udf(T.BinaryType())
    def raw(v: pd.Series) -> pd.Series:
        return v.map(lambda a: None if a is None else np.asarray(a, float).astype(kind).tobytes())

    return zipped(raw(values))


def write_clips(df: DataFrame, path: str) -> None:
    """Clip records in a folder for each action class; a class's clips are written together, a large class by several tasks."""
    df.repartition(F.col("action_class"), F.pmod(F.xxhash64("clip_id"), F.lit(16))).write.partitionBy("action_class").parquet(path)


def write_report(df: DataFrame, path: str, title: str) -> None:
    """A report's few rows as one JSON line each and as a Markdown table, in the folders json and markdown of `path`."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(c) for c in df.columns)), F.lit(" |"))
    head = f"# {title}\n\n| {' | '.join(df.columns)} |\n|{'-|' * len(df.columns)}"
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).coalesce(1).write.text(f"{path}/json")
    lines = df.agg(F.array_sort(F.collect_list(row)).alias("rows")).select(F.concat_ws("\n", F.lit(head), F.array_join("rows", "\n")).alias("value"))
    lines.write.text(f"{path}/markdown")


def write_shards(df: DataFrame, path: str, keys: list[str], bytes_each: int = 2 << 30, bytes_row: int | None = None) -> int:
    """Sorted Parquet files of about `bytes_each`; the size of a row is estimated from 100 rows. Returns the rows of a file."""
    if bytes_row is None:
        some = df.limit(100).toPandas()  # the estimate's sample
        bytes_row = max(1, int(some.memory_usage(deep=True, index=False).sum() / max(1, len(some))))
    rows = max(1, bytes_each // bytes_row)
    # the sort reads its input twice; a dear one is written before by the caller
    n = max(1, math.ceil(df.count() / rows))
    df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).write.option("maxRecordsPerFile", rows).option("compression", "snappy").parquet(path)
    return rows
