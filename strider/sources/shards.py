"""A sink of named Parquet shards: sorted rows in files of a fixed number of rows, called `split-iiiii-of-nnnnn.parquet`."""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators.ranks import indexed
from ..operators.stored import stored

#: Fixed value: rows from which the size of a row is estimated.
FIRST = 100


@dataclass
class Written(WriterCommitMessage):
    """The files of one task: shard and the path below the folder of unfinished files."""

    files: list[tuple[int, str]]


class ShardWriter(DataSourceArrowWriter):
    """Rows come sorted by shard, a shard's rows in one task. A task writes below a hidden folder of this run, with a
    name of its own for each attempt; commit gives the files their names and abort removes the folder, so neither a
    task that failed nor one that ran twice leaves anything."""

    def __init__(self, path: str, split: str, shards: int, column: str, overwrite: bool):
        self.path, self.split, self.shards, self.column, self.overwrite = path.rstrip("/"), split, shards, column, overwrite
        self.hidden = f"_unfinished-{split}-{uuid.uuid4().hex}"

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def older(self) -> list[str]:
        """Files of the split that are there."""
        store, root = self._store()
        name = re.compile(rf"{re.escape(self.split)}-\d{{5,}}-of-\d{{5,}}\.parquet\Z")
        return [f.path for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if name.match(f.base_name)]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = self._store()
        store.create_dir(f"{root}/{self.hidden}", recursive=True)
        files, out, now = [], None, None
        try:
            for batch in iterator:
                of, rows = batch.column(self.column).to_numpy(), batch.drop_columns([self.column])
                at = 0
                while at < len(of):
                    end = at + int((of[at:] == of[at]).argmin() or len(of) - at)
                    if of[at] != now:
                        if out is not None:
                            out.close()
                        now = int(of[at])
                        files.append((now, f"{self.hidden}/{now}-{uuid.uuid4().hex}"))
                        out = pq.ParquetWriter(f"{root}/{files[-1][1]}", rows.schema, filesystem=store, compression="snappy")
                    out.write_batch(rows.slice(at, end - at))
                    at = end
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = self._store()
        for path in self.older() if self.overwrite else []:
            store.delete_file(path)
        for m in messages:
            for shard, path in m.files if m else []:
                store.move(f"{root}/{path}", f"{root}/{self.split}-{shard:05d}-of-{self.shards:05d}.parquet")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, root = self._store()
        if store.get_file_info(f"{root}/{self.hidden}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.hidden}")


class NamedShards(DataSource):
    """Format `named_shards`; options path (a local path or an address that Arrow's file systems open), split, shards and column, the one with the shard."""

    @classmethod
    def name(cls) -> str:
        return "named_shards"

    def writer(self, schema: StructType, overwrite: bool) -> ShardWriter:
        o = self.options
        out = ShardWriter(o["path"], o["split"], int(o["shards"]), o["column"], overwrite)
        if not overwrite and out.older():
            raise ValueError(f"{o['path']} has shards of {o['split']}; overwrite them")
        return out


def bytes_of(rows: pa.Table) -> float:
    """Bytes of a row in a Parquet file of these rows."""
    sink = pa.BufferOutputStream()
    pq.write_table(rows, sink, compression="snappy")
    return sink.getvalue().size / max(1, rows.num_rows)


def write_named(df: DataFrame, path: str, split: str, keys: list[str], bytes_each: int = 2 << 30, bytes_row: float | None = None, overwrite: bool = False) -> int:
    """Write `df` in order of `keys`; returns the number of shards.

    A row's bytes are those of the first 100 rows in a file of their own, a shard has the rows that make `bytes_each`
    (one at least), and all shards but the last are full. Rows are numbered without a global sort, then a shard goes to
    one task, which streams it. Nulls come first, rows with equal keys in any order; without rows nothing is written.
    """
    if not re.fullmatch(r"[\w.-]+", split):
        raise ValueError(f"not a name of a split: {split!r}")
    place, shard = "position", "shard"
    while {place, shard} & {c.lower() for c in df.columns}:
        place, shard = f"{place}_", f"{shard}_"
    rows = stored(indexed(df, keys, place))
    n = rows.count()
    if not n:
        return 0
    if bytes_row is None:
        bytes_row = bytes_of(rows.where(F.col(place) < FIRST).orderBy(place).drop(place).toArrow())
    each = max(1, int(bytes_each / bytes_row))
    shards = math.ceil(n / each)
    dealt = rows.withColumn(shard, F.floor(F.col(place) / each).cast("long")).repartition(shards, shard).sortWithinPartitions(shard, place).drop(place)
    rows.sparkSession.dataSource.register(NamedShards)
    dealt.write.format("named_shards").options(split=split, shards=shards, column=shard).mode("overwrite" if overwrite else "append").save(path)
    return shards
