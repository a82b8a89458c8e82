"""Sharding by a histogram sort: exact counts below probes, then one exchange.

The key of a row is (XXH64 of its text, its id), 16 bytes in order, so equal texts are
neighbours and a hot text can be cut between ids. `law` is `bytes`: splitters are
placed where the exact number of bytes below them is nearest to k/n of the total.

1. Every task counts rows and bytes between neighbouring probes, with the least and
   greatest key there; the sums reach the driver. Their number depends on the shards only.
2. The bracket around each target shrinks to the keys found in its bin, gets new
   evenly spaced probes, and is counted again until the nearer end is within the
   tolerance or one key is left in it.
3. A row's shard is the number of splitters that are not above its key. Inside a shard, rows
   are dealt to pieces of about `piece_rows` rows by a hash of their key; pieces are counted,
   and the counts before a piece in its shard give its first slot. Rows go to their pieces in
   the only exchange and are numbered there. No task sorts a whole shard, and neither pieces
   nor their counts pass through the driver; their table is broadcast if it is small.

Null text counts as empty and as no bytes; rows with a null id sort before others of
equal text. Rows repeated in full have one key and stay together. An empty table gives
an empty result. Columns of the input named like the added ones are replaced.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, save, text_column

OVERHEAD = 16
TOLERANCE = 0.0005
PIECE_ROWS = 200_000
PROBES = 32
#: Most pieces whose table is broadcast.
SMALL_PIECES = 100_000
_KEYS = 1 << 128
_ADDED = ("size", "text_crc32", "shard", "slot")


def _as_bytes(h: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Keys as 16 bytes whose order is that of (h, id), both signed."""
    flip = np.uint64(1 << 63)
    return np.stack([h.view(np.uint64) ^ flip, ids.view(np.uint64) ^ flip], 1).astype(">u8").view("S16").reshape(-1)


def _as_longs(key: int) -> tuple[int, int]:
    """A key as its (h, id), both signed."""
    return (key >> 64) - (1 << 63), (key & (1 << 64) - 1) - (1 << 63)


def _probe_array(probes: list[int]) -> np.ndarray:
    return np.array([p.to_bytes(16, "big") for p in probes], "S16")


def _columns(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]


def _histogram(keys: DataFrame, probes: list[int]) -> dict[int, tuple[int, int, int, int]]:
    """Bin -> rows, bytes, least and greatest key; bin k has the keys from probe k - 1 to before probe k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, found = _probe_array(probes), {}
        for batch in batches:
            h, ids, size = _columns(batch, "h", "id", "size")
            if not len(h):
                continue
            key = _as_bytes(h, ids)
            order = np.argsort(key, kind="stable")
            key, size = key[order], size[order]
            bins = np.searchsorted(at, key, "right")
            first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
            last = np.r_[first[1:], len(bins)]
            sums = np.add.reduceat(size, first)
            for k, a, b, s in zip(bins[first].tolist(), first.tolist(), last.tolist(), sums.tolist()):
                low, high = bytes(key[a]).ljust(16, b"\0"), bytes(key[b - 1]).ljust(16, b"\0")
                old = found.get(k)
                found[k] = (b - a, s, low, high) if old is None else (old[0] + b - a, old[1] + s, min(old[2], low), max(old[3], high))
        rows = [(k, *v) for k, v in found.items()]
        cols = list(zip(*rows)) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["bin", "n", "bytes", "low", "high"])

    each = keys.select("h", "id", "size").mapInArrow(run, "bin int, n long, bytes long, low binary, high binary")
    total = each.groupBy("bin").agg(F.sum("n"), F.sum("bytes"), F.min("low"), F.max("high"))
    return {r[0]: (r[1], r[2], int.from_bytes(r[3], "big"), int.from_bytes(r[4], "big")) for r in total.collect()}


def splitters(keys: DataFrame, targets: list[int], tolerances: list[int], probes_each: int = PROBES) -> list[int]:
    """For each number of bytes in `targets` a key with nearly so many bytes below it.

    Ends when each is within its tolerance or between two neighbouring keys.
    """
    # bracket: keys from lo to before hi, and the bytes below lo and below hi
    brackets: list[list[int]] = [[0, _KEYS, 0, -1] for _ in targets]
    done: list[int | None] = [None] * len(targets)
    while any(d is None for d in done):
        probes = set()
        for k, (lo, hi, _, _) in enumerate(brackets):
            if done[k] is None:
                probes |= {lo, *(lo + (hi - lo) * j // (probes_each + 1) for j in range(1, probes_each + 1)), min(hi, _KEYS - 1)}
        at = sorted(probes)
        found = _histogram(keys, at)
        below, total = [0], 0
        for k in range(len(at) + 1):
            total += found.get(k, (0, 0))[1]
            below.append(total)  # below[k + 1]: bytes before probe k
        for k, target in enumerate(targets):
            if done[k] is not None:
                continue
            b = min(bisect_left(below, target, 1), len(at) + 1) - 1
            while b < len(at) and b not in found:
                b += 1
            if b not in found:
                done[k] = _KEYS - 1
                continue
            n, _, low, high = found[b]
            lo, hi, c_lo, c_hi = low, high + 1, below[b], below[b + 1]
            brackets[k] = [lo, hi, c_lo, c_hi]
            nearest = lo if target - c_lo <= c_hi - target else hi
            if n <= 1 or low == high or min(target - c_lo, c_hi - target) <= tolerances[k]:
                done[k] = min(nearest, _KEYS - 1)
    return done


def shard(df: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """The rows of `df` with size, text_crc32, shard (0 to shards - 1) and slot (from 0 in each shard)."""
    text = text_column(text_col)
    df = df.drop(*(c for c in df.columns if c.lower() in _ADDED and c not in (id_col, text_col)))
    h, key, piece, first = fresh(df, "h", "key", "piece", "first")
    marked = df.withColumns({
        "size": (F.octet_length(text) + OVERHEAD).cast("long"),
        "text_crc32": F.crc32(text.cast("binary")),
        h: F.xxhash64(text),
        key: F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))),
    })
    keys = save(marked.select(F.col(h).alias("h"), F.col(key).alias("id"), "size"), "keys")
    rows, total = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    targets = [total * j // shards for j in range(1, shards)]
    cuts = sorted(splitters(keys, targets, [int(total / shards * tolerance)] * len(targets))) if rows else []
    pieces = max(1, math.ceil(rows / shards / piece_rows))

    def place(h: str, key: str) -> dict[str, Column]:
        at = F.struct(F.col(h).alias("h"), F.col(key).alias("id"))
        below = F.filter(F.array(*(F.struct(F.lit(c).cast("long").alias("h"), F.lit(i).cast("long").alias("id")) for c, i in map(_as_longs, cuts))), lambda c: c <= at)
        return {"shard": (F.size(below) if cuts else F.lit(0)).cast("int"), piece: F.pmod(F.xxhash64(h, key), F.lit(pieces)).cast("int")}

    counts = keys.withColumns(place("h", "id")).groupBy("shard", piece).count()
    upto = Window.partitionBy("shard").orderBy(piece)
    firsts = counts.select("shard", piece, (F.sum("count").over(upto) - F.col("count")).alias(first))
    if shards * pieces <= SMALL_PIECES:
        firsts = F.broadcast(firsts)
    placed = marked.withColumns(place(h, key)).join(firsts, ["shard", piece])
    inside = Window.partitionBy("shard", piece).orderBy(h, key, "text_crc32", "size")
    numbered = placed.withColumn("slot", F.col(first) + F.row_number().over(inside) - 1)
    return numbered.select(*df.columns, *_ADDED)
