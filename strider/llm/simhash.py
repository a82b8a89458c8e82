"""SimHash fingerprints and near-duplicate groups by BK-trees.

**Fingerprint.** A-Z in lower case, words `[^\\x20\\x09-\\x0D]+`, shingles of three
words joined by a space, repeats included (fewer words: the whole sequence; no word:
fingerprint 0, linked like any other). A bit is 1 if it is set in over half of the
shingles' XXH64 values (seed 42).

**Links.** Distinct fingerprints within `radius` bits. Fingerprints are dealt to
shards by pigeonhole blocks: of b blocks at least b - radius agree in such a pair, so
a shard for each choice of b - radius blocks and their value meets every pair. Each
shard holds a BK-tree whose children are keyed by the Hamming distance to their
parent, and a search follows only the edges within the radius of its own distance.
Trees of a whole corpus have no bounded size, so they are not broadcast: a shard's
searches are shuffled to its tree. A shard of more than `tree_size` fingerprints is
salted into trees of about that size, and its searches go to all of them, so that no
task holds an unbounded tree and no link is lost. A shard gives a spanning forest of
its links, never all pairs.

**Result.** component_id is the smallest id reachable over links, by distributed
connected components over fingerprints.

Null text counts as empty. Rows with a null id get the component of their fingerprint
like others, but never name one; a component without any id has a null component_id.
Repeated rows give repeated results. An empty table gives an empty result. Other
columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, parts, save, text_column

SHINGLE = 3
RADIUS = 3
TREE_SIZE = 20_000
_ROWS = 1 << 15


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of one UTF-8 text."""
    words = data.lower().split()
    if not words:
        return 0
    text, n = b" ".join(words), len(words)
    digest = xxhash.xxh64_digest
    if n <= shingle:
        hashes = digest(text, 42)
    else:
        ends = (np.cumsum(np.fromiter(map(len, words), np.int64, n)) + np.arange(n)).tolist()
        starts = [0, *(e + 1 for e in ends[: n - shingle])]
        hashes = b"".join([digest(text[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :])])
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(rows), _ROWS):
        counts += np.unpackbits(rows[at : at + _ROWS], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(rows)).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and `fp`, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x, shingle) for x in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), text_column(text_col).cast("binary").alias("raw")).mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Distinct 64-bit values; a child's key is its Hamming distance to its parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, x: int) -> None:
        self.values.append(x)
        self.children.append({})
        new = len(self.values) - 1
        if not new:
            return
        at = 0
        while True:
            d = (self.values[at] ^ x).bit_count()
            below = self.children[at].get(d)
            if below is None:
                self.children[at][d] = new
                return
            at = below

    def within(self, x: int, radius: int) -> list[int]:
        if not self.values:
            return []
        found, todo, values, children = [], [0], self.values, self.children
        while todo:
            at = todo.pop()
            d = (values[at] ^ x).bit_count()
            if d <= radius:
                found.append(values[at])
            for k, below in children[at].items():
                if d - radius <= k <= d + radius:
                    todo.append(below)
        return found


def _links_of_shards(radius: int):
    """Rows (shard columns, role, fp) sorted by shard and role -> links that span each shard's links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tree, parent = None, BKTree(), {}
        mask = (1 << 64) - 1

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = x = parent.get(up, up)
            return x

        for batch in batches:
            out = []
            for t, key, salt, role, fp in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != (t, key, salt):
                    shard, tree, parent = (t, key, salt), BKTree(), {}
                x = fp & mask
                for y in tree.within(x, radius):
                    a, b = root(x), root(y)
                    if a != b:
                        parent[a] = b
                        out.append((fp, y - (1 << 64) if y >> 63 else y))
                if not role:
                    tree.add(x)
            a, b = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def block_choices(n: int, radius: int = RADIUS, bits: int = 64) -> list[int]:
    """Masks of the blocks that a shard agrees in: as many blocks as keep shards of n random fingerprints small."""
    for b in range(radius + 1, radius + 4):
        kept = (b - radius) * (bits // b)
        if n >> kept <= 64 or b == radius + 3:
            break
    edges = [bits * k // b for k in range(b + 1)]
    blocks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(blocks, b - radius)]


def links(fps: DataFrame, radius: int = RADIUS, tree_size: int = TREE_SIZE) -> DataFrame:
    """(a, b): links that span all links of the distinct fingerprints `fp`."""
    masks = [m - (1 << 64) if m >> 63 else m for m in block_choices(fps.count(), radius)]
    shards = fps.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in masks))).alias("t", "key"))
    sizes = shards.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tree_size).select("t", "key", F.ceil(F.col("n") / tree_size).cast("int").alias("trees"))
    own = F.pmod(F.hash("fp"), F.col("trees"))
    placed = shards.join(sizes, ["t", "key"], "left").withColumn("trees", F.coalesce("trees", F.lit(1))).withColumn("own", own)
    # role 0 enters its own tree after searching it; role 1 only searches the trees before its own
    roles = placed.select("t", "key", "own", "fp", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("salt"))
    rows = roles.select("t", "key", "salt", F.when(F.col("salt") == F.col("own"), 0).otherwise(1).alias("role"), "fp")
    n = parts(fps.sparkSession)
    return rows.repartition(n, "t", "key", "salt").sortWithinPartitions("t", "key", "salt", "role").mapInArrow(_links_of_shards(radius), "a long, b long").distinct()


def components(marks: DataFrame, radius: int = RADIUS, tree_size: int = TREE_SIZE) -> DataFrame:
    """doc_id, fp and component_id for every row of `marks` (doc_id, fp)."""
    each = save(marks.groupBy("fp").agg(F.min("doc_id").alias("low")), "fingerprints")
    joined = connected_components(links(each.select("fp"), radius, tree_size)).select(F.col("node").alias("fp"), "root")
    rooted = each.join(joined, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    low = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    # only groups of several fingerprints need the second step
    named = save(rooted.join(low, "root").select("fp", "component_id"), "groups")
    return marks.join(named, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, tree_size: int = TREE_SIZE) -> DataFrame:
    """doc_id, fp and component_id for every row of `df`."""
    return components(save(fingerprints(df, id_col, text_col), "marks"), radius, tree_size)


def hex_digits(fp: str = "fp"):
    """The fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
