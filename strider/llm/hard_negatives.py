"""Hard negatives by dual-tree search.

**Trees.** Rows of one label are halved again and again at the median of their widest
dimension, down to leaves. A node has a centre and a radius that holds its vectors. An
anchor node (a, r) and a candidate node (c, s) have all their inner products within

    a.c -+ (r |c| + s |a| + r s).

A search starts with the two roots and opens pairs of nodes level by level. A pair is
left out, with all its anchors at once, if its interval lies wholly below what every
anchor of the node still looks for, or wholly above it. Pairs of leaves that remain
are scored exactly, the most promising first.

**Positives.** The first `positives` rows of the anchor's label, of another id, by
score, ties by smaller id. **Negatives.** For each positive, the first `negatives` rows
of another label with low * positive score <= 100 * score <= high * positive score, in
the same order. Nothing is approximate.

**In Spark.** Candidate trees are made where their rows are, each of at most `ROWS`
rows of a partition, and stored leaf by leaf in the shared folder; no candidate moves.
Anchors, a stated share of the rows, are stored as leaves too and are taken in chunks
of at most CHUNK_BYTES (or one leaf), the only thing broadcast. For a chunk, one pass
over the leaves gives positives and one gives negatives; a task returns its own best
rows of an anchor, which are merged by ranks of (anchor, task group) and of the anchor.

**Values.** A component x counts as floor(256 x). A score is a 64-bit integer. Where
products of the largest components could leave 2^53, scores are taken in integers
(wrapping as 64-bit numbers do) and nothing is pruned; else in doubles, which are then
exact. Missing trailing components count as 0.

Rows with a null id, a null label, a null vector, or a null or non-finite component
take no part. Rows that repeat an id are candidates each, are no positives of one
another, and as anchors count once if all is equal, else each on its own. An anchor
without positives, or a positive without negatives, has no rows; an empty table has
none. Columns other than the three named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, save

POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies within these hundredths of its positive's.
LOW, HIGH = 50, 95
#: Rows of one tree, of one leaf, and leaves searched together.
ROWS, LEAF, TOGETHER = 32_768, 64, 256
#: Pairs of nodes whose centres are multiplied at once.
PAIRS = 1 << 16
#: Bytes of anchors in one broadcast.
CHUNK_BYTES = 32 << 20
#: Groups of tasks whose rows of an anchor are merged first.
GROUPS = 64
EXACT = float(1 << 53)

LEAVES = "label long, n int, dim int, low long, ids binary, vectors binary"


def quantised(vector: Column) -> Column:
    """floor(256 x) of each component as longs; null where any component is null, NaN or infinite."""
    as_double = vector.cast("array<double>")
    good = F.forall(as_double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(good, F.transform(as_double, lambda x: F.floor(x * 256).cast("long")))


def valid(df: DataFrame, id_col: str, label: Column, vector_col: str) -> DataFrame:
    """id, label, v of the rows that take part."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), quantised(F.col(vector_col)).alias("v"))
    return rows.where("id is not null and label is not null and v is not null")


def _matrix(v: pa.ListArray) -> np.ndarray:
    """Vectors as rows, filled up with zeros."""
    sizes = np.diff(v.offsets.to_numpy())
    out = np.zeros((len(v), sizes.max(initial=0)), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = v.flatten().to_numpy()
    return out


def _order(x: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Row numbers of each leaf, in tree order."""
    todo, out = [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            out.append(rows)
            continue
        part = x[rows].astype(float)
        by, half = part[:, np.argmax(np.var(part, axis=0))] if part.shape[1] else np.zeros(len(rows)), len(rows) // 2
        at = np.argpartition(by, half)
        todo += [rows[at[half:]], rows[at[:half]]]
    return out


def leaves(rows: DataFrame, size: int = ROWS, leaf: int = LEAF) -> DataFrame:
    """LEAVES: trees of the rows (id, label, v) of each partition, leaf by leaf; neighbours in a tree are neighbours here."""

    def build(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        ids, labels, x = t["id"].to_numpy(), t["label"].to_numpy(), _matrix(t["v"].chunk(0))
        small = np.int16 if np.abs(x).max(initial=0) < 1 << 15 else np.int64
        out = []
        order = np.argsort(labels, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(labels[order])) + 1):
            for at in _order(x[own], leaf):
                at = own[at]
                out.append((int(labels[at[0]]), len(at), x.shape[1], int(ids[at].min()), ids[at].tobytes(), x[at].astype(small).tobytes()))
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), types)], [c.split()[0] for c in LEAVES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for at in range(0, b.num_rows, size):
                piece = b.slice(at, size)
                if n and n + piece.num_rows > size:
                    yield build(held)
                    held, n = [], 0
                held.append(piece)
                n += piece.num_rows
        if n:
            yield build(held)

    return rows.mapInArrow(run, LEAVES)


@dataclass
class Trees:
    """Leaves with the levels above them. A level's node k has the nodes 2k and 2k + 1 of the level below.

    `first` are the rows where leaves begin; centres and radii are by level, leaves first. A node that spans
    labels keeps no label (`mixed`), so the rule on labels applies from where they part.
    """

    labels: np.ndarray
    first: np.ndarray
    ids: np.ndarray
    x: np.ndarray
    centres: list[np.ndarray]
    radii: list[np.ndarray]
    label: list[np.ndarray]
    mixed: list[np.ndarray]

    @classmethod
    def of(cls, rows: list[tuple]) -> Trees:
        """rows: (label, n, dim, ids, vectors) of each leaf."""
        sizes, dim = np.array([r[1] for r in rows]), max(r[2] for r in rows)
        x = np.zeros((sizes.sum(), dim), np.int64)
        first = np.concatenate([[0], np.cumsum(sizes)])
        for (_, n, d, _, data), at in zip(rows, first):
            if n * d:
                x[at : at + n, :d] = np.frombuffer(data, np.int16 if len(data) == 2 * n * d else np.int64).reshape(n, d)
        ids = np.frombuffer(b"".join(r[3] for r in rows), np.int64)
        labels = np.array([r[0] for r in rows], np.int64)
        f = x.astype(float)
        centre = np.add.reduceat(f, first[:-1], axis=0) / sizes[:, None] if dim else np.zeros((len(rows), 0))
        far = np.sqrt(((f - np.repeat(centre, sizes, axis=0)) ** 2).sum(1))
        out = cls(labels, first, ids, x, [centre], [np.maximum.reduceat(far, first[:-1])], [labels], [np.zeros(len(rows), bool)])
        while len(out.radii[-1]) > 1:
            out._above()
        return out

    def _above(self) -> None:
        c, r, lab, mix = self.centres[-1], self.radii[-1], self.label[-1], self.mixed[-1]
        if len(r) % 2:  # a node without a neighbour goes up alone
            c, r, lab, mix = (np.concatenate([v, v[-1:]]) for v in (c, r, lab, mix))
        mid = (c[::2] + c[1::2]) / 2
        self.centres.append(mid)
        self.radii.append(np.maximum(*(np.sqrt(((mid - c[k::2]) ** 2).sum(1)) + r[k::2] for k in (0, 1))))
        self.label.append(lab[::2])
        self.mixed.append(mix[::2] | mix[1::2] | (lab[::2] != lab[1::2]))


def _up(values: np.ndarray, levels: int, f: np.ufunc) -> list[np.ndarray]:
    """Leaf values and, for each level above, what `f` makes of the children's."""
    out = [values]
    for _ in range(levels - 1):
        v = out[-1]
        if len(v) % 2:
            v = np.concatenate([v, v[-1:]])
        out.append(f(v[::2], v[1::2]))
    return out


def _wide(m: np.ndarray, dim: int) -> np.ndarray:
    return m if m.shape[1] == dim else np.pad(m, ((0, 0), (0, dim - m.shape[1])))


def pairs_of_leaves(a: Trees, c: Trees, least: np.ndarray, most: np.ndarray, same: bool, prune: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor leaves, candidate leaves, upper bounds) that the dual search leaves.

    least, most: the scores that the anchors of each leaf look for; same: of their own label, else of others.
    """
    dim = max(a.x.shape[1], c.x.shape[1])
    low, high = _up(least, len(a.radii), np.minimum), _up(most, len(a.radii), np.maximum)
    i, j = len(a.radii) - 1, len(c.radii) - 1
    u, v = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        ca, cc, ra, rc = _wide(a.centres[i], dim), _wide(c.centres[j], dim), a.radii[i][u], c.radii[j][v]
        na, nc = (np.sqrt((m**2).sum(1))[w] for m, w in ((ca, u), (cc, v)))
        at = range(0, len(u), PAIRS)
        mid = np.concatenate([np.einsum("ij,ij->i", ca[u[k : k + PAIRS]], cc[v[k : k + PAIRS]]) for k in at]) if len(u) else np.zeros(0)
        spread = ra * nc + rc * na + ra * rc
        spread += 1 + 1e-9 * (na + ra) * (nc + rc)  # rounding never hides a pair
        known = ~(a.mixed[i][u] | c.mixed[j][v])
        keep = ~known | ((a.label[i][u] == c.label[j][v]) == same)
        if prune:
            keep &= (mid + spread >= low[i][u]) & (mid - spread <= high[i][u])
        u, v, bound = u[keep], v[keep], (mid + spread)[keep]
        if i == j == 0:
            return u, v, bound
        if i >= j:  # open the higher of the two
            i -= 1
            u, v = np.concatenate([2 * u, 2 * u + 1]), np.concatenate([v, v])
        else:
            j -= 1
            u, v = np.concatenate([u, u]), np.concatenate([2 * v, 2 * v + 1])
        inside = (u < len(a.radii[i])) & (v < len(c.radii[j]))
        u, v = u[inside], v[inside]


class Best:
    """The first k of (score, id) for each of `n` searches, and the score that a row must reach."""

    def __init__(self, n: int, k: int):
        self.k, self.full, self.pending, self.waiting = k, np.full(n, np.iinfo(np.int64).min), [], 0
        self.rows = tuple(np.zeros(0, np.int64) for _ in range(3))

    def add(self, who: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.pending.append((who, score, ids))
        self.waiting += len(who)
        if self.waiting > 4 * self.k * len(self.full) + 4096:
            self.settle()

    def settle(self) -> None:
        who, score, ids = (np.concatenate(x) for x in zip(self.rows, *self.pending))
        order = np.lexsort((ids, -score, who))
        who, score, ids = who[order], score[order], ids[order]
        begins = np.flatnonzero(np.diff(who, prepend=who[0] - 1)) if len(who) else np.zeros(0, np.int64)
        place = np.arange(len(who)) - np.repeat(begins, np.diff(np.append(begins, len(who))))
        keep = place < self.k
        self.rows = who[keep], score[keep], ids[keep]
        last = place == self.k - 1
        self.full[who[last]] = score[last]
        self.pending, self.waiting = [], 0


def search(a: Trees, c: Trees, best: Best, least: np.ndarray, most: np.ndarray, same: bool) -> None:
    """Feed `best` with rows of `c` for the searches of all anchors; least, most: (anchors, searches of each)."""
    n, per = least.shape
    dim = max(a.x.shape[1], c.x.shape[1])
    top = float(np.abs(a.x).max(initial=0)) * float(np.abs(c.x).max(initial=0)) * max(dim, 1)
    exact = top < EXACT
    xa, xc = (_wide(t.x.astype(float) if exact else t.x, dim) for t in (a, c))
    floor = lambda: np.maximum(least, best.full.reshape(n, per))
    by_leaf = lambda f, m: f.reduceat(f.reduce(m, axis=1), a.first[:-1])
    u, v, bound = pairs_of_leaves(a, c, by_leaf(np.minimum, floor()), by_leaf(np.maximum, most), same, exact)
    order = np.argsort(-bound, kind="stable")
    rank = np.full(len(c.labels), len(order))
    np.minimum.at(rank, v[order], np.arange(len(order)))
    ends = np.argsort(v, kind="stable")
    u, v, bound = u[ends], v[ends], bound[ends]
    begins = np.searchsorted(v, np.arange(len(c.labels) + 1))
    for leaf in np.argsort(rank, kind="stable"):
        mine = slice(begins[leaf], begins[leaf + 1])
        groups = u[mine]
        if exact and len(groups):
            groups = groups[bound[mine] >= by_leaf(np.minimum, floor())[groups]]
        if not len(groups):
            continue
        who = np.concatenate([np.arange(a.first[g], a.first[g + 1]) for g in groups])
        at = slice(c.first[leaf], c.first[leaf + 1])
        scores = xa[who] @ xc[at].T
        lo, hi = floor()[who], most[who]
        r, k = np.nonzero((scores >= lo.min(1)[:, None]) & (scores <= hi.max(1)[:, None]))
        score, ids = scores[r, k].astype(np.int64), c.ids[at][k]
        for s in range(per):
            ok = (score >= lo[r, s]) & (score <= hi[r, s])
            if same:
                ok &= ids != a.ids[who[r]]
            best.add(who[r[ok]] * per + s, score[ok], ids[ok])
    best.settle()


def _rows(batch: pa.RecordBatch) -> list[tuple]:
    return list(zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4, 5))))


def _searched(candidates: DataFrame, chunk, k: int, per: int, same: bool, least, most) -> DataFrame:
    """who, score, id: the first k rows of each search; who = anchor * per + search."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = Trees.of(chunk.value)
        n = len(a.ids)
        lo = least.value if least else np.full((n, per), np.iinfo(np.int64).min)
        hi = most.value if most else np.full((n, per), np.iinfo(np.int64).max)
        best = Best(n * per, k)
        for b in batches:
            for at in range(0, b.num_rows, TOGETHER):
                search(a, Trees.of(_rows(b.slice(at, TOGETHER))), best, lo, hi, same)
        group = np.full(len(best.rows[0]), TaskContext.get().partitionId() % GROUPS, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*best.rows, group)], ["who", "score", "id", "task"])

    found = candidates.select(*(c.split()[0] for c in LEAVES.split(", "))).mapInArrow(run, "who long, score long, id long, task int")
    for keys in (["who", "task"], ["who"]):
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("who", "score", "id", "rank")


def _chunks(anchors: DataFrame, most: int) -> list[list[int]]:
    """Numbers of leaves that go together; sizes and numbers are all that the driver sees of them here."""
    out, held = [], most + 1
    for row in anchors.select("number", (F.length("ids") + F.length("vectors") * 4).alias("bytes")).orderBy("number").toLocalIterator():
        if held + row.bytes > most:
            out.append([])
            held = 0
        out[-1].append(row.number)
        held += row.bytes
    return out


def mine(
    df: DataFrame, anchor: Column, id_col: str = "vec_id", label: Column | None = None, vector_col: str = "embedding",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; `anchor` is a condition on `id`."""
    rows = valid(df, id_col, F.col("label") if label is None else label, vector_col)
    candidates = save(leaves(rows), "candidates")
    number, = fresh(candidates, "number")
    anchors = save(leaves(rows.where(anchor).distinct()), "anchors").withColumn(number, F.monotonically_increasing_id())
    context, found = df.sparkSession.sparkContext, []
    for some in _chunks(anchors, chunk_bytes):
        part = anchors.where(F.col(number).between(some[0], some[-1])).drop(number).toArrow()
        leaves_of = sorted((tuple(row[c] for c in ("label", "n", "dim", "ids", "vectors")) for row in part.to_pylist()), key=lambda r: r[0])
        trees = Trees.of(leaves_of)
        chunk = context.broadcast(leaves_of)
        first = _searched(candidates, chunk, positives, 1, True, None, None).toArrow()
        who, score, place = (first[c].to_numpy() for c in ("who", "score", "rank"))
        shape = (len(trees.ids), positives)
        least, most = np.full(shape, np.iinfo(np.int64).max), np.full(shape, np.iinfo(np.int64).min)
        at, up = (who, place - 1), score.astype(object)  # Python's integers: hundredfold scores may leave 64 bits
        least[at], most[at] = (-(-low * up // 100)).astype(np.int64), (high * up // 100).astype(np.int64)
        second = _searched(candidates, chunk, negatives, positives, False, context.broadcast(least), context.broadcast(most))
        known = df.sparkSession.createDataFrame(pa.table({"who": who * positives + place - 1, "anchor_id": trees.ids[who], "positive_id": first["id"], "positive_score": first["score"]}))
        out = second.join(F.broadcast(known), "who")  # rows for `positives` of a chunk's anchors
        found.append(save(out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives"))
    if not found:
        return df.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
