"""Benchmark decontamination: CGK embedding, bit-sampling LSH, edit verification.

Texts and items are words: letters, digits and bytes from 128 up, A-Z in lower case. An
item of m words is leaked where some stretch of a text is within floor((1 - similarity) m)
word edits of it.

1. *Windows.* A text's windows of an item's size (and the d words an insertion may add)
   start at every word, over both ends. Windows are kept that have enough of the word
   q-grams of the items of this size to hold a leak: d edits spoil at most q d of the
   m - q + 1 grams, so the filter drops no leak. q is 3, or 2 for items of up to five
   words, 1 for one word.
2. *Embedding.* A CGK random walk copies the word under its head at each of 2m steps, and
   a random bit for step and word says whether the head moves on. Few edits give few
   differing places (Chakraborty, Goldenberg, Koucky, "Streaming algorithms for embedding
   and computing edit distance", 2016).
3. *Bit sampling.* `walks` walks with `tables` tables each take `places` random places as a
   key, three of items of up to 100 words, two of longer ones. Windows and items of one
   size that share a key are candidates. The defaults come from measured recall, of items
   of up to 1,000 words with all the edits allowed (see tests). Windows are embedded in
   batches of a bounded number of places, however long the items are.
4. *Verification.* The least edit distance between the item and any stretch of the window,
   by Myers' bit-parallel recurrence over words.

A text is handled by itself, so nothing is shuffled but leaks. Items are shipped to the
workers in blocks of at most about `block_bytes` of texts and their index, one pass over the
texts for each block, so the broadcast is bounded whatever the benchmark's size.

Null or empty texts and items have no words and no leaks. Items are told apart by id; of
rows that repeat an id the words of each are looked for, and the nearest counts. Rows with
a null id are scanned like others, and each item without an id is looked for as one of its
own, with a null item_id in the result. Very long texts cost memory in proportion to their
length. Other columns of the input are ignored; `leaked` gives a Column for filters.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_column

SIMILARITY = 0.8
WALKS = 8
TABLES = 12
PLACES = 3
BLOCK_BYTES = 64 << 20
_WORD_BYTES = bytes(b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Numbers in the embedding of one batch of windows, however long they are.
_NUMBERS = 1 << 19
#: About what an item's keys take in an index, and each of its words; block_bytes counts them.
_ITEM_BYTES, _WORD_COST = 400 + WALKS * TABLES * 16, 150
_GONE = -1
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_WORD_BYTES).split()


def edits(m: int, similarity: float = SIMILARITY) -> int:
    return int(m * (1 - similarity) + 1e-9)


def places_of(m: int) -> int:
    """Places in a key: where the allowed edits are many, the walks part for longer, and shorter keys keep the recall (see tests)."""
    return PLACES if m <= 100 else PLACES - 1


def gram_size(m: int) -> int:
    return 3 if m >= 6 else min(m, 2)


def nearest(item: list[int], text: list[int]) -> tuple[int, int]:
    """Least edit distance between `item` and any stretch of `text`, and the (exclusive) end of the first such stretch."""
    m = len(item)
    at: dict[int, int] = {}
    for i, w in enumerate(item):
        at[w] = at.get(w, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    for j, w in enumerate(text):
        eq = at.get(w, 0)
        x = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | (~(x | up) & full), up & x
        score += 1 if plus & high else -1 if minus & high else 0
        x2 = eq | down
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up, down = minus | (~(x2 | plus) & full), plus & x2
        if score < best:
            best, end = score, j + 1
    return best, end


class Items:
    """Items by size, with their walks' keys; made once for each block and shipped to the workers."""

    def __init__(self, items: list[tuple[int, bytes]], similarity: float = SIMILARITY, walks: int = WALKS, tables: int = TABLES, places: int | None = None, seed: int = 11):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[int, list[tuple[int, list[int]]]] = {}
        for item, raw in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(raw)]
            if ids:
                found.setdefault(len(ids), []).append((item, ids))
        rng = np.random.default_rng(seed)
        self.base = np.int64(len(self.vocabulary) + 1)
        # for each gram size: all grams in order, and the sizes of the items that have each, as a flat list with offsets
        self.grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for q in (1, 2, 3):
            rows = [(g, m) for m, own in found.items() if gram_size(m) == q for _, ids in own for g in self._grams(np.array(ids), q).tolist()]
            if rows:
                pairs = np.unique(np.array(rows, np.int64), axis=0)
                grams, first = np.unique(pairs[:, 0], return_index=True)
                self.grams[q] = grams, np.append(first, len(pairs)), pairs[:, 1]
        self.sizes = {}
        for m in sorted(found):
            steps = 2 * m
            moves = rng.integers(0, 2**63, (walks, steps), np.uint64)
            spots = rng.integers(0, steps, (walks, tables, places or places_of(m)))
            own = found[m]
            keys = self._keys(np.array([ids for _, ids in own]), moves, spots)
            flat = keys.reshape(-1)
            order = np.argsort(flat, kind="stable")
            d = edits(m, similarity)
            self.sizes[m] = d, gram_size(m), moves, spots, [i for i, _ in own], [ids for _, ids in own], flat[order], order // keys.shape[1]

    def _grams(self, ids: np.ndarray, q: int) -> np.ndarray:
        """A number for each q-gram; grams with a word that no item has are negative."""
        n = len(ids) - q + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        total, known = np.zeros(n, np.int64), np.ones(n, bool)
        with np.errstate(over="ignore"):
            for j in range(q):
                part = ids[j : j + n]
                total = total * self.base + part
                known &= part > 0
        return np.where(known, np.abs(total), _GONE)

    @staticmethod
    def _keys(x: np.ndarray, moves: np.ndarray, spots: np.ndarray) -> np.ndarray:
        """One key for each row of x and each table of each walk."""
        n, m = x.shape
        padded = np.hstack([x, np.full((n, 1), _GONE)]).astype(np.int64)
        rows, out = np.arange(n), []
        with np.errstate(over="ignore"):
            for walk, (steps, own) in enumerate(zip(moves, spots)):
                head, copied = np.zeros(n, np.int64), np.empty((n, len(steps)), np.int64)
                for j, r in enumerate(steps):
                    w = padded[rows, head]
                    copied[:, j] = w
                    head = np.minimum(head + ((((w.view(np.uint64) + np.uint64(2)) * (r | np.uint64(1))) >> np.uint64(61)) & np.uint64(1)).astype(np.int64), m)
                for table, places in enumerate(own):
                    key = np.full(n, walk * 1000 + table + 1, np.uint64)
                    for p in places:
                        key = (key ^ (copied[:, p].view(np.uint64) + np.uint64(0x5851F42D4C957F2D))) * _MIX
                        key ^= key >> np.uint64(29)
                    out.append(key)
        return np.stack(out, 1)

    def _hits(self, ids: np.ndarray) -> dict[int, np.ndarray]:
        """Size -> places of the grams that items of this size have, in order."""
        out: dict[int, np.ndarray] = {}
        for q, (grams, first, sizes) in self.grams.items():
            own = self._grams(ids, q)
            places = np.flatnonzero(own >= 0)
            k = np.searchsorted(grams, own[places])
            good = (k < len(grams)) & (grams[np.minimum(k, len(grams) - 1)] == own[places])
            if not good.any():
                continue
            places, k = places[good], k[good]
            counts = first[k + 1] - first[k]
            at = np.repeat(places, counts)
            of = sizes[np.repeat(first[k] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]
            order = np.argsort(of, kind="stable")
            cut = np.flatnonzero(np.diff(of[order])) + 1
            for part in np.split(order, cut):
                out[int(of[part[0]])] = at[part]
        return out

    def _starts(self, places: np.ndarray, n: int, m: int, d: int, q: int) -> np.ndarray:
        """Starts of windows that have enough of the grams; windows may stand over both ends of the text by d words."""
        need = max(1, m - q + 1 - q * d)
        if len(places) < need or n < m - d:
            return np.zeros(0, np.int64)
        # a window has enough if some `need` neighbouring hits lie in it: starts from its last hit's reach to its first hit
        last, first = places[need - 1 :], places[: len(places) - need + 1]
        lo, hi = np.maximum(last - (m + d - q), -d), np.minimum(first, n - (m - d))
        good = lo <= hi
        if not good.any():
            return np.zeros(0, np.int64)
        return np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(lo[good].tolist(), hi[good].tolist())]))

    def leaks(self, raws: list[bytes]) -> list[list[tuple[int, int, int, int]]]:
        """For each text: (item id, end of the nearest stretch in words, edits, words of the item) of every leaked item; the nearest, then the earliest."""
        texts: list[np.ndarray] = []
        windows: dict[int, list[tuple[int, np.ndarray]]] = {}
        for t, raw in enumerate(raws):
            words = words_of(raw)
            ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))
            texts.append(ids)
            if len(ids):
                for m, places in self._hits(ids).items():
                    starts = self._starts(places, len(ids), m, *self.sizes[m][:2])
                    if len(starts):
                        windows.setdefault(m, []).append((t, starts))
        best: list[dict[tuple[int, ...], tuple[int, int, int]]] = [{} for _ in raws]
        for m, own in windows.items():
            d, _, moves, spots, names, items, keys, owners = self.sizes[m]
            for part in _batches(own, max(1, _NUMBERS // (2 * m))):
                which = np.repeat([t for t, _ in part], [len(s) for _, s in part])
                starts = np.concatenate([s for _, s in part])
                rows = np.concatenate([np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(d, np.int64), texts[t], np.zeros(m + d, np.int64)]), m)[s + d] for t, s in part])
                found = self._keys(rows, moves, spots)
                left, right = np.searchsorted(keys, found, "left"), np.searchsorted(keys, found, "right")
                pairs = set()
                for r, c in np.argwhere(right > left):
                    pairs.update((int(which[r]), int(o), int(starts[r])) for o in owners[left[r, c] : right[r, c]])
                for t, item, a, b in _runs(pairs, d):
                    text = texts[t][max(0, a - d) : b + m + d].tolist()
                    near, end = nearest(items[item], text)
                    if near <= d:
                        # an item without an id is told apart by its size and place
                        name = (m, item) if names[item] is None else (names[item],)
                        new, old = (near, max(0, a - d) + end, m), best[t].get(name)
                        best[t][name] = new if old is None else min(old, new)
        return [[(name[0] if len(name) == 1 else None, end, near, m) for name, (near, end, m) in sorted(x.items(), key=lambda y: (len(y[0]), y[0]))] for x in best]


def _batches(own: list[tuple[int, np.ndarray]], most: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Windows in groups of about `most`."""
    part, n = [], 0
    for t, starts in own:
        for k in range(0, len(starts), most):
            part.append((t, starts[k : k + most]))
            n += len(part[-1][1])
            if n >= most:
                yield part
                part, n = [], 0
    if part:
        yield part


def _runs(pairs: set[tuple[int, int, int]], d: int) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, first start, last start) of starts no further than d + 1 apart, whose windows are verified at once."""
    run: list[int] | None = None
    for t, item, s in sorted(pairs):
        if run and run[:2] == [t, item] and s <= run[3] + d + 1:
            run[3] = s
            continue
        if run:
            yield tuple(run)
        run = [t, item, s, s]
    if run:
        yield tuple(run)


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, null_ids: bool = False) -> Iterator[list[tuple[int | None, bytes]]]:
    """The benchmark's rows, those without an id if `null_ids`, in blocks of bounded size, counted with their index, one block at a time on the driver."""
    block, size = [], 0
    rows = benchmark.select(F.col(id_col).cast("long"), text_column(text_col).cast("binary")).where(F.lit(null_ids) | F.col(id_col).isNotNull())
    for item, raw in rows.toLocalIterator():
        cost = len(raw) + _ITEM_BYTES + _WORD_COST * (1 + len(raw) // 6)
        if block and size + cost > block_bytes:
            yield block
            block, size = [], 0
        block.append((item, bytes(raw)))
        size += cost
    if block:
        yield block


def find_leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, end_word, distance, item_words and similarity of every leaked item of every text."""
    schema = "doc_id long, item_id long, end_word long, distance int, item_words int"
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), text_column(text_col).cast("binary").alias("raw"))
    out = None
    for block in item_blocks(benchmark, item_col, item_text, null_ids=True):
        items = Items(block, similarity)

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(d, *x) for d, own in zip(batch.column(0).to_pylist(), items.leaks(batch.column(1).to_pylist())) for x in own]
                cols = list(zip(*rows)) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["doc_id", "item_id", "end_word", "distance", "item_words"])

        found = texts.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = df.sparkSession.createDataFrame([], schema)
    return out.withColumn("similarity", 1 - F.col("distance") / F.col("item_words"))


def leaked(benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> Column:
    """True where a text has a leak."""
    out: Column = F.lit(False)
    for block in item_blocks(benchmark, item_col, item_text, null_ids=True):
        out = out | _any_leak(Items(block, similarity))(text_column(text_col).cast("binary"))
    return out


def _any_leak(items: Items):
    @F.pandas_udf(T.BooleanType())
    def any_leak(raw: pd.Series) -> pd.Series:
        return pd.Series([bool(x) for x in items.leaks(raw.tolist())], dtype=bool)

    return any_leak
