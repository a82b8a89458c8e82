"""Byte-level BPE encoding and decoding as a monoid tree reduction.

Every text is cut in halves down to leaves of at most `leaf` characters. A leaf is
split by the pattern, and the bytes of each match are merged by rank: the pair of
neighbours that stands lowest, the first of equals, until no pair has a rank. A match
that is a token as a whole is that token. Neighbours are joined up the tree by
encoding again a window around their border. The window grows on either side to the
next *sync point*, a place where every scan of the split pattern starts a new match
whatever stands before it:

* white space after something else than white space,
* a character that is no letter after a letter,
* a character that is no digit after a digit.

Letters, digits and white space only continue a match of their own kind, so a
match ends before such a place; the pattern has no look-behind, so what comes
after it does not depend on what comes before; and the pattern looks at most two
characters past a match's first (contractions) or one past its end, all of which
a sync point leaves on its own side. Tokens outside the window are hence those
of the joined text. If a half has no sync point, the window takes all of it. Nodes
without a sync point (parts of one match that is longer than a leaf) are not encoded by
themselves, as the window above takes all of them.

Texts are taken together: first the tree of each is walked down to the matches of its leaves and
windows, then the short ones among these that are new are merged side by side in numpy, each by its
own least pair in every step, and last the trees are joined upwards.

The tokens of short matches are kept in a table of at most `memory` bytes for each
worker and vocabulary, in two halves: a full half takes the place of the old one, from
which what is met again comes back. That changes no result.

Null text counts as empty; an empty text has no tokens. Very long texts cost
memory in proportion to their own length. Repeated rows give repeated results.
Other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterable, Iterator
from heapq import heapify, heappop, heappush
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_column

LEAF = 128
MEMORY = 96 << 20
#: Characters of texts taken together, and matches merged side by side.
TOGETHER, SIDE_BY_SIDE = 1 << 18, 2048
#: Longest match in bytes that is merged by scanning and kept in the table.
_SCANNED = 64

_SYNC = r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\p{L}])|(?<=\p{N})(?=[^\p{N}])"
_NEXT, _LAST = regex.compile(_SYNC), regex.compile("(?r)" + _SYNC)
#: Characters that `regex` takes for letters or digits and the library's Unicode 16 does not.
_NEWER = (
    "\u0558 \u058b-\u058c \u088f \u0c5c \u0cdc \u208f \u209d-\u209f \ua7ce-\ua7cf \ua7d2 \ua7d4 \ua7dd \ua7e2 \ua7f1 \uab6c-\uab6d \U000107bb-\U000107bf \U00010940-\U00010959 "
    "\U00010ec5-\U00010ec7 \U00010ed9-\U00010eee \U00011b0a \U00011db0-\U00011ddb \U00011de0-\U00011de9 \U00011df1 \U0001246f \U00012475-\U0001247f \U00012550-\U00012686 "
    "\U00016ea0-\U00016eb8 \U00016ebb-\U00016ed3 \U00016ff2-\U00016ff6 \U000187f8-\U000187ff \U00018cd6-\U00018cda \U00018d09-\U00018d20 \U00018d80-\U00018df2 "
    "\U00018e00-\U00019191 \U000191a0-\U000191d2 \U0001b123-\U0001b128 \U0001b168 \U0001d6a6 \U0001df1f-\U0001df24 \U0001df2b-\U0001df81 \U0001df90-\U0001df96 "
    "\U0001dfcd-\U0001dfff \U0001e6c0-\U0001e6de \U0001e6e0-\U0001e6e2 \U0001e6e4-\U0001e6e5 \U0001e6e7-\U0001e6ed \U0001e6f0-\U0001e6f4 \U0001e6fe-\U0001e6ff "
    "\U0002b73a-\U0002b73f \U0002b81e \U0002cea2-\U0002cead \U000323b0-\U00033479 \U0003d000-\U0003fc3f"
)
_OTHERS = regex.compile(f"[{_NEWER.replace(' ', '')}]")
#: About what an entry of the table costs beside its bytes.
_ENTRY = 220


class BytePairCodec:
    """Tree encoder and decoder over a rank file and a split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF, memory: int = MEMORY):
        self._ranks, self._leaf, self._memory = ranks, max(1, leaf), memory
        self._split = regex.compile(pattern).findall
        self._bytes = {i: b for b, i in ranks.items()}
        self._known: dict[str, list[int]] = {}
        self._old: dict[str, list[int]] = {}
        self._used, self._none = 0, max(ranks.values(), default=0) + 1
        # a token's number is its rank; two tokens merge if what they make together is a token
        self._shift = self._none.bit_length()
        self._first = [ranks.get(bytes([b]), self._none) for b in range(256)]
        self._pairs = {ranks[t[:k]] << self._shift | ranks[t[k:]]: i for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        of = sorted(self._pairs.items())
        self._keys = np.array([*(k for k, _ in of), np.iinfo(np.int64).max])
        self._made = np.array([*(i for _, i in of), self._none])
        self._bytes_first = np.array(self._first)
        self._bytes_made = self._makes(self._bytes_first[:, None], self._bytes_first[None, :])
        self._ids = list(range(self._none + 1))
        self.names = list(map(str, self._ids))

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))

    def encode_all(self, texts: list[str]) -> Iterator[list[int]]:
        seen: list[list[str]] = []
        trees = [self._tree(t, seen) for t in texts]
        self._learn(set().union(*seen))
        return map(self._tokens, trees)

    def _tree(self, text: str, seen: list[list[str]]) -> list | tuple:
        """A leaf's matches, or a node's left half, the left half's end that the window takes, the window's matches, the right half's head in it, and the right half. All matches are also put into `seen`."""
        # the pattern sees characters that are neither letters nor digits to the library as NUL, which is neither
        try:
            plain = text if text.isascii() or text.encode("latin-1") else ""  # none of them is in Latin-1
        except UnicodeEncodeError:
            plain = _OTHERS.sub("\0", text)
        if plain == text:
            plain = text
        return (self._node if _NEXT.search(plain, 1) else self._flat)(text, plain, 0, len(text), seen)

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self._leaf:
            return b"".join(map(self._bytes.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])

    def _node(self, text: str, plain: str, lo: int, hi: int, seen: list[list[str]]) -> list | tuple:
        """The tree of text[lo:hi], which has a sync point."""
        if hi - lo <= self._leaf:
            return self._flat(text, plain, lo, hi, seen)
        mid = (lo + hi) // 2
        left, right = _LAST.search(plain, lo + 1, mid), _NEXT.search(plain, mid + 1, hi)
        if left is None and right is None:
            return self._flat(text, plain, lo, hi, seen)
        cut, end = left.start() if left else lo, right.start() if right else hi
        before = self._node(text, plain, lo, mid, seen) if left else None
        window = self._flat(text, plain, cut, end, seen)
        return before, text[cut:mid], window, text[mid:end], self._node(text, plain, mid, hi, seen) if right else None

    def _flat(self, text: str, plain: str, lo: int, hi: int, seen: list[list[str]]) -> list[str]:
        """The pattern's matches, one after the other."""
        out = self._split(plain[lo:hi])
        if plain is not text:
            for k, match in enumerate(out):
                out[k], lo = text[lo : lo + len(match)], lo + len(match)
        seen.append(out)
        return out

    def _tokens(self, tree: list | tuple) -> list[int]:
        if type(tree) is list:
            try:
                return list(chain.from_iterable(map(self._known.__getitem__, tree)))
            except KeyError:
                return [i for match in tree for i in self._known.get(match) or self._match(match)]
        left, tail, window, head, right = tree
        keep = []
        if left is not None:
            keep = self._tokens(left)
            del keep[self._back(keep, tail) :]
        keep += self._tokens(window)
        if right is not None:
            more = self._tokens(right)
            keep += more[self._on(more, head) :]
        return keep

    def _match(self, match: str) -> list[int]:
        ids = self._old.get(match)
        if ids is None:
            raw = match.encode()
            whole = self._ranks.get(raw)
            ids = [whole] if whole is not None else self._scanned(raw) if len(raw) <= _SCANNED else self._heaped(raw)
        self._keep(match, ids)
        return ids

    def _keep(self, match: str, ids: list[int]) -> None:
        if len(match) <= _SCANNED:
            self._used += _ENTRY + 2 * len(match) + 8 * len(ids)
            if 2 * self._used > self._memory:
                self._old, self._known, self._used = self._known, {}, 0
            self._known[match] = ids

    def _learn(self, matches: set[str]) -> None:
        """Keep the tokens of the short matches among these that are new; any others are merged when they are met."""
        old, ranks, new = self._old, self._ranks, []
        for match in matches.difference(self._known):
            raw = match.encode()
            if match in old or raw in ranks:
                self._match(match)
            elif len(raw) <= _SCANNED:
                new.append((len(raw), raw, match))
        new.sort()
        for at in range(0, len(new), SIDE_BY_SIDE):
            some = new[at : at + SIDE_BY_SIDE]
            for (_, _, match), ids in zip(some, self._side_by_side([raw for _, raw, _ in some])):
                self._keep(match, ids)

    def _makes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that two neighbours make, or none."""
        pair = a << self._shift | b
        at = np.searchsorted(self._keys, pair)
        return np.where(self._keys[at] == pair, self._made[at], self._none)

    def _side_by_side(self, raws: list[bytes]) -> Iterator[list[int]]:
        """Tokens of short matches of two bytes at least or none: in every step, the first of the least pairs of each is merged. Column k stands for the part that begins at byte k."""
        width, many, none = max(map(len, raws)), len(raws), self._none
        data = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raws), np.uint8).reshape(many, width)
        size = np.fromiter(map(len, raws), np.int64, many)
        ids, made = self._bytes_first[data], np.full((many, width), none)
        made[:, :-1] = self._bytes_made[data[:, :-1], data[:, 1:]]
        made[np.arange(width) >= size[:, None] - 1] = none
        after, before = np.tile(np.arange(1, width + 1), (many, 1)), np.tile(np.arange(-1, width - 1), (many, 1))
        stands, rows = np.arange(width) < size[:, None], np.arange(many)
        while len(rows):
            k = made[rows].argmin(1)
            least = made[rows, k]
            on = least < none
            rows, k, least = rows[on], k[on], least[on]
            gone = after[rows, k]
            then, back = after[rows, gone], before[rows, k]
            ids[rows, k], after[rows, k], stands[rows, gone] = least, then, False
            made[rows, k] = made[rows, gone] = none
            has = then < size[rows]
            r, c, t = rows[has], k[has], then[has]
            before[r, t] = c
            made[r, c] = self._makes(least[has], ids[r, t])
            has = back >= 0
            r, c = rows[has], back[has]
            made[r, c] = self._makes(ids[r, c], least[has])
        # numbers that the table's lists share
        flat, ends = list(map(self._ids.__getitem__, ids[stands].tolist())), np.cumsum(stands.sum(1)).tolist()
        return (flat[at:end] for at, end in zip([0, *ends], ends))

    def _scanned(self, raw: bytes) -> list[int]:
        """Tokens of a short match: the least of all pairs is looked for again after each merge."""
        get, none, shift = self._pairs.get, self._none, self._shift
        ids = [self._first[b] for b in raw]
        pairs = [get(a << shift | b, none) for a, b in zip(ids, ids[1:])]
        while pairs and (least := min(pairs)) != none:
            k = pairs.index(least)
            ids[k] = least
            del ids[k + 1], pairs[k]
            if k:
                pairs[k - 1] = get(ids[k - 1] << shift | least, none)
            if k < len(pairs):
                pairs[k] = get(least << shift | ids[k + 1], none)
        return ids

    def _heaped(self, raw: bytes) -> list[int]:
        """Tokens of a long match, the same: pairs wait in a heap over a linked list of parts."""
        ranks, n = self._ranks, len(raw)
        # part k goes from k to after[k]; `before` of a part that was merged away is -2
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k) for k in range(n - 1) if (r := ranks.get(raw[k : k + 2])) is not None]
        heapify(heap)
        while heap:
            r, k = heappop(heap)
            if before[k] == -2 or (middle := after[k]) >= n or ranks.get(raw[k : after[middle]]) != r:
                continue  # one of the two has grown or gone
            end = after[k] = after[middle]
            before[middle] = -2
            if end < n:
                before[end] = k
                if (r := ranks.get(raw[k : after[end]])) is not None:
                    heappush(heap, (r, k))
            if (back := before[k]) >= 0 and (r := ranks.get(raw[back:end])) is not None:
                heappush(heap, (r, back))
        out, k = [], 0
        while k < n:
            out.append(ranks[raw[k : after[k]]])
            k = after[k]
        return out

    def _back(self, ids: list[int], tail: str) -> int:
        """How many of the tokens stand before `tail`."""
        at, n = len(ids), len(tail.encode())
        while n > 0:
            at -= 1
            n -= len(self._bytes[ids[at]])
        if n:
            raise AssertionError("a sync point inside a token")
        return at

    def _on(self, ids: list[int], head: str) -> int:
        """How many of the tokens make up `head`."""
        at, n = 0, len(head.encode())
        while n > 0:
            n -= len(self._bytes[ids[at]])
            at += 1
        if n:
            raise AssertionError("a sync point inside a token")
        return at


@lru_cache(maxsize=4)
def codec(path: str, pattern: str, leaf: int = LEAF) -> BytePairCodec:
    """One codec for each worker process and vocabulary."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return BytePairCodec(ranks, pattern, leaf)


def _together(texts: list[str]) -> Iterator[list[str]]:
    """Texts in lists of about TOGETHER characters."""
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t)
        if size >= TOGETHER:
            yield some
            some, size = [], 0
    if some:
        yield some


def _over_texts(df: DataFrame, id_col: str, text_col: str, of: Callable[[list[str]], Iterable[tuple]], schema: str, types: list[pa.DataType], names: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for some in _together(batch.column(1).to_pylist()) for r in of(some)]
            cols = list(zip(*rows)) if rows else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names=["doc_id", *names])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), text_column(text_col).alias("text")).mapInArrow(run, f"doc_id long, {schema}")


def encode_documents(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """doc_id and `ids`, the token ids of every whole text."""
    return _over_texts(df, id_col, text_col, lambda texts: ((ids,) for ids in codec(path, pattern, leaf).encode_all(texts)), "ids array<int>", [pa.list_(pa.int32())], ["ids"])


def decode_documents(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids", leaf: int = LEAF) -> DataFrame:
    """doc_id and `data`, the bytes that `ids` stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern, leaf)
        for batch in batches:
            data = [own.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, data binary")


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """Encode, digest, decode the ids again and digest: doc_id, n_tokens, ids_sha256, decoded_sha256.

    The ids stay inside the worker, so that a table of them is not moved for two digests.
    """

    def of(texts: list[str]) -> Iterator[tuple[int, str, str]]:
        own = codec(path, pattern, leaf)
        for ids in own.encode_all(texts):
            yield len(ids), hashlib.sha256(" ".join(map(own.names.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()

    return _over_texts(df, id_col, text_col, of, "n_tokens long, ids_sha256 string, decoded_sha256 string", [pa.int64(), pa.string(), pa.string()], ["n_tokens", "ids_sha256", "decoded_sha256"])
