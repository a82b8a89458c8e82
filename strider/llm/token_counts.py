"""Exact token counts at every prefix of a text, by dynamic programming.

For one pre-token, `last[i]` is the last token of the encoding of its first i
bytes. It is the token t that ends at i for which (last[i - len(t)], t) is a pair
that the encoder leaves as it is: an encoding is right exactly if all its
neighbours are, so one such t exists, and

    count[i] = count[i - len(t)] + 1.

A text's counts follow from its pre-tokens, with the places where a prefix is
split otherwise than the whole text:

* white space at the end of a prefix is one pre-token of its own, from the start
  of that white space;
* a contraction cut before its last letter is an apostrophe and a letter;
* a special token's string that is not complete is ordinary text.

The counts answer how many tokens a cut text has and how far a budget reaches
without encoding anything again. Prefixes end between characters; there is one
more count than characters, and the first is 0.

Null text counts as empty: one prefix of no tokens. Repeated rows give repeated
results. Very long texts cost memory in proportion to their own length. Other
columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_column

#: Pre-tokens in each of two generations that a worker remembers; what is in neither is worked out again.
REMEMBERED = 400_000
LONGEST_REMEMBERED = 64
PAIRS = 2_000_000

#: Fixed value: the split pattern of the byte-level pre-tokenizer.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_THREE = {"'re", "'ve", "'ll"}


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PrefixCounter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters = _byte_letters()
        to_bytes = lambda s: bytes(letters[c] for c in s)
        self._special = [x["content"] for x in file.get("added_tokens", [])]
        self._vocab = {to_bytes(s): i for s, i in file["model"]["vocab"].items() if s not in self._special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
        self._merge = {(to_bytes(x), to_bytes(y)): k for k, (x, y) in enumerate(merges)}
        whole = [b for b in self._vocab if self._merged(b) == [b]]
        self._ends: dict[bytes, tuple[int, ...]] = {}
        for b in whole:  # lengths of the tokens that end with these two bytes
            self._ends.setdefault(b[-2:], {1}).add(len(b))
        self._ends = {k: tuple(sorted(v, reverse=True)) for k, v in self._ends.items()}
        self._names = whole
        self._tokens = {b: k for k, b in enumerate(whole)}
        self._pairs: dict[int, bool] = {}
        self._known: dict[str, tuple[int, bytes | list[int]]] = {}
        self._older: dict[str, tuple[int, bytes | list[int]]] = {}
        self._split = regex.compile(SPLIT)
        self._runs = regex.compile(r"\s\s+")
        self._marks = regex.compile("|".join(map(regex.escape, self._special))) if self._special else None

    def _merged(self, data: bytes) -> list[bytes]:
        """The merges by rank, on a few bytes."""
        got = [data[i : i + 1] for i in range(len(data))]
        while len(got) > 1:
            best = min(range(len(got) - 1), key=lambda i: self._merge.get((got[i], got[i + 1]), 1 << 60))
            if (got[best], got[best + 1]) not in self._merge:
                break
            a, b = got[best], got[best + 1]
            out, i = [], 0
            while i < len(got):
                if i + 1 < len(got) and got[i] == a and got[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(got[i])
                    i += 1
            got = out
        return got

    def _stays(self, a: int, b: int) -> bool:
        if len(self._pairs) > PAIRS:
            self._pairs.clear()
        two = [self._names[a], self._names[b]]
        known = self._pairs[a << 20 | b] = self._merged(b"".join(two)) == two
        return known

    def piece(self, data: bytes) -> list[int]:
        """Counts at the ends of all byte prefixes of one pre-token, 0 first."""
        count, last = [0], [0]
        tokens, pairs, ends, one = self._tokens.get, self._pairs.get, self._ends.get, (1,)
        grown = 0
        for i in range(1, len(data) + 1):
            # Only one length can be right, so the likeliest goes first: the last token and one more byte.
            grown += 1
            t = tokens(data[i - grown : i])
            if t is not None and (grown == i or pairs(last[i - grown] << 20 | t)):
                count.append(count[i - grown] + 1)
                last.append(t)
                continue
            for n in ends(data[i - 2 : i], one) if i > 1 else one:
                if n > i:
                    continue
                t = tokens(data[i - n : i])
                if t is None:
                    continue
                if n < i:
                    stays = pairs(last[i - n] << 20 | t)
                    if not (self._stays(last[i - n], t) if stays is None else stays):
                        continue
                count.append(count[i - n] + 1)
                last.append(t)
                grown = n
                break
            else:
                raise AssertionError("no token ends here")
        return count

    def _chars(self, piece: str) -> tuple[int, bytes | list[int]]:
        """Tokens of a pre-token, and its counts after each character."""
        data = piece.encode()
        counts = self.piece(data)
        at, out = 0, []
        if len(data) == len(piece):
            out = counts[1:]
        else:
            for c in piece:
                at += len(c.encode())
                out.append(counts[at])
        if piece in _THREE:
            out = [1, 2, out[2]]
        return counts[-1], (bytes(out) if counts[-1] < 256 and max(out) < 256 else out)

    def _of(self, piece: str) -> tuple[int, bytes | list[int]]:
        got = self._known.get(piece) or self._older.pop(piece, None) or self._chars(piece)
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self._known) >= REMEMBERED:
                self._known, self._older = {}, self._known
            self._known[piece] = got
        return got

    def _ordinary(self, text: str) -> np.ndarray:
        """Counts after each character of a text without special tokens."""
        pieces = self._split.findall(text)
        known, of = self._known.get, self._of
        got = [known(p) or of(p) for p in pieces]
        if not got:
            return np.zeros(0, np.int64)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        totals = np.fromiter((g[0] for g in got), np.int64, len(got))
        before = np.cumsum(totals) - totals
        try:
            inner = np.frombuffer(b"".join([g[1] for g in got]), np.uint8).astype(np.int64)
        except TypeError:
            inner = np.concatenate([np.frombuffer(g[1], np.uint8) if isinstance(g[1], bytes) else np.array(g[1], np.int64) for g in got]).astype(np.int64)
        out = inner + np.repeat(before, lengths)
        # Where a prefix ends in white space: that run by itself, after what stands before it.
        for m in self._runs.finditer(text):
            base = int(out[m.start() - 1]) if m.start() else 0
            out[m.start() : m.end()] = base + np.asarray([*self._of(m[0])[1]], np.int64)
        return out

    def counts(self, text: str) -> np.ndarray:
        """One count for each prefix, from the empty one to the whole text."""
        done, total, at = [np.zeros(1, np.int64)], 0, 0
        for m in self._marks.finditer(text) if self._marks else ():
            segment = text[at : m.start()]
            own = self._ordinary(segment + m[0][:-1])
            exact = self._ordinary(segment)
            before = int(exact[-1]) if len(exact) else 0
            done += [total + exact, total + own[len(segment) :], np.array([total + before + 1])]
            total += before + 1
            at = m.end()
        rest = self._ordinary(text[at:])
        done.append(total + rest)
        return np.concatenate(done)


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    """One for each worker process and vocabulary."""
    return PrefixCounter(path)


def prefix_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and `counts`, an array with one exact token count for each prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            rows = [own.counts(t).astype(np.int32) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], names=["doc_id", "counts"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), text_column(text_col).alias("text")).mapInArrow(run, "doc_id long, counts array<int>")


def budgets(df: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What the prefix counts say about a budget of `limit` tokens.

    doc_id, n_bytes, n_tokens, over_limit, and fit_chars: the characters of the
    longest prefix within the budget. The table of counts is read where it is made.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            tokens, fit = [], []
            for t in batch.column(1).to_pylist():
                c = own.counts(t)
                tokens.append(int(c[-1]))
                fit.append(int(np.flatnonzero(c <= limit)[-1]) if c[-1] > limit else len(t))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens]), pa.array(fit, pa.int64())], names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    text = text_column(text_col)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")
