"""Packing by power-of-two decomposition: pieces of binary lengths, equal lengths in one bucket.

A document's ids and an end mark are cut into pieces of `longest` ids and, for what
is left, of the powers of two in its binary form, the largest first. A piece is a
sequence of its own, so no sequence crosses documents and none has padding; a
training batch takes sequences of one bucket, that is of one length.

Sequences are numbered from 0 without gaps, bucket after bucket. The numbers are
counts before a task and a bucket, plus places counted inside the task, so nothing
is sorted and only one row for each task and bucket is summed up in one place.

Null text counts as empty: its document is the end mark alone, one piece of length
1. An empty table has no pieces. Repeated rows, and rows with a null or repeated
id, are documents of their own. Very long texts cost memory in proportion to their
own length; texts are never cut before they are encoded. Columns other than the id
and the text, whatever their names, are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save, text_column

#: Fixed value: the id that ends a document.
END = 2
LONGEST = 4096
#: Bytes of words and their ids that a worker remembers; beyond it, it starts anew.
REMEMBERED_BYTES = 160 << 20
#: Bytes of ids in one result batch, and characters encoded together.
BATCH_BYTES, BATCH_CHARS = 8 << 20, 1 << 20
#: Bytes of a remembered word beside its characters and ids.
_ENTRY = 200

#: ASCII marks that stand apart from a letter or digit beside them. An apostrophe may belong to what follows it.
MARKS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
#: Words of letters that normalisation leaves as they are but for their case, and that the pattern takes as one match.
PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: Plain words that are encoded as one text.
JOINED = 1000

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, part int, place long"


def lengths(n: int, longest: int = LONGEST) -> list[int]:
    """The pieces of n ids, in order."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


class WordEncoder:
    """A tokenizer that drops white space, so a text's ids are those of its words between spaces, one after another.

    Each distinct word goes through the library once, without the marks around it, which are words of their own where
    a letter or digit stands beside them. Plain words go through it in lower case and many at once, past its normaliser
    and its pattern, and are told apart by their last ids, which end a word. Ids are little-endian unsigned 32-bit numbers.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED_BYTES):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        self.library, self.known, self.held, self.most = Tokenizer.from_file(path), {"": b""}, 0, remembered
        rules = json.loads(self.library.to_str())
        rules |= {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}}
        self.model, suffix = Tokenizer.from_str(json.dumps(rules | {"added_tokens": []})), rules["model"]["end_of_word_suffix"]
        self.ends = np.zeros(max(rules["model"]["vocab"].values()) + 1, bool)
        self.ends[[i for t, i in rules["model"]["vocab"].items() if t.endswith(suffix)]] = True

    def _keep(self, word: str, ids: bytes) -> None:
        self.known[word] = ids
        self.held += len(word) + len(ids) + _ENTRY

    def _keep_plain(self, words: list[str]) -> None:
        some = [words[at : at + JOINED] for at in range(0, len(words), JOINED)]
        for own, e in zip(some, self.model.encode_batch_fast([" ".join(x).lower() for x in some], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            raw, ends = ids.tobytes(), ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            for w, at, end in zip(own, [0, *ends], ends, strict=False):
                self._keep(w, raw[at:end])
            if len(ends) != len(own) or ends[-1] != len(raw):
                raise AssertionError("a plain word without an id that ends it, or with two")

    @staticmethod
    def pieces(word: str) -> tuple[str, str, str] | None:
        """Marks, core and marks, if their ids follow one another; a special token's string stays whole."""
        core = word.strip(MARKS)
        if not core or len(core) == len(word) or "<|" in word or not all(c.isalnum() and c < "\u0300" for c in (core[0], core[-1])):
            return None
        at = word.index(core)
        return word[:at], core.lower() if core.isascii() else core, word[at + len(core) :]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        words = [t.replace("\n", " ").split(" ") for t in texts]
        if self.held > self.most:
            self.known, self.held = {"": b""}, 0
        known = self.known
        new = {w: None if w.isalpha() else self.pieces(w) for w in set().union(*words).difference(known)}
        lone = {p for w, cut in new.items() for p in cut or (w,) if p not in known}
        plain = list(filter(PLAIN.fullmatch, lone))
        self._keep_plain(plain)
        whole = list(lone.difference(plain))
        for w, e in zip(whole, self.library.encode_batch_fast(whole, add_special_tokens=False)):
            self._keep(w, struct.pack(f"<{len(e.ids)}I", *e.ids))
        for w, cut in new.items():
            if cut:
                self._keep(w, b"".join([known[p] for p in cut]))
        return (b"".join(map(known.__getitem__, x)) for x in words)


def _batches(rows: Iterable[tuple], size: int) -> Iterator[list[tuple]]:
    """Rows (id, text) in lists of about `size` characters."""
    out, held = [], 0
    for row in rows:
        out.append(row)
        held += len(row[1])
        if held >= size:
            yield out
            out, held = [], 0
    if out:
        yield out


def pieces(docs: DataFrame, path: str, end: int = END, longest: int = LONGEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCHEMA: a row for each piece. `part` and `place` number the pieces of a task and a bucket."""
    if longest < 1 or longest & longest - 1:
        raise ValueError("the longest piece must be a power of two")
    mark = struct.pack("<I", end)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64()]

    def table(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = WordEncoder(path), TaskContext.get().partitionId(), Counter()
        rows = (row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        out, held = [], 0
        for some in _batches(rows, BATCH_CHARS):
            for (key, _), ids in zip(some, encoder.encode([t for _, t in some])):
                ids += mark
                n, start = len(ids) // 4, 0
                for length in lengths(n, longest):
                    out.append((key, start, length, ids[4 * start : 4 * (start + length)], n, part, seen[length]))
                    seen[length] += 1
                    start += length
                    held += 4 * length + _ENTRY
                    if held >= BATCH_BYTES:
                        yield table(out)
                        out, held = [], 0
        if out:
            yield table(out)

    return docs.select(F.col(id_col).cast("long"), text_column(text_col)).mapInArrow(cut, SCHEMA)


def numbered(rows: DataFrame) -> DataFrame:
    """Adds sequence_id to pieces that are stored, so that part and place stay as they are; drops these two."""
    counts = rows.groupBy("length", "part").agg((F.max("place") + 1).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("length", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = counts.select("length", "part", before.alias("first"))
    return rows.join(first, ["length", "part"]).withColumn("sequence_id", F.col("first") + F.col("place")).drop("part", "place", "first")


def pack(docs: DataFrame, path: str, end: int = END, longest: int = LONGEST, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, start, length, ids (or, with `digest`, ids_crc32), doc_tokens, sequence_id, offset.

    length is also the bucket. Pieces are written to the shared folder once, the ids only where they are asked for.
    """
    rows = pieces(docs, path, end, longest, id_col, text_col)
    if digest:
        rows = rows.withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32")
    out = numbered(save(rows, "pieces"))
    return out.select("doc_id", "start", "length", "ids_crc32" if digest else "ids", "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder for each length, as a loader reads it; no shuffle."""
    packed.withColumn("bucket", F.col("length")).write.partitionBy("bucket").parquet(path)
