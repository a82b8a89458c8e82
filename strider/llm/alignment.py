"""Cross-tokenizer alignment as joins of token tables.

Two tokenizers A and B cut the same bytes. The relational core, align(), takes keys
with both token lists: posexplode gives a row for each token, a windowed sum of byte
lengths gives its end, and an equi-join on key and end gives the links: tokens of A and
B that end together. Every such end is a cut; the running count of cuts before a token
is the number of its group, and groups of A and B meet by a join on it.

**Keys.** Neither tokenizer has a token across a single space between two other
characters, so both end a token before each such space, and an alignment of a text is
that of its segments, one after another. The keys of align() are therefore the distinct
segments of the corpus, encoded by the libraries themselves, with the number of their
occurrences; the explode, windows and joins see a segment once. That B's vocabulary keeps
to spaces is checked; if it does not, segments are whole texts.

**Documents.** Texts are taken together in parts of about PART_BYTES; a document is kept
as the numbers of its segments in its part. Sums and groups of segments are joined to the
parts by the numbers that a segment keeps of all the parts that have it, one for each, and
come back to documents by a cogrouped map over the part's number, whose
two sides are bounded by the part's bytes (or one text's). What is moved is a number for
each place of a segment, never a token, and a segment's text only until it has a key.

**Counts.** A pair's count is the number of links of the whole corpus that hold it: sums
over segments times occurrences.

**Values.** Token bytes: A's byte-level letters decoded; B's piece in UTF-8 with U+2581
as a space, or the byte of <0xHH>. A text that is null or empty, or whose joined bytes of
A or B differ from a space and the text, has no tokens, links nor groups and counts
nowhere. Special strings inside texts are plain text. Repeated rows, and rows with null
or repeated ids, are documents of their own. An empty table gives an empty result. Very
long texts cost memory in proportion to their own length. Other columns of the input,
whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, parts, release, save, text_column

#: Bytes of text in one part.
PART_BYTES = 24 << 20
#: Segments given to the libraries at once.
AT_ONCE = 1 << 14
#: Rows that a task packs together.
PACKED = 1 << 18
#: Segments whose tokens are dealt to one task.
KEYS = 100_000
#: Token rows are made, moved and grouped for this share of the segments at a time, which bounds the shuffle files on disk.
WAVES = 4
#: A single space between two characters that neither Python nor older Unicode takes for white space.
CUT = re.compile(r"(?<=[^\s᠎]) (?=[^\s᠎])")
SPACE = "▁"
_HEX = re.compile(r"<0x([0-9A-F]{2})>\Z")

#: A token in an array is its id times this, plus its bytes.
SHIFT = 32
SUMS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"

def _byte_of_letter() -> dict[str, int]:
    """Printable bytes stand for themselves in a byte-level vocabulary, the others are numbered from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pair:
    """The two tokenizers: ids and token bytes of text, each with the space before it."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        letters = _byte_of_letter()
        self.bytes_a = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = {i: bytes([int(m[1], 16)]) if (m := _HEX.match(p)) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)}
        one = [{v for v in of.values() if len(v) == 1} for of in (self.bytes_a, {i: v for i, v in self.bytes_b.items() if _HEX.match(pieces[i])})]
        self.all_bytes = all(len(x) == 256 for x in one)
        self.by_words = not any(SPACE in p.lstrip(SPACE) for p in pieces)

    def plain(self, text: str) -> bool:
        """Whether the joined bytes surely agree: B's normalised form is the text, and both have a token for each byte."""
        return self.all_bytes and SPACE not in text and self.b.normalize(text) == SPACE + text.replace(" ", SPACE)

    def split(self, text: str) -> list[str]:
        return CUT.split(text) if self.by_words else [text]

    def encode(self, segments: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        for at in range(0, len(segments), AT_ONCE):
            some = segments[at : at + AT_ONCE]
            a = self.a.encode_batch_fast([" " + s for s in some], add_special_tokens=False)
            yield from zip((e.ids for e in a), self.b.encode(some, num_threads=1))

    def agrees(self, segment: str, a: list[int], b: list[int]) -> bool:
        raw = b" " + segment.encode()
        return self.joined(a) == raw and self.joined(b, b=True) == raw

    def joined(self, ids: list[int], b: bool = False) -> bytes:
        return b"".join(map((self.bytes_b if b else self.bytes_a).__getitem__, ids))


@lru_cache(maxsize=2)
def _pair(path_a: str, path_b: str) -> Pair:
    """Of this worker."""
    return Pair(path_a, path_b)


def _part(pair: Pair, texts: list[str]) -> tuple[list[bytes], list[str], np.ndarray]:
    """Places of each text's segments, the distinct segments, and how often each occurs in texts that have tokens."""
    number: dict[str, int] = {}
    places = [np.fromiter((number.setdefault(s, len(number)) for s in x), np.int32, len(x)) for x in (pair.split(t) if t else [] for t in texts)]
    segments, n = list(number), np.zeros(len(number), np.int64)
    doubtful = [k for k, t in enumerate(texts) if t and not pair.plain(t)]
    some = np.unique(np.concatenate([places[k] for k in doubtful])) if doubtful else []
    bad = np.zeros(len(number), bool)
    for k, (a, b) in zip(some, pair.encode([segments[k] for k in some])):
        bad[k] = not pair.agrees(segments[k], a, b)
    for k in doubtful:
        if bad[places[k]].any():  # some bytes differ: no tokens
            places[k] = places[k][:0]
    for at in places:
        np.add.at(n, at, 1)
    packer = zstandard.ZstdCompressor(level=1)
    return [packer.compress(at.tobytes()) for at in places], segments, n


def cut(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES) -> tuple[DataFrame, DataFrame]:
    """(documents, segments), stored in the shared folder, each in a table of its own.

    documents: part, doc_id, places (numbers of segments as little-endian 32-bit integers, in a zstd frame). segments: part, number, n,
    segment, for those that occur in a text with tokens.
    """
    schema = pa.schema([("part", pa.int64()), ("doc_id", pa.int64()), ("places", pa.binary()), ("number", pa.int32()), ("n", pa.int64()), ("segment", pa.string())])

    def rows(part: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        places, segments, n = _part(_pair(path_a, path_b), [t for _, t in held])
        m, none = len(held), lambda k, m: pa.nulls(m, schema.types[k])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(m, part)), pa.array([d for d, _ in held], pa.int64()), pa.array(places, pa.binary()), none(3, m), none(4, m), none(5, m)], schema=schema)
        for at in range(0, len(segments), AT_ONCE):
            own = np.flatnonzero(n[at : at + AT_ONCE]) + at
            m = len(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, part)), none(1, m), none(2, m), pa.array(own.astype(np.int32)), pa.array(n[own]), pa.array([segments[k] for k in own], pa.string())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, part = [], 0, TaskContext.get().partitionId() << 24
        for b in batches:
            for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.append(row)
                size += len(row[1].encode())
                if size >= part_bytes:
                    yield from rows(part, held)
                    held, size, part = [], 0, part + 1
        if held:
            yield from rows(part, held)

    both = save(docs.select(F.col(id_col).cast("long"), text_column(text_col)).mapInArrow(run, "part long, doc_id long, places binary, number int, n long, segment string"), "segments")
    documents = save(both.where("places is not null").select("part", "doc_id", "places"), "places")
    segments = both.where("segment is not null").select("part", "number", "n", "segment")
    segments.saved_path = both.saved_path
    return documents, segments


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by the first column, and where each of its values begins; all rows of a value come together."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        t = t.combine_chunks()
        if t.num_rows < 2:
            held = t
            continue
        value = t.column(0)
        begins = np.flatnonzero(np.append(True, pc.not_equal(value.slice(1), value.slice(0, t.num_rows - 1)).to_numpy()))
        if len(begins) > 1:
            yield t.slice(0, begins[-1]), begins[:-1]
        held = t.slice(begins[-1])
    if held is not None and held.num_rows:
        yield held, np.zeros(1, np.int64)


def encoded(segments: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """key, wave, n (over all parts), of_part and number (arrays: the parts that have the segment and its number there), a, b (arrays of ids with lengths, see SHIFT) of the distinct segments, stored.

    A task's segments are of one wave, so a wave's rows are whole files and the scan skips the others.
    """

    def lists(ids: list[list[int]], of: dict[int, bytes]) -> pa.ListArray:
        flat = [i << SHIFT | len(of[i]) for x in ids for i in x]
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(flat, pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, task = _pair(path_a, path_b), TaskContext.get().partitionId()
        key = task << 40
        for t, begins in _runs(batches):
            t = t.combine_chunks()
            segment, part, number, n = (t.column(k).chunk(0) for k in range(4))
            one, two = zip(*pair.encode(segment.take(pa.array(begins)).to_pylist()))
            ends = pa.array(np.append(begins, t.num_rows), pa.int32())
            of = [pa.ListArray.from_arrays(ends, c) for c in (part, number)]
            wave, sums = pa.array(np.full(len(one), task % WAVES, np.int32)), pa.array(np.add.reduceat(n.to_numpy(), begins))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(key, key + len(one))), wave, sums, *of, lists(one, pair.bytes_a), lists(two, pair.bytes_b)], ["key", "wave", "n", "of_part", "number", "a", "b"])
            key += len(one)

    alike = segments.select("segment", "part", "number", "n").repartition("segment").sortWithinPartitions("segment")
    return save(alike.mapInArrow(run, "key long, wave int, n long, of_part array<bigint>, number array<int>, a array<bigint>, b array<bigint>"), "encoded")


def tokens(rows: DataFrame, side: str, keys: list[str]) -> DataFrame:
    """keys, pos, id, end: a row for each token of the array `side`; end is the windowed sum of byte lengths up to it."""
    token = F.col("token")
    each = rows.select(*keys, F.posexplode(side).alias("pos", "token")).select(*keys, "pos", F.shiftright(token, SHIFT).cast("int").alias("id"), token.bitwiseAND((1 << SHIFT) - 1).alias("len"))
    upto = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return each.select(*keys, "pos", "id", F.sum("len").over(upto).alias("end"))


def grouped(own: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pos, id, end, group, link: tokens with their group and the id of the other side's token that ends with them, or null.

    A link is a cut; a token's group is the number of cuts before it.
    """
    linked = own.join(other.select(*keys, "end", F.col("id").alias("link")), [*keys, "end"], "left")
    before = Window.partitionBy(*keys).orderBy("end").rowsBetween(Window.unboundedPreceding, -1)
    return linked.withColumn("group", F.coalesce(F.sum(F.col("link").isNotNull().cast("long")).over(before), F.lit(0).cast("long")))


def align(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(links, groups) of rows with keys, a, b (arrays as encoded() has them; tokens have one byte at least).

    links: keys, end, a_id, b_id; groups: keys, group (from 0), a, b, the arrays of ids between neighbouring cuts.
    """
    a, b = tokens(rows, "a", keys), tokens(rows, "b", keys)
    of_a, of_b = grouped(a, b, keys), grouped(b, a, keys)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"])
    lists = [t.groupBy(*keys, "group").agg(ids.alias(c)) for t, c in ((of_a, "a"), (of_b, "b"))]
    return of_a.where("link is not null").select(*keys, "end", F.col("id").alias("a_id"), F.col("link").alias("b_id")), lists[0].join(lists[1], [*keys, "group"])


@contextmanager
def _dealt_by_key(spark: SparkSession) -> Iterator[None]:
    """Joins on key and end use rows that are dealt by key alone: keys are many and none is large."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    old = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, old)


def _by_key(grouped_tokens: DataFrame, text: str) -> DataFrame:
    """key, `text` (ids with a comma inside a group and a semicolon between groups), own, link: the linked ids.

    The rows of a key lie together in one task, in order, as the window leaves them; a key that goes on in the next
    batch is held back until its last row is there.
    """

    def made(t: pa.Table) -> pa.RecordBatch:
        key, group = t["key"].to_numpy(), t["group"].to_numpy()
        first = np.diff(key, prepend=key[0] - 1) != 0
        mark = np.where(first, "", np.where(np.diff(group, prepend=-1) != 0, ";", ","))
        words = pc.binary_join_element_wise(pa.array(mark, pa.string()), t["id"].combine_chunks().cast(pa.string()), "")
        begins = np.flatnonzero(first)
        offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4)
        texts = pa.StringArray.from_buffers(len(begins), pa.py_buffer(np.append(offsets[begins], offsets[-1])), words.buffers()[2])
        linked = t["link"].is_valid().to_numpy()
        ends = pa.array(np.append(np.concatenate([[0], np.cumsum(linked)])[begins], linked.sum()), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, c.combine_chunks().filter(pa.array(linked))) for c in (t["id"], t["link"])]
        return pa.RecordBatch.from_arrays([pa.array(key[begins]), texts, *lists], ["key", text, "own", "link"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(0).to_numpy()
            done = int(np.flatnonzero(keys == keys[-1])[0])  # where the last key begins
            if done or (held and held[-1].column(0)[-1].as_py() != keys[0]):
                yield made(pa.Table.from_batches([*held, b.slice(0, done)]))
                held = []
            held.append(b.slice(done))
        if held:
            yield made(pa.Table.from_batches(held))

    return grouped_tokens.select("key", "group", "id", "link").mapInArrow(run, f"key long, {text} string, own array<int>, link array<int>")


def pair_counts(found: DataFrame) -> DataFrame:
    """a_id, b_id, count, best of links with their number n: all links that hold a pair, and whether no pair of this b_id has more."""
    counts = found.groupBy("a_id", "b_id").agg(F.sum("n").alias("count"))
    most = counts.groupBy("b_id").agg(F.max("count").alias("most"))
    return counts.join(most, "b_id").select("a_id", "b_id", "count", (F.col("count") == F.col("most")).alias("best"))


def _groups_of(rows: DataFrame, many: int) -> DataFrame:
    """key, n, of_part, number, n_a, n_b, n_groups, groups, own, link (the linked ids) of `many` encoded segments."""
    dealt = rows.repartition(max(parts(rows.sparkSession), -(-many // KEYS)), "key")
    a, b = tokens(dealt, "a", ["key"]), tokens(dealt, "b", ["key"])
    of_a, of_b = _by_key(grouped(a, b, ["key"]), "text"), _by_key(grouped(b, a, ["key"]), "other").select("key", "other")
    size = lambda c: F.size(c).cast("long")
    texts = F.zip_with(F.split("text", ";"), F.split("other", ";"), lambda x, y: F.concat(x, F.lit("|"), y))
    each = of_a.join(of_b, "key").join(rows.select("key", "n", "of_part", "number", size("a").alias("n_a"), size("b").alias("n_b")), "key")
    return each.select("key", "n", "of_part", "number", "n_a", "n_b", size(F.split("text", ";")).alias("n_groups"), F.array_join(texts, ";").alias("groups"), "own", "link")


def segment_results(rows: DataFrame) -> list[DataFrame]:
    """Blocks of encoded segments' results by part, see _packed(), in stored tables, one for each wave.

    `rows`, a table of save(), is deleted once its groups are stored; a wave's groups once its blocks are.
    """
    spark = rows.sparkSession
    sizes, waves = dict(rows.groupBy("wave").count().collect()), {}  # at most WAVES rows
    for w, many in sorted((sizes or {0: 0}).items()):
        with _dealt_by_key(spark):
            waves[w] = save(_groups_of(rows.where(F.col("wave") == w), many), "groups")
        release(spark)
    forget(rows)
    pairs = reduce(DataFrame.unionByName, waves.values()).select("key", "n", F.explode(F.arrays_zip("own", "link")).alias("x")).select("key", "n", F.col("x.own").alias("a_id"), F.col("x.link").alias("b_id"))
    counts = save(pair_counts(pairs), "pairs")
    release(spark)
    sums = pairs.join(counts, ["a_id", "b_id"]).groupBy("key").agg(F.count(F.lit(1)).alias("n_links"), F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("count").alias("count_sum"))
    sums = save(sums, "sums")
    forget(counts)
    release(spark)
    blocks = []
    for w, found in waves.items():
        known = found.drop("n", "own", "link").join(sums.where(F.pmod(F.shiftright("key", 40), F.lit(WAVES)) == w), "key")
        known = known.withColumn("at", F.explode(F.arrays_zip("of_part", "number"))).select(F.col("at.of_part").alias("of_part"), F.col("at.number").alias("number"), *SUMS, "groups")
        blocks.append(save(_packed(known), "blocks"))
        forget(found)
        release(spark)
    forget(sums)
    return blocks


def _packed(known: DataFrame) -> DataFrame:
    """of_part, block: the rows (number, SUMS, groups) of a task by part, as compressed Arrow streams; far less to move than rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held).sort_by("of_part")
            of = t["of_part"].to_numpy()
            begins = np.flatnonzero(np.diff(of, prepend=of[0] - 1))
            blocks = []
            for at, end in zip(begins, np.append(begins[1:], len(of))):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(t.slice(at, end - at))
                blocks.append(sink.getvalue().to_pybytes())
            return pa.RecordBatch.from_arrays([pa.array(of[begins]), pa.array(blocks, pa.binary())], ["of_part", "block"])

        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= PACKED:
                yield made(held)
                held, n = [], 0
        if n:
            yield made(held)

    return known.mapInArrow(run, "of_part long, block binary")


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, part_bytes: int = PART_BYTES) -> DataFrame:
    """ALIGNED: a row for each document; groups as `a1,a2|b1;a3|b2`, or with `digest` its SHA-256 in hex ('' without tokens)."""
    documents, segments = cut(docs, path_a, path_b, id_col, text_col, part_bytes)
    rows = encoded(segments, path_a, path_b)
    forget(segments)
    release(docs.sparkSession)
    blocks = reduce(DataFrame.unionByName, segment_results(rows))

    def put_together(left: pa.Table, right: pa.Table) -> pa.Table:
        own_blocks = [pa.ipc.open_stream(b).read_all() for b in right["block"].to_pylist()]
        at = np.concatenate([b["number"].to_numpy() for b in own_blocks] or [np.zeros(0, np.int64)])
        table = np.zeros((at.max(initial=-1) + 1, len(SUMS)), np.int64)
        strings = [""] * len(table)
        for b in own_blocks:
            own = b["number"].to_numpy()
            table[own] = np.stack([b[c].to_numpy() for c in SUMS], 1)
            for k, s in zip(own.tolist(), b["groups"].to_pylist()):
                strings[k] = s
        out, texts, unpacker = [], [], zstandard.ZstdDecompressor()
        for data in left["places"].to_pylist():
            own = np.frombuffer(unpacker.decompress(data), np.int32)
            out.append(table[own].sum(0))
            text = ";".join([strings[k] for k in own.tolist()])
            texts.append(hashlib.sha256(text.encode()).hexdigest() if digest and len(own) else text)
        columns = np.array(out, np.int64).reshape(-1, len(SUMS)).T
        return pa.table([left["doc_id"].combine_chunks(), *map(pa.array, columns), pa.array(texts, pa.string())], names=["doc_id", *SUMS, "groups"])

    return documents.groupBy("part").cogroup(blocks.groupBy("of_part")).applyInArrow(put_together, ALIGNED)
