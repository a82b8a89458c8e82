"""Hard negatives, packing and alignment against brute force on odd rows."""

import bisect
import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, LongType, StringType, StructField, StructType
from tokenizers import Tokenizer

from strider.llm import alignment, hard_negatives, packing

ODD = [
    None, "", " ", "  two  spaces ", "don't can't 'tis, (\"quoted\") … 1234 ½ x_y a.b", "<|endoftext|> in<|endoftext|>side <|startoftext|>,", "\n\nlines\nand\ttabs \r\n",
    "naïve café — Straße ΑΣ İstanbul é ́x a b　c", "漢字かな 😀👍🏽 ​᠎ z", "▁ under ▁a", "a" * 3000, "word " * 2000, "\x00\x01 ctrl", "..., !!! '' 's 'll", "repeat me", "repeat me",
]
A, B, W = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.path("word_bpe_49k.json")


def documents(spark, texts):
    """With extra columns whose names clash with ours."""
    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("part", StringType()), StructField("key", LongType()), StructField("groups", StringType())])
    rows = [(None if k == 4 else k // 2 * 2, t, "x", 1, "y") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema).repartition(3), [(r[0], r[1] or "") for r in rows]


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x) for x in r))


def test_lengths():
    assert packing.lengths(0) == [] and packing.lengths(4096) == [4096] and packing.lengths(9001) == [4096, 4096, 512, 256, 32, 8, 1]
    assert all(sum(packing.lengths(n, 64)) == n for n in range(500))


@pytest.mark.parametrize("longest", [8, 4096])
def test_packing_equals_the_library(spark, longest):
    docs, rows = documents(spark, ODD)
    library, expected = Tokenizer.from_file(W), []
    for d, t in rows:
        ids, at = [*library.encode(t, add_special_tokens=False).ids, 2], 0
        for n in packing.lengths(len(ids), longest):
            expected.append((d, at, n, zlib.crc32(struct.pack(f"<{n}I", *ids[at : at + n])), len(ids)))
            at += n
    got = packing.pack(docs, W, longest=longest, digest=True).collect()
    assert order(r[:5] for r in got) == order(expected)
    assert sorted(r.sequence_id for r in got) == list(range(len(got))) and {r.offset for r in got} == {0}
    by_bucket = sorted((r.sequence_id, r.length) for r in got)
    assert [n for _, n in by_bucket] == sorted(n for _, n in by_bucket)  # buckets lie one after another
    ids = packing.pack(docs, W, longest=longest).collect()
    assert order((r.doc_id, r.start, r.length, zlib.crc32(r.ids), r.doc_tokens) for r in ids) == order(expected)


def test_packing_of_nothing_and_forgetful_workers(spark):
    docs, _ = documents(spark, ODD)
    assert packing.pack(docs.limit(0), W).count() == 0
    encoder, library = packing.WordEncoder(W, remembered=1), Tokenizer.from_file(W)
    for _ in range(2):
        for t in ODD:
            (got,) = encoder.encode([t or ""])
            assert list(struct.unpack(f"<{len(got) // 4}I", got)) == library.encode(t or "", add_special_tokens=False).ids


def test_plain_words_pass_the_normaliser(monkeypatch):
    """Words of Latin letters do not go through the library one by one, and have its ids in any case of letters."""
    letters = [chr(c) for c in [*range(65, 91), *range(97, 123), *(set(range(0xC0, 0x100)) - {0xD7, 0xF7})]]
    rng, library = random.Random(12), Tokenizer.from_file(W)
    words = [*letters, *("".join(rng.choices(letters, k=rng.randint(1, 14))) for _ in range(3000)), "the", "The", "İx", "ªx", "ŉa", "aﬁ", "e\u0301a", "Å", "a×b", "a÷", "Σς", "don't"]
    one = packing.WordEncoder(W)

    class Counted:
        seen = 0

        def encode_batch_fast(self, texts, **how):
            Counted.seen += len(texts)
            return library.encode_batch_fast(texts, **how)

    one.library = Counted()
    for some in (words, [f"({w})," for w in words]):
        got = list(one.encode(some))
        assert [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in got] == [library.encode(w, add_special_tokens=False).ids for w in some]
    assert Counted.seen < 50


def test_buckets_are_folders(spark, tmp_path):
    docs, _ = documents(spark, ODD)
    packing.write_buckets(packing.pack(docs, W), str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    assert back.where("bucket <> length or bucket * 4 <> length(ids)").count() == 0 and back.count() > len(ODD)


def brute_alignment(rows):
    pair, out, counts = alignment.Pair(A, B), [], Counter()
    for d, t in rows:
        a, b = pair.a.encode(" " + t, add_special_tokens=False).ids, pair.b.encode(t)
        if not t or not pair.agrees(t, a, b):
            out.append((d, [], [], [], []))
            continue
        ends_a, ends_b = (np.cumsum([len(of[i]) for i in ids]).tolist() for ids, of in ((a, pair.bytes_a), (b, pair.bytes_b)))
        cuts = sorted(set(ends_a) & set(ends_b))
        at_b = defaultdict(list)
        for i, e in zip(b, ends_b):
            at_b[e].append(i)
        linked = [(i, j) for i, e in zip(a, ends_a) for j in at_b[e]]
        counts.update(linked)
        sides = [[[] for _ in cuts] for _ in range(2)]
        for side, ids, ends in ((0, a, ends_a), (1, b, ends_b)):
            for i, e in zip(ids, ends):
                sides[side][bisect.bisect_left(cuts, e)].append(str(i))
        out.append((d, a, b, [f"{','.join(x)}|{','.join(y)}" for x, y in zip(*sides)], linked))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(d, len(a), len(b), len(g), len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x), ";".join(g)) for d, a, b, g, x in out]


@pytest.mark.parametrize("part_bytes", [100, alignment.PART_BYTES])
def test_alignment_equals_brute_force(spark, part_bytes):
    words = ["über", "the", "tokens", "naïveté", "x1y2", "ét", "don't", "漢字"]
    rng = random.Random(5)
    docs, rows = documents(spark, ODD + [" ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(40)])
    expected = brute_alignment(rows)
    got = alignment.aligned(docs, A, B, part_bytes=part_bytes).collect()
    assert order(got) == order(expected)
    assert any(r[1] for r in expected) and any(r[1] == 0 and t for r, (_, t) in zip(expected, rows))
    digests = alignment.aligned(docs, A, B, digest=True, part_bytes=part_bytes).collect()
    assert order(r[:8] for r in digests) == order((*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[7] else "") for r in expected)
    assert alignment.aligned(docs.limit(0), A, B).count() == 0


def test_align_of_whole_texts_gives_the_same_groups(spark):
    """The relational core with documents as keys, without segments."""
    pair, texts = alignment.Pair(A, B), ["the tokens naïveté", "x", "don't 12 über  two"]
    rows = []
    for k, t in enumerate(texts):
        a, b = next(pair.encode([t]))
        rows.append((k, *([i << alignment.SHIFT | len(of[i]) for i in ids] for ids, of in ((a, pair.bytes_a), (b, pair.bytes_b)))))
    found, groups = alignment.align(spark.createDataFrame(rows, "doc long, a array<bigint>, b array<bigint>"), ["doc"])
    expected = brute_alignment(list(enumerate(texts)))
    got = defaultdict(list)
    for r in sorted(groups.collect(), key=lambda r: (r["doc"], r["group"])):
        got[r["doc"]].append(f"{','.join(map(str, r['a']))}|{','.join(map(str, r['b']))}")
    assert {k: ";".join(v) for k, v in got.items()} == {r[0]: r[7] for r in expected}
    assert Counter(r["doc"] for r in found.collect()) == Counter({r[0]: r[4] for r in expected})


def brute_negatives(rows, positives, negatives):
    use = [(i, y, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda v, w: sum(a * b for a, b in zip(v, w))
    out = []
    for i, y, v in {(i, y, tuple(v)) for i, y, v in use if i % 5 == 0}:
        scored = sorted((-dot(v, w), j, z) for j, z, w in use if j != i)
        for s, j in [(s, j) for s, j, z in scored if z == y][:positives]:
            fits = [(t, k) for t, k, z in scored if z != y and -50 * s <= -100 * t <= -95 * s]
            out += [(i, j, r, k, -s, -t) for r, (t, k) in enumerate(fits[:negatives], 1)]
    return sorted(out)


SCHEMA = StructType([StructField("vec_id", LongType()), StructField("label", LongType()), StructField("embedding", ArrayType(FloatType())), StructField("number", LongType()), StructField("ids", StringType())])


def vectors(n, dim, labels, scale, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dim))
    rows = [(int(k), int(k % labels), [float(np.float32(x)) for x in scale * (centres[k % labels] * 0.6 + centres[(k // labels) % labels] * 0.5 + rng.normal(size=dim) * 0.3)]) for k in range(n)]
    odd = [(None, 1, [1.0] * dim), (1000, None, [1.0] * dim), (1005, 1, None), (1010, 1, [None] * dim), (1015, 1, [float("nan")] * dim), (1020, 1, [float("inf")] * dim), (1025, 1, []), (1030, 2, [0.5])]
    return rows + odd + rows[:3] + [(10, 0, rows[11][2])]  # repeats, and an id with two vectors


@pytest.mark.parametrize("chunk_bytes, leaf, scale", [(hard_negatives.CHUNK_BYTES, 64, 1.0), (3000, 4, 1.0), (3000, 4, 3e5), (3000, 4, 0.01)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, chunk_bytes, leaf, scale):
    """Also where scores leave 2^53, where many tie, and with many chunks and small leaves."""
    monkeypatch.setattr(hard_negatives.leaves, "__defaults__", (50, leaf))
    rows = vectors(160, 6, 4, scale, 3)
    df = spark.createDataFrame([(*r, 7, "z") for r in rows], SCHEMA).repartition(3)
    got = hard_negatives.mine(df, F.col("id") % 5 == 0, chunk_bytes=chunk_bytes)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, 5, 3)
    assert got.count() > 0


def test_hard_negatives_of_nothing_and_one_label(spark):
    df = spark.createDataFrame([(5 * k, 1, [1.0, float(k)], 0, "") for k in range(20)], SCHEMA)
    assert hard_negatives.mine(df.limit(0), F.col("id") % 5 == 0).count() == 0
    assert hard_negatives.mine(df, F.col("id") % 5 == 0).count() == 0  # no other label


def test_dual_search_prunes_and_keeps_what_counts():
    rng = np.random.default_rng(1)
    make = lambda centre, label: [(label, 32, 8, x[k : k + 32][:, 0].astype(np.int64).tobytes(), x[k : k + 32].astype(np.int16).tobytes()) for x in [np.round(rng.normal(size=(256, 8)) * 5 + centre)] for k in range(0, 256, 32)]
    a, c = hard_negatives.Trees.of(make(100, 0)), hard_negatives.Trees.of([*make(100, 1), *make(-100, 2)])
    least = np.full(8, 50_000.0)
    u, v, _ = hard_negatives.pairs_of_leaves(a, c, least, least * 10, False, True)
    assert len(u) and v.max() < 8 and len(u) <= 64  # the far half of the candidates goes unseen
    scores = a.x @ c.x.T
    for i, j in zip(*np.nonzero((scores >= 50_000) & (scores <= 500_000))):
        assert ((u == i // 32) & (v == j // 32)).any()


def test_segments_carry_their_places(spark):
    """A segment of several parts is one row, whose parts and numbers lead back to all its occurrences; nothing else is stored of its text."""
    docs = spark.createDataFrame([(k, f"same tokens {k % 7} same") for k in range(60)], "doc_id long, text string").repartition(3)
    documents, segments = alignment.cut(docs, A, B, part_bytes=200)
    want = order((r.part, r.number, r.n) for r in segments.collect())
    rows = alignment.encoded(segments, A, B)
    assert "segment" not in rows.columns and rows.count() == 9
    found = rows.collect()
    assert order((p, k) for r in found for p, k in zip(r.of_part, r.number)) == [x[:2] for x in want]
    assert sum(r.n for r in found) == sum(x[2] for x in want) == 240 and max(len(r.of_part) for r in found) > 3
    alignment.forget(segments)
    assert documents.count() == 60
    blocks = alignment.segment_results(rows)
    assert sum(b.count() for b in blocks) > 0
