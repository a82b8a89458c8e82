"""Token counts, byte-level BPE, media columns: library parity, round trips, odd rows."""

import base64
import hashlib
import os
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from strider.llm import bpe, media, token_counts

PIECES = ["a", "b", " ", "  ", "\n", "\t", "'", "s", "re", "'re", "'ll", "l", "1", "23", "!", "!!", "é", "ß", "漢", " ", "<|endoftext|>", "<|endo", "ing", "the", " the", "\U0001f600", ".", "x" * 40]
ODD = [None, "", " ", "\n\n", "word", "the " * 3000, "x" * 5000, "a'b" * 900, "漢字" * 700, "1" * 3000 + "a!" * 900]


def texts(n, most, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randrange(most))) for _ in range(n)]


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [(k, t, "x", "y") for k, t in enumerate(ODD)] + [(None, "null id", "x", "y"), (3, "\n\n", "x", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, counts string, jpeg string")


def test_prefix_counts_equal_the_library():
    own, theirs = token_counts.counter(P.path("byte_bpe_50k.json")), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for t in texts(250, 14, 3):
        want = [len(theirs.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]
        assert own.counts(t).tolist() == want, t


def test_whole_counts_equal_the_library(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    theirs = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {r.doc_id: len(theirs.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()}
    got = token_counts.budgets(docs, P.path("byte_bpe_50k.json"), 1024).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want
    assert all(r.over_limit == (want[r.doc_id] > 1024) for r in got)


def test_budget_is_the_longest_prefix_that_fits(spark):
    path = P.path("byte_bpe_50k.json")
    df = spark.createDataFrame([(1, "one two three four five six")], "doc_id long, text string")
    counts = token_counts.counter(path).counts("one two three four five six")
    got = token_counts.budgets(df, path, 4).first()
    assert got.over_limit and counts[got.fit_chars] <= 4 and all(c > 4 for c in counts[got.fit_chars + 1 :])
    assert token_counts.prefix_counts(df, path).first().counts == counts.tolist()


def test_counts_of_odd_rows(odd_docs, spark):
    theirs = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = token_counts.budgets(odd_docs, P.path("byte_bpe_50k.json"), 1024).collect()
    assert len(got) == len(ODD) + 2
    by = {r.doc_id: r for r in got}
    for k, t in enumerate(ODD):
        assert by[k].n_tokens == len(theirs.encode(t or "", add_special_tokens=False).ids)
        assert by[k].n_bytes == len((t or "").encode())
    assert token_counts.budgets(odd_docs.limit(0), P.path("byte_bpe_50k.json"), 1024).count() == 0


def library():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return ranks, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("leaf", [1, 2, 3, 7, 50, 1000])
def test_tree_encoding_equals_the_library(leaf):
    ranks, theirs = library()
    own = bpe.BytePairCodec(ranks, P.PATTERN, leaf)
    for t in texts(400, 30, leaf) + [t or "" for t in ODD]:
        ids = own.encode(t)
        assert ids == theirs.encode_ordinary(t)
        assert own.decode(ids) == t.encode()


def test_tree_encoding_of_any_characters_equals_the_library():
    ranks, theirs = library()
    own, rng = bpe.BytePairCodec(ranks, P.PATTERN, 4, memory=5000), random.Random(4)
    every = [chr(c) for c in range(0x40000) if not 0xD800 <= c <= 0xDFFF]
    rng.shuffle(every)
    for k in range(0, len(every), 64):
        t = "".join(c + rng.choice(["", " ", "a", "7", "!", "'s"]) for c in every[k : k + 64])
        assert own.encode(t) == theirs.encode_ordinary(t)


def test_new_matches_of_texts_are_merged_side_by_side(monkeypatch):
    """Texts taken together have the library's tokens, and no short match is merged by itself, however small the steps."""
    ranks, theirs = library()
    rng, letters = random.Random(6), "abcdeéßñ漢😀"
    some = [" ".join("".join(rng.choices(letters, k=rng.randint(1, 30))) for _ in range(60)) for _ in range(40)] + [t or "" for t in ODD]
    for steps in (1, 7, 4096):
        own = bpe.BytePairCodec(ranks, P.PATTERN, 50)
        monkeypatch.setattr(bpe, "SIDE_BY_SIDE", steps)
        monkeypatch.setattr(own, "_scanned", None)
        assert list(own.encode_all(some)) == [theirs.encode_ordinary(t) for t in some]
    assert list(own.encode_all([])) == []


def test_bpe_of_documents_equals_the_library(spark, sf_dir):
    _, theirs = library()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r.ids for r in bpe.encode_documents(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    assert got == {r.doc_id: theirs.encode_ordinary(r.text or "") for r in docs.collect()}


def test_bpe_digests_and_odd_rows(odd_docs):
    path = P.path("byte_bpe_50k.tiktoken")
    _, whole = library()
    got = bpe.round_trip(odd_docs, path, P.PATTERN).collect()
    assert len(got) == len(ODD) + 2
    by = {r.doc_id: r for r in got}
    for k, t in enumerate(ODD):
        ids = whole.encode_ordinary(t or "")
        assert by[k].n_tokens == len(ids)
        assert by[k].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert by[k].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.round_trip(odd_docs.limit(0), path, P.PATTERN).count() == 0


def test_ids_and_bytes_tables(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    df = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    ids = bpe.encode_documents(df, path, P.PATTERN)
    assert {r.doc_id: bytes(r.data) for r in bpe.decode_documents(ids, path, P.PATTERN).collect()} == {1: b"some text", 2: b""}


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 383, 384, 385, 5000])
def test_jpeg_holds_any_bytes(n):
    data = media.pad(random.Random(n).randbytes(n))
    jpeg = media.write_jpeg(data)
    fast, slow = media.Picture(jpeg), media.Picture(jpeg, fast=False)
    assert fast.payload() == data and slow.payload() == data
    assert all((fast.coefs[c] == slow.coefs[c]).all() for c in (1, 2, 3))
    assert fast.rgb().shape == (fast.height, fast.width, 3)


def test_inverse_transform_equals_the_formula():
    p = media.Picture(media.write_jpeg(bytes(range(64)) * 6))
    c = (p.coefs[1] * p.quant[0])[0][media._PLACE].reshape(8, 8)
    k = lambda u: np.sqrt(0.125) if u == 0 else 0.5
    want = [[sum(k(u) * k(v) * c[u, v] * np.cos((2 * y + 1) * u * np.pi / 16) * np.cos((2 * x + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) for x in range(8)] for y in range(8)]
    got = p._plane(1, 0, 1)[:8, :8]
    assert np.abs(got - np.clip(np.array(want) + 128, 0, 255)).max() <= 0.6


def test_grey_picture_without_ac_terms_has_one_colour():
    p = media.Picture(media.write_jpeg(bytes(384)))
    for c in (1, 2, 3):
        p.coefs[c][:] = 0
    assert (p.rgb() == 128).all()


def test_media_digests_and_odd_rows(odd_docs):
    got = media.digests(media.tensors(media.store(odd_docs))).collect()
    assert len(got) == len(ODD) + 2
    by = {r.doc_id: r for r in got}
    for k, t in enumerate(ODD):
        raw = (t or "").encode()
        padded = raw + bytes(64 if not raw else -len(raw) % 64)
        r = by[k]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(padded))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.tail_crc32 == zlib.crc32(padded[-64:])
        assert r.media_sha256 == hashlib.sha256(media.write_jpeg(padded)).hexdigest()
        tensor = media.Picture(media.write_jpeg(padded)).rgb()
        assert r.feature == f"{tensor.shape[1]}x{tensor.shape[0]};{','.join(f'{m:.2f}' for m in tensor.reshape(-1, 3).mean(0))};{zlib.crc32(tensor.tobytes()):08x}"
    same = [r for r in got if r.doc_id == 3]
    assert len(same) == 2 and same[0] == same[1]
    assert media.digests(media.tensors(media.store(odd_docs.limit(0)))).count() == 0


def slow_rgb(p):
    """Every pixel by the formulas of the standard, from the coefficients."""
    c = lambda u: np.sqrt(0.5) if u == 0 else 1.0
    basis = np.array([[c(u) / 2 * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
    out = np.empty((p.height, p.width, 3))
    for y in range(p.height):
        for x in range(p.width):
            s = []
            for part, (h, v, q) in p.parts.items():
                px, py = x * h // p.h, y * v // p.v
                block = p.coefs[part][(py // 8) * p.units[1] * h + px // 8] * p.quant[q]
                square = np.zeros(64)
                square[media._ZIGZAG] = block
                s.append(np.clip(np.rint(basis[:, py % 8] @ square.reshape(8, 8) @ basis[:, px % 8] + 128), 0, 255))
            luma, cb, cr = s[0], s[1] - 128, s[2] - 128
            out[y, x] = np.clip([luma + 1.402 * cr, luma - 0.344136 * cb - 0.714136 * cr, luma + 1.772 * cb], 0, 255)
    return out


def test_pixels_equal_the_formulas_of_the_standard(monkeypatch):
    """Transform, chroma upsampling, colours and strips, at a size that does not fill its units."""
    p = media.Picture(media.write_jpeg(media.pad(random.Random(5).randbytes(384 * 6))))
    rng = np.random.default_rng(5)
    for c in p.coefs:
        p.coefs[c] = rng.integers(-60, 60, p.coefs[c].shape) // (1 + np.arange(64)) * 4
    p.height, p.width = p.height - 5, p.width - 3
    whole = p.rgb()
    assert np.abs(whole - slow_rgb(p)).max() <= 2
    monkeypatch.setattr(media, "_STRIP", 1)
    assert (p.rgb() == whole).all()


def foreign(spark, pixels, quality):
    """A progressive file written by Java's encoder, and its own reading of it."""
    jvm, (high, wide) = spark.sparkContext._jvm, pixels.shape[:2]
    image = jvm.java.awt.image.BufferedImage(wide, high, jvm.java.awt.image.BufferedImage.TYPE_INT_RGB)
    for y in range(high):
        for x in range(wide):
            r, g, b = map(int, pixels[y, x])
            image.setRGB(x, y, r << 16 | g << 8 | b)
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    how = writer.getDefaultWriteParam()
    how.setProgressiveMode(jvm.javax.imageio.ImageWriteParam.MODE_DEFAULT)
    how.setCompressionMode(jvm.javax.imageio.ImageWriteParam.MODE_EXPLICIT)
    how.setCompressionQuality(quality)
    out = jvm.java.io.ByteArrayOutputStream()
    sink = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(sink)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), how)
    sink.flush()
    return bytes(out.toByteArray()), their_rgb(spark, bytes(out.toByteArray()))


def their_rgb(spark, data):
    jvm = spark.sparkContext._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(data))
    rgb = [[image.getRGB(x, y) for x in range(image.getWidth())] for y in range(image.getHeight())]
    return (np.array(rgb)[:, :, None] >> np.array([16, 8, 0])) & 255


@pytest.mark.parametrize("quality", [0.4, 0.95])
def test_foreign_progressive_files_are_read(spark, quality):
    """Huffman codes, spectral selection and successive approximation of another encoder; its reader smooths chroma, so pictures change slowly."""
    y, x = np.mgrid[0:45, 0:70]
    pixels = np.stack([128 + 100 * np.sin(x / 20), 128 + 90 * np.cos(y / 15), 60 + 2 * x - y], 2).clip(0, 255).astype(int)
    data, theirs = foreign(spark, pixels, quality)
    p = media.Picture(data)
    assert data[:2] == b"\xff\xd8" and b"\xff\xc2" in data and (p.height, p.width) == (45, 70)
    far = np.abs(p.rgb().astype(int) - theirs)
    assert far.mean() < 1.5 and far.max() <= 14
    grey, seen = foreign(spark, np.repeat(((x * 7 + y * 5) % 256)[:, :, None], 3, 2), quality)
    assert np.abs(media.Picture(grey).rgb().astype(int) - seen).max() <= 2


def test_files_are_read_by_another_reader(spark):
    """Its luma plane, which needs no upsampling, is ours."""
    jpeg = media.write_jpeg(random.Random(9).randbytes(64 * 30))
    p, jvm = media.Picture(jpeg), spark.sparkContext._jvm
    reader = jvm.javax.imageio.ImageIO.getImageReadersByFormatName("jpeg").next()
    reader.setInput(jvm.javax.imageio.ImageIO.createImageInputStream(jvm.java.io.ByteArrayInputStream(jpeg)))
    raster = reader.readRaster(0, None)
    assert (raster.getHeight(), raster.getWidth()) == (p.height, p.width)
    luma = raster.getSamples(0, 0, p.width, p.height, 0, spark.sparkContext._gateway.new_array(jvm.int, p.height * p.width))
    assert np.abs(np.array(list(luma)).reshape(p.height, p.width) - p._plane(1, 0, p.units[0])[: p.height, : p.width]).max() <= 1


def test_tensor_table(spark):
    df = spark.createDataFrame([(1, "x" * 1000), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in media.tensors(media.store(df)).collect()}
    for d, text in ((1, "x" * 1000), (2, "")):
        own = media.Picture(bytes(got[d].jpeg)).rgb()
        assert bytes(got[d].rgb) == own.tobytes() and own.shape == (got[d].height, got[d].width, 3)
        assert bytes(got[d].payload) == media.pad(text.encode()) and got[d].n_bytes == len(text)
    assert media.tensors(spark.createDataFrame([(1, None)], "doc_id long, jpeg binary")).count() == 0


def test_vocabularies_stay_outside_the_repository():
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert not [f for _, _, fs in os.walk(os.path.join(top, "strider")) for f in fs if f.endswith((".tiktoken", ".model", ".json"))]
