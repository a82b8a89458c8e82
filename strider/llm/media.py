"""Media columns as progressive JPEG: write, read, transform to RGB tensors.

**Lossless storage.** The unit is the quantised coefficient. A payload in groups of
64 bytes becomes 8 x 8 blocks of a 4:2:0 picture whose quantisation tables are all
ones; byte k of a group is coefficient k in zigzag order. The DC byte is stored as
its value. An AC byte e is the magnitude-category-8 value with the extra bits e (e
from 128 up, e - 255 below), so each of the 256 bytes has a value of its own and no
AC coefficient is zero. A component's blocks follow one another in raster order, Y
before Cb before Cr; what the last picture units have beyond the payload are zero
bytes, and a comment segment holds the payload's length.

**Scans.** DC: one first scan at bit 8 and eight successive-approximation scans,
bits 7 to 0, interleaved. AC for each component: two spectral-selection scans (1-5
and 6-63) at bit 1, then one refinement scan of bit 0. The files are valid
progressive JPEG (SOF2).

**Reading.** The reader takes any baseline-precision progressive file with
non-interleaved AC scans and no restart marker. Scans add into coefficient arrays.
Scans in which all fields have one width, as the writer's do, are read by numpy at
once; any other scan is read bit by bit by the rules of the standard. The inverse
transform uses integer cosines in double precision, whose sums are exact, so that
results do not depend on the order of additions. Chroma is doubled both ways.

**Tables.** store() gives the files, tensors() reads them and gives the payload and the
full-resolution RGB tensor of each as columns, digests() describes what is in these
columns. Each is a table that can be written; the query chains them, so that neither
files nor tensors (twice the payload) go to disk for the sake of digests.

Null text counts as empty; an empty text gives one block of zero bytes. Repeated
texts give repeated values. Very long texts cost memory in proportion to their
length, about twelve times the payload: the inverse transform works on strips of
pixel rows. Other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_column

#: Largest number of 16-pixel units along a side.
_SIDE = 4095
_DC_BITS = 8
#: Code lengths: one symbol of one bit, then fifteen of five bits.
_LONG = 5
_COMMENT = b"payload "
#: About how many samples of a component are transformed at once, and bytes that are handed on in one batch.
_STRIP, _BATCH = 1 << 18, 4 << 20


def _zigzag() -> np.ndarray:
    """Place in the 8 x 8 square of each coefficient of a file."""
    at = sorted(((i, j) for i in range(8) for j in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * i + j for i, j in at])


_ZIGZAG = _zigzag()
_PLACE = np.argsort(_ZIGZAG)
_SCALE = 1 << 16
_COS = np.array([[np.rint(_SCALE * (np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16)) for x in range(8)] for u in range(8)])


def pad(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return data + bytes(64 if not data else -len(data) % 64)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _scan(parts: list[tuple[int, int]], ss: int, se: int, ah: int, al: int, data: bytes) -> bytes:
    head = bytes([len(parts)]) + b"".join(bytes([c, t]) for c, t in parts) + bytes([ss, se, ah << 4 | al])
    return _segment(0xDA, head) + data


def _bits(*fields: tuple[int, int]) -> np.ndarray:
    return np.array([v >> (n - 1 - k) & 1 for v, n in fields for k in range(n)], np.uint8)


def _packed(bits: np.ndarray) -> bytes:
    """Bits as bytes, filled up with ones, a zero byte after each 255."""
    return np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])).tobytes().replace(b"\xff", b"\xff\x00")


_TABLES = (
    _segment(0xDB, bytes([0]) + bytes([1]) * 64)
    + _segment(0xC4, bytes([0x00, 1]) + bytes(15) + bytes([0]))
    + _segment(0xC4, bytes([0x10, 1, 0, 0, 0, 15]) + bytes(11) + bytes([0x07]) + bytes(n << 4 for n in range(15)))
)


def _runs(n: int) -> Iterator[tuple[int, int]]:
    """Blocks in runs of at most 32,767, each with its EOB class."""
    while n:
        k = min(n, 32767)
        yield k, k.bit_length() - 1
        n -= k


def write_jpeg(payload: bytes) -> bytes:
    """A progressive JPEG that holds `payload`, whose length is a positive multiple of 64."""
    units = -(-len(payload) // 384)
    rows = -(-units // _SIDE)
    cols = -(-units // rows)
    units = rows * cols
    blocks = np.zeros((6 * units, 64), np.uint8)
    blocks.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    own = {1: blocks[: 4 * units], 2: blocks[4 * units : 5 * units], 3: blocks[5 * units :]}
    out = [
        b"\xff\xd8",
        _segment(0xFE, _COMMENT + str(len(payload)).encode()),
        _TABLES,
        _segment(0xC2, struct.pack(">BHHB", 8, 16 * rows, 16 * cols, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
    ]
    every = [(1, 0), (2, 0), (3, 0)]
    luma = own[1][:, 0].reshape(rows, 2, cols, 2).transpose(0, 2, 1, 3).reshape(units, 4)
    dc = np.concatenate([luma, own[2][:, :1], own[3][:, :1]], 1).reshape(-1)
    out.append(_scan(every, 0, 0, 0, _DC_BITS, _packed(np.zeros(6 * units, np.uint8))))
    for bit in range(_DC_BITS - 1, -1, -1):
        out.append(_scan(every, 0, 0, bit + 1, bit, _packed(dc >> bit & 1)))
    for c, b in own.items():
        for ss, se in ((1, 5), (6, 63)):
            out.append(_scan([(c, 0)], ss, se, 0, 1, (b[:, ss : se + 1] >> 1).tobytes()))
        low = (b[:, 1:] & 1) ^ (b[:, 1:] < 128)
        bits, at = [], 0
        for k, n in _runs(len(b)):
            bits += [_bits(((1 << _LONG - 1) + n, _LONG), (k - (1 << n), n)), low[at : at + k].reshape(-1)]
            at += k
        out.append(_scan([(c, 0)], 1, 63, 1, 0, _packed(np.concatenate(bits))))
    return b"".join(out) + b"\xff\xd9"


class _Huffman:
    def __init__(self, counts: bytes, symbols: bytes):
        self.codes, code, at = {}, 0, 0
        for n, k in enumerate(counts, 1):
            for s in symbols[at : at + k]:
                self.codes[n, code] = s
                code += 1
            at += k
            code <<= 1

    def one_bit(self) -> int | None:
        """The symbol whose code is the single bit 0."""
        return self.codes.get((1, 0))


class _Reader:
    """Bits of one scan; beyond its end there are ones."""

    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data, np.uint8)), 0

    def bit(self) -> int:
        self.at += 1
        return int(self.bits[self.at - 1]) if self.at <= len(self.bits) else 1

    def number(self, n: int) -> int:
        v = 0
        for _ in range(n):
            v = v << 1 | self.bit()
        return v

    def signed(self, n: int) -> int:
        v = self.number(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1

    def symbol(self, table: _Huffman) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.bit()
            if (n, code) in table.codes:
                return table.codes[n, code]
        raise ValueError("no such code")


class Picture:
    """A progressive file's coefficient arrays: {component: blocks x 64, in zigzag order}."""

    def __init__(self, data: bytes, fast: bool = True):
        self.fast, self.comment = fast, b""
        self.tables: dict[tuple[int, int], _Huffman] = {}
        self.quant: dict[int, np.ndarray] = {}
        at = 2
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        while True:
            marker, = struct.unpack(">H", data[at : at + 2])
            if marker == 0xFFD9:
                return
            n, = struct.unpack(">H", data[at + 2 : at + 4])
            body = data[at + 4 : at + 2 + n]
            at += 2 + n
            if marker == 0xFFFE:
                self.comment = body
            elif marker == 0xFFDB:
                self._quantisers(body)
            elif marker == 0xFFC4:
                self._codes(body)
            elif marker == 0xFFC2:
                self._frame(body)
            elif marker == 0xFFDA:
                end = at
                while True:
                    end = data.index(b"\xff", end)
                    if data[end + 1]:
                        break
                    end += 2
                self._scan(body, data[at:end].replace(b"\xff\x00", b"\xff"))
                at = end
            elif 0xFFC0 <= marker <= 0xFFCF or marker == 0xFFDD:
                raise ValueError("only progressive files without restarts are read")

    def _quantisers(self, body: bytes) -> None:
        while body:
            wide = body[0] >> 4
            size = 128 if wide else 64
            self.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + size], ">u2" if wide else np.uint8).astype(np.int32)
            body = body[1 + size :]

    def _codes(self, body: bytes) -> None:
        while body:
            n = sum(body[1:17])
            self.tables[body[0] >> 4, body[0] & 15] = _Huffman(body[1:17], body[17 : 17 + n])
            body = body[17 + n :]

    def _frame(self, body: bytes) -> None:
        _, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
        found = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        self.h, self.v = max(x[1] for x in found), max(x[2] for x in found)
        self.units = -(-self.height // (8 * self.v)), -(-self.width // (8 * self.h))
        self.parts = {c: (h, v, q) for c, h, v, q in found}
        self.coefs = {c: np.zeros((self.units[0] * v * self.units[1] * h, 64), np.int32) for c, h, v, q in found}

    def _order(self, parts: list[int]) -> list[tuple[int, np.ndarray]]:
        """(component, block numbers as unit x block of the unit) of an interleaved scan, or (component, blocks) of a single one."""
        rows, cols = self.units
        out = []
        for c in parts:
            h, v, _ = self.parts[c]
            grid = np.arange(rows * v * cols * h).reshape(rows * v, cols * h)
            if len(parts) == 1:
                # a scan of one component has its own size in blocks, without what fills the last units
                high, wide = -(-(-(-self.height * v // self.v)) // 8), -(-(-(-self.width * h // self.h)) // 8)
                out.append((c, grid[:high, :wide].reshape(-1, 1)))
            else:
                out.append((c, grid.reshape(rows, v, cols, h).transpose(0, 2, 1, 3).reshape(rows * cols, v * h)))
        return out

    def _scan(self, head: bytes, data: bytes) -> None:
        n = head[0]
        parts = [(head[1 + 2 * k], head[2 + 2 * k]) for k in range(n)]
        ss, se, a = head[1 + 2 * n : 4 + 2 * n]
        ah, al = a >> 4, a & 15
        order = self._order([c for c, _ in parts])
        if ss == 0:
            (self._dc_more if ah else self._dc_first)(parts, order, al, data)
        else:
            (self._ac_more if ah else self._ac_first)(parts[0], order[0], ss, se, al, data)

    def _dc_first(self, parts: list[tuple[int, int]], order: list, al: int, data: bytes) -> None:
        tables = {c: self.tables[0, t >> 4] for c, t in parts}
        total = sum(b.size for _, b in order)
        bits = np.unpackbits(np.frombuffer(data, np.uint8))
        if self.fast and all(t.one_bit() == 0 for t in tables.values()) and len(bits) >= total and not bits[:total].any():
            return  # all differences are zero
        r, last = _Reader(data), dict.fromkeys(tables, 0)
        for unit in range(len(order[0][1])):
            for c, blocks in order:
                for b in blocks[unit]:
                    last[c] += r.signed(r.symbol(tables[c]))
                    self.coefs[c][b, 0] = last[c] << al

    def _dc_more(self, parts: list[tuple[int, int]], order: list, al: int, data: bytes) -> None:
        wide = sum(b.shape[1] for _, b in order)
        bits = np.unpackbits(np.frombuffer(data, np.uint8), count=wide * len(order[0][1])).reshape(-1, wide).astype(np.int32) << al
        at = 0
        for c, blocks in order:
            k = blocks.shape[1]
            self.coefs[c][blocks.reshape(-1), 0] |= bits[:, at : at + k].reshape(-1)
            at += k

    def _ac_first(self, part: tuple[int, int], order: tuple, ss: int, se: int, al: int, data: bytes) -> None:
        c, blocks = order
        coefs, blocks, table = self.coefs[c], blocks.reshape(-1), self.tables[1, part[1] & 15]
        k = se - ss + 1
        if self.fast and table.one_bit() == 7 and len(data) == k * len(blocks):
            fields = np.frombuffer(data, np.uint8).reshape(-1, k)
            if not (fields & 128).any():
                v = fields.astype(np.int32)
                coefs[blocks, ss : se + 1] = np.where(v < 64, v - 127, v) * (1 << al)
                return
        r, run = _Reader(data), 0
        for b in blocks:
            if run:
                run -= 1
                continue
            at = ss
            while at <= se:
                s = r.symbol(table)
                zeros, size = s >> 4, s & 15
                if size:
                    at += zeros
                    coefs[b, at] = r.signed(size) * (1 << al)
                    at += 1
                elif zeros == 15:
                    at += 16
                else:
                    run = (1 << zeros) + r.number(zeros) - 1
                    break

    def _ac_more(self, part: tuple[int, int], order: tuple, ss: int, se: int, al: int, data: bytes) -> None:
        c, blocks = order
        coefs, blocks, table = self.coefs[c], blocks.reshape(-1), self.tables[1, part[1] & 15]
        r, done, step = _Reader(data), 0, 1 << al
        k = se - ss + 1
        while done < len(blocks):
            start = r.at
            if self.fast and (s := r.symbol(table)) & 15 == 0 and s >> 4 < 15:
                run = (1 << (s >> 4)) + r.number(s >> 4)
                some = blocks[done : done + run]
                old = coefs[some, ss : se + 1]
                if len(some) == run and old.all():
                    more = r.bits[r.at : r.at + run * k].reshape(run, k).astype(np.int32) * step
                    coefs[some, ss : se + 1] = old + np.where(old > 0, more, -more)
                    r.at += run * k
                    done += run
                    continue
            r.at = start
            done += self._ac_more_by_bit(r, table, coefs, blocks[done:], ss, se, step)

    @staticmethod
    def _ac_more_by_bit(r: _Reader, table: _Huffman, coefs: np.ndarray, blocks: np.ndarray, ss: int, se: int, step: int) -> int:
        """Blocks up to and with those of one end-of-band run, or one block."""

        def correct(b: int, at: int) -> None:
            if r.bit():
                coefs[b, at] += step if coefs[b, at] > 0 else -step

        b, at, run = blocks[0], ss, 0
        while at <= se:
            s = r.symbol(table)
            zeros, size = s >> 4, s & 15
            if not size and zeros < 15:
                run = (1 << zeros) + r.number(zeros)
                break
            new = (step if r.bit() else -step) if size else 0
            while at <= se:
                if coefs[b, at]:
                    correct(b, at)
                elif zeros:
                    zeros -= 1
                else:
                    break
                at += 1
            if at <= se and new:
                coefs[b, at] = new
            at += 1
        for k, b in enumerate(blocks[:run]):
            for j in range(at if not k else ss, se + 1):
                if coefs[b, j]:
                    correct(b, j)
        return max(1, run)

    def payload(self) -> bytes:
        """What write_jpeg() stored."""
        coefs = np.concatenate([self.coefs[c] for c in (1, 2, 3)])
        out = np.where(coefs < 0, coefs + 255, coefs).astype(np.uint8)
        return out.tobytes()[: int(self.comment[len(_COMMENT) :])]

    def _plane(self, c: int, first: int, last: int) -> np.ndarray:
        """Samples of a component in the picture's unit rows from `first` to before `last`."""
        h, v, q = self.parts[c]
        rows, cols = (last - first) * v, self.units[1] * h
        x = (self.coefs[c][first * v * cols : last * v * cols] * self.quant[q])[:, _PLACE].astype(np.float64)
        x = (x.reshape(-1, 8) @ _COS).reshape(-1, 8, 8).transpose(0, 2, 1)
        x = np.floor((x.reshape(-1, 8) @ _COS) / (_SCALE * _SCALE) + 128.5).clip(0, 255).astype(np.int32)
        return x.reshape(rows, cols, 8, 8).transpose(0, 3, 1, 2).reshape(8 * rows, 8 * cols)

    def rgb(self) -> np.ndarray:
        """The full-resolution tensor, height x width x 3, made strip by strip."""
        out = np.empty((self.height, self.width, 3), np.uint8)
        high, step = 8 * self.v, max(1, _STRIP // (64 * self.v * self.h * self.units[1]))
        for first in range(0, self.units[0], step):
            last = min(first + step, self.units[0])
            some = out[first * high : last * high]
            planes = []
            for c in (1, 2, 3):
                h, v, _ = self.parts[c]
                p = self._plane(c, first, last)
                if (self.v, self.h) != (v, h):
                    p = p.repeat(self.v // v, 0).repeat(self.h // h, 1)
                planes.append(p[: len(some), : self.width])
            y, cb, cr = planes[0] << 16, planes[1] - 128, planes[2] - 128
            # The inverse colour transform's factors 1.402, 0.344136, 0.714136 and 1.772.
            for k, x in enumerate((y + 91881 * cr, y - 22553 * cb - 46802 * cr, y + 116130 * cb)):
                some[:, :, k] = (x + 32768 >> 16).clip(0, 255)
        return out


def _mapped(df: DataFrame, one: Callable[..., tuple], schema: str, types: dict[str, pa.DataType]) -> DataFrame:
    """`one` of every row's columns but the first, in batches of about _BATCH bytes, behind the first column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, first, size = [], 0, 0
            for k in range(batch.num_rows):
                rows.append(one(*(c[k].as_py() for c in batch.columns[1:])))
                size += sum(len(x) for x in rows[-1] if isinstance(x, bytes))
                if size >= _BATCH or k == batch.num_rows - 1:
                    cols = [pa.array(c, t) for c, t in zip(zip(*rows), types.values())]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(rows)), *cols], names=["doc_id", *types])
                    rows, first, size = [], k + 1, 0

    return df.mapInArrow(run, "doc_id long, " + schema)


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and `jpeg`, the stored form of every whole text."""
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), text_column(text_col).cast("binary").alias("raw"))
    return _mapped(texts, lambda raw: (len(raw), write_jpeg(pad(raw))), "n_bytes long, jpeg binary", {"n_bytes": pa.int64(), "jpeg": pa.binary()})


def tensors(df: DataFrame, id_col: str = "doc_id", jpeg_col: str = "jpeg") -> DataFrame:
    """doc_id, n_bytes, jpeg and, read from the stored bytes, `payload`, height, width and `rgb`, the tensor row by row; rows without a picture are left out.

    `payload` is null in pictures that do not come from store(), n_bytes where the input has no such column.
    """

    def one(n_bytes: int | None, jpeg: bytes) -> tuple:
        picture = Picture(jpeg)
        return n_bytes, jpeg, picture.payload() if picture.comment.startswith(_COMMENT) else None, picture.height, picture.width, picture.rgb().tobytes()

    n_bytes = F.col("n_bytes").cast("long") if "n_bytes" in df.columns else F.lit(None).cast("long").alias("n_bytes")
    files = df.select(F.col(id_col).cast("long").alias("doc_id"), n_bytes, F.col(jpeg_col).alias("jpeg")).where("jpeg IS NOT NULL")
    types = {"n_bytes": pa.int64(), "jpeg": pa.binary(), "payload": pa.binary(), "height": pa.int32(), "width": pa.int32(), "rgb": pa.binary()}
    return _mapped(files, one, "n_bytes long, jpeg binary, payload binary, height int, width int, rgb binary", types)


def means(rgb: bytes) -> str:
    """Mean of each channel of a tensor."""
    return ",".join(f"{m:.2f}" for m in np.frombuffer(rgb, np.uint8).reshape(-1, 3).mean(0))


def _channel_means():
    @F.pandas_udf(T.StringType())
    def channel_means(rgb: pd.Series) -> pd.Series:
        return rgb.map(means)

    return channel_means


def digests(stored: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature of the rows of tensors().

    The feature is the tensor's size, the mean of each channel, and its CRC-32.
    """
    tail = F.substring("payload", -64, 64)
    size = F.concat_ws("x", "width", "height")
    return stored.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"),
        F.octet_length("jpeg").cast("long").alias("media_bytes"), F.sha2("jpeg", 256).alias("media_sha256"),
        F.concat_ws(";", size, _channel_means()("rgb"), F.lower(F.lpad(F.hex(F.crc32("rgb")), 8, "0"))).alias("feature"),
    )
