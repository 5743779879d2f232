"""Progressive JPEG media columns.

``decode`` accumulates the scans of a progressive JPEG -- spectral selection and
successive approximation, DC and AC -- into one coefficient array per component,
inverse-transforms all blocks by a matrix product in numpy, repeats chroma to
full resolution and gives an RGB tensor. Scans whose Huffman table has a single
code with no zero run, and end-of-band runs of refinement scans, are read in
bulk; everything else symbol by symbol, over 16-bit windows found for every bit
position at once.

``store`` writes bytes losslessly: a byte is a quantised coefficient (the value
whose 8 extra bits in JPEG are that byte), in 4:2:0 blocks, first without its
last bit, DC and two AC bands apart, then refined by that bit. The file is an
ordinary progressive JPEG; a comment segment holds the payload's length.
"""

from __future__ import annotations

import functools
import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.common import table


def _zigzag() -> np.ndarray:
    order = sorted(range(64), key=lambda k: (k // 8 + k % 8, (k // 8 if (k // 8 + k % 8) % 2 else k % 8)))
    return np.array(order)


ZIGZAG = _zigzag()  # natural place of each zigzag position


def _basis() -> np.ndarray:
    """64 x 64: the pixels of each zigzag coefficient."""
    x = np.arange(8)
    c = np.cos((2 * x[:, None] + 1) * x[None, :] * math.pi / 16) * np.where(x == 0, math.sqrt(0.125), 0.5)
    whole = np.einsum("yv,xu->vuyx", c, c).reshape(64, 64)
    return whole[ZIGZAG].astype(np.float32)


BASIS = _basis()
_SHIFTS = np.arange(16, dtype=np.uint32)


class Huffman:
    def __init__(self, counts: tuple[int, ...], symbols: bytes):
        self.length = np.zeros(1 << 16, np.uint8)
        self.symbol = np.zeros(1 << 16, np.uint8)
        self.codes: dict[int, tuple[int, int]] = {}
        code, k = 0, 0
        for n, count in enumerate(counts, 1):
            for _ in range(count):
                low, high = code << (16 - n), (code + 1) << (16 - n)
                self.length[low:high], self.symbol[low:high] = n, symbols[k]
                self.codes[symbols[k]] = (code, n)
                code += 1
                k += 1
            code <<= 1
        self.only = (symbols[0], next(iter(self.codes.values()))[1]) if len(symbols) == 1 else None


_huffman = functools.lru_cache(64)(Huffman)


class Bits:
    """Entropy-coded data after unstuffing, as bits and 16-bit windows."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data.replace(b"\xff\x00", b"\xff") + b"\xff\xff\xff\xff", np.uint8)
        self.raw = raw
        self.end = (len(raw) - 4) * 8
        self._bits = self._windows = None
        self.at = 0

    @property
    def bits(self) -> np.ndarray:
        if self._bits is None:
            self._bits = np.unpackbits(self.raw)
        return self._bits

    @property
    def windows(self) -> np.ndarray:
        """The 16 bits from each bit position on."""
        if self._windows is None:
            r = self.raw.astype(np.uint32)
            triple = (r[:-2] << 16) | (r[1:-1] << 8) | r[2:]
            self._windows = ((triple[:, None] >> (8 - _SHIFTS[None, :8])) & 0xFFFF).reshape(-1)
        return self._windows

    def check(self) -> None:
        if self.at > self.end:
            raise ValueError("the scan ends too soon")

    def take(self, n: int) -> int:
        if not n:
            return 0
        if self.at + n > self.end:
            raise ValueError("the scan ends too soon")
        value = int(self.windows[self.at]) >> (16 - n)
        self.at += n
        return value

    def symbol(self, table: Huffman) -> int:
        if self.at >= self.end:
            raise ValueError("the scan ends too soon")
        w = self.windows[self.at]
        n = int(table.length[w])
        if not n:
            raise ValueError("no such Huffman code")
        self.at += n
        return int(table.symbol[w])


def _extend(value: int, size: int) -> int:
    return value if not size or value >= 1 << (size - 1) else value - (1 << size) + 1


class Component:
    def __init__(self, h: int, v: int, quant: int):
        self.h, self.v, self.quant = h, v, quant


class Image:
    """The frame and the coefficients gathered so far: for each component an
    array (rows of blocks, columns, 64), zigzag order, padded to whole MCUs."""

    def __init__(self, height: int, width: int, comps: dict[int, Component]):
        self.height, self.width, self.comps = height, width, comps
        self.hmax, self.vmax = max(c.h for c in comps.values()), max(c.v for c in comps.values())
        self.cols, self.rows = -(-width // (8 * self.hmax)), -(-height // (8 * self.vmax))
        for c in comps.values():
            c.coefs = np.zeros((self.rows * c.v, self.cols * c.h, 64), np.int32)
            c.across, c.down = -(-(-(-width * c.h // self.hmax)) // 8), -(-(-(-height * c.v // self.vmax)) // 8)
        self.quants: dict[int, np.ndarray] = {}
        self.comment = b""

    def mcu_order(self, ids: list[int]) -> list[np.ndarray]:
        """Flat block numbers of each component of an interleaved scan, by MCU."""
        out = []
        for i in ids:
            c = self.comps[i]
            place = np.arange(self.rows * c.v * self.cols * c.h).reshape(self.rows, c.v, self.cols, c.h)
            out.append(place.transpose(0, 2, 1, 3).reshape(self.rows * self.cols, c.v * c.h))
        return out

    def own_order(self, i: int) -> np.ndarray:
        c = self.comps[i]
        return np.arange(self.rows * c.v * self.cols * c.h).reshape(self.rows * c.v, -1)[:c.down, :c.across].reshape(-1)


def _dc_scan(image: Image, ids: list[int], tables: list[Huffman], first: bool, low: int, parts: list[bytes], interval: int) -> None:
    orders = image.mcu_order(ids) if len(ids) > 1 else [image.own_order(ids[0])[:, None]]
    units = len(orders[0])
    step = interval or units
    per = [o.shape[1] for o in orders]
    flat = [image.comps[i].coefs.reshape(-1, 64) for i in ids]
    for k, part in enumerate(parts):
        lot = [o[k * step:(k + 1) * step] for o in orders]
        n, bits = len(lot[0]), Bits(part)
        if not first:
            if n * sum(per) > bits.end:
                raise ValueError("the scan ends too soon")
            got = bits.bits[:n * sum(per)].reshape(n, sum(per)).astype(np.int32)
        else:
            got = _dc_values(bits, tables, per, n) << low
        at = 0
        for c, o in zip(flat, lot):
            own = got[:, at:at + o.shape[1]]
            at += o.shape[1]
            if first:
                c[o.reshape(-1), 0] = np.cumsum(own.reshape(-1))
            else:
                c[o.reshape(-1), 0] |= own.reshape(-1) << low


def _dc_values(bits: Bits, tables: list[Huffman], per: list[int], units: int) -> np.ndarray:
    """The differences, (units, blocks of an MCU). For each table the difference
    and the next place are found for every bit position; then only the places
    are followed."""
    w = bits.windows
    wide = len(w) - 32
    found = {}
    for t in tables:
        if id(t) in found:
            continue
        n, s = t.length[w].astype(np.int32), t.symbol[w].astype(np.int32)
        start = np.minimum(np.arange(len(w)) + n, len(w) - 1)
        extra = w[start].astype(np.int32) >> (16 - np.minimum(s, 16))
        value = np.where((s > 0) & (extra < (1 << np.maximum(s - 1, 0))), extra - (1 << s) + 1, extra)
        after = np.where((n > 0) & (s <= 15), np.arange(len(w)) + n + s, len(w) * 2)
        found[id(t)] = (value, after.tolist())
    row = [found[id(t)] for t, k in zip(tables, per) for _ in range(k)]
    afters = [r[1] for r in row]
    places, at = [], 0
    try:
        if all(a is afters[0] for a in afters):
            only = afters[0]
            for _ in range(units * len(row)):
                places.append(at)
                at = only[at]
        else:
            for _ in range(units):
                for after in afters:
                    places.append(at)
                    at = after[at]
    except IndexError:
        at = len(w) * 2
    if at > bits.end or wide < 0:
        raise ValueError("the scan ends too soon")
    places = np.array(places).reshape(units, len(row))
    out = np.empty(places.shape, np.int32)
    for k, (value, _) in enumerate(row):
        out[:, k] = value[places[:, k]]
    return out


def _ac_first(blocks: np.ndarray, table: Huffman, lo: int, hi: int, low: int, bits: Bits) -> None:
    """blocks: (n, 64) in scan order, filled in place."""
    n, band = len(blocks), hi - lo + 1
    if table.only and 0 < table.only[0] < 16:
        size, length = table.only
        stride, total = size + length, n * band
        if total * stride > bits.end:
            raise ValueError("the scan ends too soon")
        if stride == 8:
            raw = bits.raw[:total].astype(np.int32) & ((1 << size) - 1)
        else:
            raw = bits.bits[:total * stride].reshape(total, stride)[:, length:] @ (1 << np.arange(size - 1, -1, -1)).astype(np.int32)
        raw = np.where(raw < 1 << (size - 1), raw - (1 << size) + 1, raw)
        blocks[:, lo:hi + 1] = (raw << low).reshape(n, band)
        return
    skip = 0
    for block in blocks:
        if skip:
            skip -= 1
            continue
        k = lo
        while k <= hi:
            s = bits.symbol(table)
            run, size = s >> 4, s & 15
            if size:
                k += run
                if k > hi:
                    raise ValueError("a run leaves its band")
                block[k] = _extend(bits.take(size), size) << low
                k += 1
            elif run == 15:
                k += 16
            else:
                skip = (1 << run) + bits.take(run) - 1
                break


def _ac_refine(blocks: np.ndarray, table: Huffman, lo: int, hi: int, low: int, bits: Bits) -> None:
    one, i, n = 1 << low, 0, len(blocks)
    while i < n:
        block, k, run_of_blocks = blocks[i], lo, 0
        while k <= hi:
            s = bits.symbol(table)
            run, size = s >> 4, s & 15
            new = 0
            if size:
                if size != 1:
                    raise ValueError("a refined coefficient of more than one bit")
                new = one if bits.take(1) else -one
            elif run < 15:
                run_of_blocks = (1 << run) + bits.take(run)
                break
            while k <= hi:
                if block[k]:
                    if bits.take(1):
                        block[k] += one if block[k] > 0 else -one
                elif run == 0:
                    if new:
                        block[k] = new
                    k += 1
                    break
                else:
                    run -= 1
                k += 1
        if run_of_blocks:
            # the rest of this block, then whole blocks: only corrections
            if k > lo:
                for q in range(k, hi + 1):
                    if block[q] and bits.take(1):
                        block[q] += one if block[q] > 0 else -one
                i, run_of_blocks = i + 1, run_of_blocks - 1
            part = blocks[i:i + run_of_blocks, lo:hi + 1]
            known = part != 0
            total = int(known.sum())
            if bits.at + total > bits.end:
                raise ValueError("the scan ends too soon")
            fix = bits.bits[bits.at:bits.at + total].astype(np.int32) << low
            bits.at += total
            values = part[known]
            part[known] = values + np.sign(values) * fix
            i += run_of_blocks
        else:
            i += 1


def coefficients(data: bytes) -> Image:
    """All scans of a progressive JPEG, accumulated."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, image, interval, comment = 2, None, 0, b""
    quants: dict[int, np.ndarray] = {}
    tables: dict[tuple[int, int], Huffman] = {}
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("a marker was expected")
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        if kind == 0xD9:
            break
        size = int.from_bytes(data[at + 2:at + 4], "big")
        body, at = data[at + 4:at + 2 + size], at + 2 + size
        if kind == 0xDB:
            while body:
                wide, t = body[0] >> 4, body[0] & 15
                n = 128 if wide else 64
                quants[t] = np.frombuffer(body[1:1 + n], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[1 + n:]
        elif kind == 0xC4:
            while body:
                counts = list(body[1:17])
                tables[body[0] >> 4, body[0] & 15] = _huffman(tuple(counts), body[17:17 + sum(counts)])
                body = body[17 + sum(counts):]
        elif kind == 0xC2:
            if body[0] != 8 or body[5] not in (1, 3):
                raise ValueError("only 8 bits and 1 or 3 components are known")
            image = Image(int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big"), {body[6 + 3 * k]: Component(body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])})
        elif 0xC0 <= kind <= 0xCF and kind != 0xC8 and kind != 0xCC:
            raise ValueError("not a progressive Huffman JPEG")
        elif kind == 0xDD:
            interval = int.from_bytes(body[:2], "big")
        elif kind == 0xFE:
            comment = body
        elif kind == 0xDA:
            if image is None:
                raise ValueError("a scan before the frame")
            end = at
            while True:
                end = data.find(b"\xff", end)
                if end < 0 or end + 1 >= len(data):
                    raise ValueError("no end marker")
                if data[end + 1] and not 0xD0 <= data[end + 1] <= 0xD7:
                    break
                end += 2
            _scan(image, body, tables, data[at:end], interval)
            at = end
    if image is None:
        raise ValueError("no frame")
    image.quants, image.comment = quants, comment
    return image


def _scan(image: Image, head: bytes, tables: dict, data: bytes, interval: int) -> None:
    n = head[0]
    ids = [head[1 + 2 * k] for k in range(n)]
    picks = [head[2 + 2 * k] for k in range(n)]
    lo, hi, high, low = head[1 + 2 * n], head[2 + 2 * n], head[3 + 2 * n] >> 4, head[3 + 2 * n] & 15
    parts = [data]
    if interval:
        import re

        parts = re.split(rb"\xff[\xd0-\xd7]", data)
    if lo == 0:
        _dc_scan(image, ids, [tables.get((0, p >> 4)) for p in picks], high == 0, low, parts, interval)
        return
    order, table = image.own_order(ids[0]), tables[1, picks[0] & 15]
    flat = image.comps[ids[0]].coefs.reshape(-1, 64)
    step = interval or len(order)
    whole = len(order) == len(flat)
    for k, part in enumerate(parts):
        at = order[k * step:(k + 1) * step]
        blocks = flat[at[0]:at[-1] + 1] if whole else flat[at]
        (_ac_refine if high else _ac_first)(blocks, table, lo, hi, low, Bits(part))
        if not whole:
            flat[at] = blocks


def pixels(image: Image) -> np.ndarray:
    """(height, width, 3) uint8; chroma is repeated to full resolution."""
    planes = []
    for c in image.comps.values():
        rows, cols, _ = c.coefs.shape
        scaled = (c.coefs * image.quants[c.quant]).reshape(-1, 64).astype(np.float32)
        plane = (scaled @ BASIS).reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8)
        plane = np.clip(plane + np.float32(128), 0, 255)
        planes.append(np.repeat(np.repeat(plane, image.vmax // c.v, 0), image.hmax // c.h, 1)[:image.height, :image.width])
    y = planes[0]
    if len(planes) == 1:
        rgb = np.stack([y, y, y], -1)
    else:
        cb, cr = planes[1] - np.float32(128), planes[2] - np.float32(128)
        rgb = np.stack([y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb], -1)
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)


# ---- writing bytes as coefficients

_SINGLE = lambda symbol: bytes([1, *[0] * 15, symbol])  # noqa: E731  one code of one bit
_DC_TABLE = bytes([0, 0, 0, 9, *[0] * 12, *range(9)])
_EOB_TABLE = bytes([0, 0, 0, 15, *[0] * 12, *[r << 4 for r in range(15)]])
_BANDS = ((1, 5), (6, 63))


def _segment(kind: int, body: bytes) -> bytes:
    return bytes([0xFF, kind]) + (len(body) + 2).to_bytes(2, "big") + body


def _packed(bits: np.ndarray) -> bytes:
    if len(bits) % 8:
        bits = np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def _varied(words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Bits of code words of differing lengths, one after another."""
    ends = np.cumsum(lengths)
    out = np.zeros(int(ends[-1]), np.uint8)
    for j in range(int(lengths.max())):
        has = lengths > j
        out[ends[has] - 1 - j] = (words[has] >> j) & 1
    return out


def store(payload: bytes) -> bytes:
    """A progressive 4:2:0 JPEG from which ``payload_of`` gets the bytes back."""
    mcus = max(1, -(-len(payload) // 384))
    cols = math.isqrt(mcus - 1) + 1
    rows = -(-mcus // cols)
    if max(rows, cols) > 4095:
        raise ValueError("too large for one image")
    raw = np.frombuffer(payload.ljust(rows * cols * 384, b" "), np.uint8).reshape(rows, cols, 6, 64)
    luma = raw[:, :, :4].reshape(rows, cols, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64)
    planes = [luma, raw[:, :, 4].reshape(-1, 64), raw[:, :, 5].reshape(-1, 64)]
    out = [b"\xff\xd8", _segment(0xFE, str(len(payload)).encode()), _segment(0xDB, bytes([0]) + bytes([1]) * 64)]
    out.append(_segment(0xC2, bytes([8]) + (rows * 16).to_bytes(2, "big") + (cols * 16).to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    out.append(_segment(0xC4, bytes([0]) + _DC_TABLE + bytes([0x10]) + _SINGLE(7) + bytes([0x11]) + _EOB_TABLE))
    head = lambda ids, lo, hi, high, low, pick: _segment(0xDA, bytes([len(ids), *[x for i in ids for x in (i, pick)], lo, hi, high << 4 | low]))
    dc = raw[..., 0].astype(np.int32)
    dc = np.where(dc < 128, dc - 255, dc).reshape(-1, 6)
    half = dc >> 1
    diff = np.empty_like(half)
    for part in (slice(0, 4), slice(4, 5), slice(5, 6)):
        flat = half[:, part].reshape(-1)
        diff[:, part] = np.diff(flat, prepend=0).reshape(-1, part.stop - part.start)
    flat = diff.reshape(-1)
    size = np.frexp(np.abs(flat).astype(np.float64))[1].astype(np.int64)
    out += [head((1, 2, 3), 0, 0, 0, 1, 0), _packed(_varied((size << size) | np.where(flat < 0, flat + (1 << size) - 1, flat), size + 4))]
    for lo, hi in _BANDS:
        for i, p in enumerate(planes):
            out += [head((i + 1,), lo, hi, 0, 1, 0), (p[:, lo:hi + 1] >> 1).tobytes()]
    out += [head((1, 2, 3), 0, 0, 1, 0, 0), _packed((dc & 1).astype(np.uint8).reshape(-1))]
    for i, p in enumerate(planes):
        odd = (p[:, 1:] & 1) ^ (p[:, 1:] < 128)
        bits, at = [], 0
        while at < len(p):
            r = min(14, (len(p) - at).bit_length() - 1)
            run = min(len(p) - at, (2 << r) - 1)
            word = (r << r) | (run - (1 << r))
            bits += [np.array([(word >> j) & 1 for j in range(r + 3, -1, -1)], np.uint8), odd[at:at + run].reshape(-1).astype(np.uint8)]
            at += run
        out += [head((i + 1,), 1, 63, 1, 0, 1), _packed(np.concatenate(bits))]
    return b"".join([*out, b"\xff\xd9"])


def payload_of(image: Image) -> bytes:
    values = [c.coefs for c in image.comps.values()]
    rows, cols = image.rows, image.cols
    luma = values[0].reshape(rows, 2, cols, 2, 64).transpose(0, 2, 1, 3, 4).reshape(rows, cols, 4, 64)
    whole = np.concatenate([luma, values[1][:, :, None], values[2][:, :, None]], 2)
    return np.where(whole < 0, whole + 255, whole).astype(np.uint8).tobytes()[:int(image.comment)]


def features(rgb: np.ndarray) -> str:
    """Size, then the mean and deviation of red, green and blue."""
    flat = rgb.reshape(-1, 3).astype(np.int64)
    n, total, square = len(flat), flat.sum(0), (flat * flat).sum(0)
    return f"{rgb.shape[0]}x{rgb.shape[1]} " + " ".join(f"{t / n:.3f}/{math.sqrt(max(0, q / n - (t / n) ** 2)):.3f}" for t, q in zip(total.tolist(), square.tolist()))


# ---- columns

def decode(rows: DataFrame, media: str = "media") -> DataFrame:
    """Adds height, width, rgb (row-major bytes, 3 a pixel) and media_error to
    rows with a JPEG column, replacing columns so named. A null gives nulls; what
    isn't a whole progressive JPEG gives the reason in media_error."""
    added = [T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("rgb", T.BinaryType()), T.StructField("media_error", T.StringType())]
    base = rows.select(*[c for c in rows.columns if c not in {f.name for f in added}])
    at = base.columns.index(media)

    def one(data):
        if data is None:
            return None, None, None, None
        try:
            rgb = pixels(coefficients(data))
            return rgb.shape[0], rgb.shape[1], rgb.tobytes(), None
        except (ValueError, KeyError, IndexError) as e:
            return None, None, None, str(e)

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                got = [one(x) for x in part.column(at).to_pylist()]
                more = [pa.array(col, kind) for col, kind in zip(zip(*got), (pa.int32(), pa.int32(), pa.binary(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*part.schema.names, *[f.name for f in added]])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, *added]))


STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def op7_progressive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a progressive JPEG, decoded again. A null or empty text is a
    payload of 192 spaces; a very long one is an image of as many units; equal texts,
    and rows that repeat, give equal values; other columns are not read; no rows
    give none."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))

    def run(batches):
        names = [f.split()[0] for f in STORED.split(", ")]
        for batch in batches:
            got = []
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = raw.as_py() or b""
                media = store(raw.ljust(max(192, -(-len(raw) // 192) * 192), b" "))
                image = coefficients(media)
                payload = payload_of(image)
                got.append((doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(pixels(image))))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], kind) for k, kind in enumerate(kinds)], names)

    return docs.mapInArrow(run, STORED)
