"""Media columns: progressive JPEG, stored and read back losslessly, with full-resolution RGB tensors.

Storing. The format's unit is the quantised DCT coefficient. A payload byte b becomes the coefficient b - 126 (b
from 128 on) or b - 129: never -1, 0 or 1. Coefficients fill the 8x8 blocks of a 4:2:0 image (four of Y, one each
of Cb and Cr in every 16x16 unit), and the image is written with several scans: DC at half precision, AC
bands at half precision (1-5 and 6-63 of Y, 1-63 of Cb and Cr), then the DC and the AC refinements of the last bit. The Huffman code of a
magnitude category of s bits has 16 - s bits, so code and value fill 16 bits and a scan can be written and read
as one array of words.

Reading. ``read_jpeg`` takes any progressive JPEG of 8 bits with Huffman codes: spectral selection, successive
approximation, end-of-band runs, restart intervals, sampling factors 1 to 4. All scans add up in coefficient
arrays; a scan whose codes all fill 16 bits is decoded with array operations, any other bit by bit. Coefficients
are dequantised and inverse-transformed in numpy, chroma is upsampled and RGB tensors come out.

Cases: null is an empty text; the payload is padded to a positive multiple of 192 with bytes 32; equal texts give
equal media. A file that breaks off or is no progressive JPEG raises ValueError. Rows come back one for one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import sha256
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import discard, materialize

UNIT = 192
#: Parts of the media column whose tensors are stored at a time.
SLICES = 16

#: The order in which a JPEG block's 64 coefficients are stored (zigzag position -> row * 8 + column).
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i % 8 if (i // 8 + i % 8) % 2 == 0 else i // 8)))


@lru_cache(1)
def _idct() -> np.ndarray:
    """64 zigzag coefficients -> 64 samples, as a matrix."""
    k = np.arange(8)
    c = np.cos((2 * k[:, None] + 1) * k[None, :] * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), np.sqrt(1 / 4))
    return np.ascontiguousarray(np.einsum("yv,xu->vuyx", c, c).reshape(64, 64)[ZIGZAG]).astype(np.float32)


# ---- writing -------------------------------------------------------------------------------------------------


def _table(lengths: dict[int, int]) -> bytes:
    """A Huffman table segment's body from symbol -> code length."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    return bytes(sum(lengths[s] == n for s in order) for n in range(1, 17)) + bytes(order)


@lru_cache(64)
def _codes(body: bytes) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length)."""
    out, code, at = {}, 0, 16
    for n in range(1, 17):
        for _ in range(body[n - 1]):
            out[body[at]] = (code, n)
            code, at = code + 1, at + 1
        code <<= 1
    return out


_DC_TABLE = _table({s: 16 - s for s in range(12)})
_AC_TABLE = _table({s: 16 - s for s in range(1, 11)})
#: For refinements: the end of the block, one bit.
_END_TABLE = _table({0: 1})


@lru_cache(2)
def _word_of(body: bytes) -> np.ndarray:
    """value + 32768 -> the 16 bits of its code and value, for the fixed-width tables."""
    codes = _codes(body)
    out = np.zeros(1 << 16, ">u2")
    for v in range(-2047, 2048):
        s = abs(v).bit_length()
        if s in codes:
            code, n = codes[s]
            if n + s == 16:
                out[v + 32768] = (code << s) | (v if v >= 0 else v + (1 << s) - 1)
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _scan(components: list[tuple[int, int]], first: int, last: int, high: int, low: int, data: bytes) -> bytes:
    head = bytes([len(components), *(x for c, t in components for x in (c, t)), first, last, high << 4 | low])
    return _segment(0xDA, head) + data.replace(b"\xff", b"\xff\x00")


def _bits(bits: np.ndarray) -> bytes:
    """Bits to bytes, filled up with ones."""
    return np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])).tobytes()


def write_jpeg(payload: bytes) -> bytes:
    """A progressive JPEG that holds the payload, a positive multiple of UNIT bytes, in its coefficients."""
    units = -(-len(payload) // (2 * UNIT))
    rows = -(-units // 4095)
    columns = -(-units // rows)
    units = rows * columns
    data = np.full(units * 2 * UNIT, 32, np.int16)
    data[: len(payload)] = np.frombuffer(payload, np.uint8)
    blocks = (data - np.where(data >= 128, 126, 129).astype(np.int16)).reshape(-1, 64)
    parts = [blocks[: 4 * units], blocks[4 * units : 5 * units], blocks[5 * units :]]  # each by rows of blocks
    size = (16 * rows).to_bytes(2, "big") + (16 * columns).to_bytes(2, "big")
    out = [b"\xff\xd8", _segment(0xFE, b"payload=%d" % len(payload)), _segment(0xDB, b"\0" + b"\1" * 64), _segment(0xC2, b"\x08" + size + b"\x03\x01\x22\x00\x02\x11\x00\x03\x11\x00")]
    out.append(_segment(0xC4, b"\x00" + _DC_TABLE + b"\x10" + _AC_TABLE + b"\x11" + _END_TABLE))
    dc = [p[:, 0].astype(np.int32) for p in parts]
    y = dc[0].reshape(rows, 2, columns, 2).transpose(0, 2, 1, 3).reshape(-1, 4)  # in the order of units
    half = [y.ravel() >> 1, dc[1] >> 1, dc[2] >> 1]
    steps = [np.diff(h, prepend=0) for h in half]
    words = np.hstack([steps[0].reshape(-1, 4), steps[1][:, None], steps[2][:, None]])
    out.append(_scan([(1, 0), (2, 0), (3, 0)], 0, 0, 0, 1, _word_of(_DC_TABLE)[words.ravel() + 32768].tobytes()))
    sign = [np.sign(p) for p in parts]
    size_of = [np.abs(p) for p in parts]
    for c in range(3):
        first = _word_of(_AC_TABLE)[(sign[c] * (size_of[c] >> 1)).astype(np.int32) + 32768]
        for a, b in ((1, 5), (6, 63)) if c == 0 else ((1, 63),):
            out.append(_scan([(c + 1, 0)], a, b, 0, 1, np.ascontiguousarray(first[:, a : b + 1]).tobytes()))
    out.append(_scan([(1, 0), (2, 0), (3, 0)], 0, 0, 1, 0, _bits(np.hstack([y & 1, dc[1][:, None] & 1, dc[2][:, None] & 1]).astype(np.uint8).ravel())))
    for c in range(3):
        low = (size_of[c] & 1).astype(np.uint8)
        low[:, 0] = 0  # in its place: the code of the end of the block, a zero bit
        out.append(_scan([(c + 1, 1)], 1, 63, 1, 0, _bits(low.ravel())))
    out.append(b"\xff\xd9")
    return b"".join(out)


# ---- reading -------------------------------------------------------------------------------------------------


@dataclass
class Component:
    id: int
    h: int
    v: int
    quant: int
    width: int = 0  # in blocks, of scans of its own
    height: int = 0
    stride: int = 0  # in blocks, padded to whole units
    blocks: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int32))


@dataclass
class Image:
    width: int
    height: int
    components: list[Component]
    quant: dict[int, np.ndarray]
    comments: list[bytes]


@lru_cache(64)
def _lookup(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each 16 bits that follow: the symbol and the length of its code, 0 for no code."""
    symbol, length = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    for s, (code, n) in _codes(body).items():
        symbol[code << (16 - n) : (code + 1) << (16 - n)] = s
        length[code << (16 - n) : (code + 1) << (16 - n)] = n
    return symbol, length


@lru_cache(64)
def _whole_words(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each 16 bits: whether a code without a run and its value fill them exactly, and the value."""
    symbol, length = (x.astype(np.int32) for x in _lookup(body))
    size = symbol & 15
    ok = (length > 0) & (symbol < 16) & (length + size == 16)
    raw = np.arange(1 << 16) & ((1 << size) - 1)
    return ok, np.where(size == 0, 0, np.where(raw >= 1 << np.maximum(size - 1, 0), raw, raw - (1 << size) + 1)).astype(np.int32)


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.n = data, 0, 8 * len(data)

    def take(self, k: int) -> int:
        if not k:
            return 0
        if self.at + k > self.n + 64:
            raise ValueError("the scan breaks off")
        a, b = self.at >> 3, (self.at + k + 7) >> 3
        word = int.from_bytes(self.data[a:b].ljust(b - a, b"\xff"), "big") >> (8 * b - self.at - k)
        self.at += k
        return word & ((1 << k) - 1)

    def symbol(self, table: tuple[np.ndarray, np.ndarray]) -> int:
        at = self.at
        word = self.take(16)
        n = int(table[1][word])
        if not n:
            raise ValueError("no such Huffman code")
        self.at = at + n
        return int(table[0][word])

    def value(self, size: int) -> int:
        raw = self.take(size)
        return raw if not size or raw >> (size - 1) else raw - (1 << size) + 1


@lru_cache(4096)
def _raster(width: int, height: int, stride: int) -> np.ndarray:
    """The blocks of a scan of one component, a unit each."""
    return (np.arange(height)[:, None] * stride + np.arange(width)).reshape(-1, 1)


@lru_cache(4096)
def _interleaved(across: int, down: int, h: int, v: int) -> np.ndarray:
    """The blocks of a component in each unit of a scan of several."""
    return ((np.arange(down)[:, None, None, None] * v + np.arange(v)[:, None]) * (across * h) + np.arange(across)[:, None, None] * h + np.arange(h)).reshape(across * down, -1)


def _slow_scan(parts: list[bytes], order: list[list[tuple[Component, int]]], interval: int, tables: list, first: int, last: int, high: int, low: int) -> None:
    """One scan bit by bit. ``order``: for each unit its blocks, with the number of the component in the scan."""
    per = interval or len(order)
    for k, data in enumerate(parts):
        bits, predicted, run = _Bits(data), {}, 0
        for unit in order[k * per : (k + 1) * per]:
            for (component, at), table in zip(unit, tables, strict=False) if len(unit) == len(tables) else ((x, tables[0]) for x in unit):
                block = component.blocks[at]
                if first == 0:
                    if high:
                        block[0] |= bits.take(1) << low
                    else:
                        predicted[component.id] = predicted.get(component.id, 0) + bits.value(bits.symbol(table))
                        block[0] = predicted[component.id] << low
                elif not high:
                    if run:
                        run -= 1
                        continue
                    at = first
                    while at <= last:
                        zeros, size = divmod(bits.symbol(table), 16)
                        if size:
                            at += zeros
                            if at > 63:
                                raise ValueError("a run leaves the block")
                            block[at] = bits.value(size) * (1 << low)
                            at += 1
                        elif zeros == 15:
                            at += 16
                        else:
                            run = (1 << zeros) + bits.take(zeros) - 1
                            break
                else:
                    run = _refine(bits, block, table, first, last, low, run)


def _refine(bits: _Bits, block: np.ndarray, table: tuple, at: int, last: int, low: int, run: int) -> int:
    bit = 1 << low

    def correct(i: int) -> None:
        if bits.take(1) and not abs(int(block[i])) & bit:
            block[i] += bit if block[i] > 0 else -bit

    if not run:
        while at <= last:
            zeros, size = divmod(bits.symbol(table), 16)
            if not size and zeros < 15:
                run = (1 << zeros) + bits.take(zeros)
                break
            new = (bit if bits.take(1) else -bit) if size else 0
            while at <= last:
                if block[at]:
                    correct(at)
                elif zeros:
                    zeros -= 1
                else:
                    if new:
                        block[at] = new
                    at += 1
                    break
                at += 1
        else:
            return 0
    for i in range(at, last + 1):
        if block[i]:
            correct(i)
    return run - 1


def _fast_scan(data: bytes, chosen: list[Component], places: list[np.ndarray], bodies: list[bytes], first: int, last: int, high: int, low: int) -> bool:
    """The same for a scan that is uniform: by arrays. False, and nothing changed, if it is not."""
    n, units = sum(p.shape[1] for p in places), len(places[0])
    if first == 0 and high:
        if len(data) != -(-units * n // 8):
            return False
        bits = np.unpackbits(np.frombuffer(data, np.uint8), count=units * n).reshape(units, n)
        at = 0
        for c, p in zip(chosen, places, strict=True):
            c.blocks[p, 0] |= bits[:, at : at + p.shape[1]].astype(np.int32) << low
            at += p.shape[1]
        return True
    c, span = chosen[0], last - first + 1
    # a scan of a whole component goes through its blocks in order
    at = slice(None) if len(chosen) == 1 and units == len(c.blocks) else places[0].ravel()
    if high:
        # each block: the end of the block in one zero bit, and a correction for each coefficient, all of them known
        if _codes(bodies[0]).get(0) != (0, 1) or len(data) != -(-units * (span + 1) // 8):
            return False
        now = c.blocks[at, first : last + 1]
        bits = np.unpackbits(np.frombuffer(data, np.uint8), count=units * (span + 1)).reshape(units, span + 1)
        if bits[:, 0].any() or not now.all():
            return False
        more = bits[:, 1:].astype(np.int32) << low
        c.blocks[at, first : last + 1] = np.where(now > 0, now + (more & ~now), now - (more & ~-now))
        return True
    if len(data) != 2 * units * n * span or len(set(bodies)) > 1:
        return False
    ok, value = _whole_words(bodies[0])
    words = np.frombuffer(data, ">u2").astype(np.uint16)
    if not ok[words].all():
        return False
    got = value[words]
    if first == 0:
        got, begin = got.reshape(units, n), 0
        for c, p in zip(chosen, places, strict=True):
            c.blocks[p.ravel(), 0] = np.cumsum(got[:, begin : begin + p.shape[1]].ravel()) << low
            begin += p.shape[1]
        return True
    if not got.all():
        return False
    c.blocks[at, first : last + 1] = got.reshape(units, span) << low
    return True


def read_jpeg(data: bytes, fast: bool = True) -> Image:
    """All scans of a progressive JPEG, in coefficient arrays (zigzag order, padded to whole units)."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    at, image, tables, quant, comments, interval = 2, None, {}, {}, [], 0
    while True:
        if at + 2 > len(data) or data[at] != 0xFF:
            raise ValueError("the file breaks off")
        marker = data[at + 1]
        if marker == 0xD9:
            break
        if marker == 0xFF:
            at += 1
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE:
            comments.append(body)
        elif marker == 0xDD:
            interval = int.from_bytes(body[:2], "big")
        elif marker == 0xDB:
            while body:
                n = 128 if body[0] >> 4 else 64
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if n == 128 else np.uint8).astype(np.float32)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = 16 + sum(body[1:17])
                tables[body[0]] = body[1 : 1 + n]
                body = body[1 + n :]
        elif marker == 0xC2:
            height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            image = Image(width, height, [Component(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)], quant, comments)
            h, v = max(c.h for c in image.components), max(c.v for c in image.components)
            across, down = -(-width // (8 * h)), -(-height // (8 * v))
            for c in image.components:
                c.width, c.height = -(-(-(-width * c.h // h)) // 8), -(-(-(-height * c.v // v)) // 8)
                c.stride = across * c.h
                c.blocks = np.zeros((c.stride * down * c.v, 64), np.int32)
        elif 0xC0 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("not a progressive JPEG with Huffman codes")
        elif marker == 0xDA:
            if image is None:
                raise ValueError("a scan before the frame")
            by_id = {c.id: c for c in image.components}
            chosen = [by_id[body[1 + 2 * i]] for i in range(body[0])]
            selectors = [body[2 + 2 * i] for i in range(body[0])]
            first, last, precision = body[1 + 2 * body[0] : 4 + 2 * body[0]]
            high, low = precision >> 4, precision & 15
            end = at
            while True:
                end = data.find(b"\xff", end)
                if end < 0 or end + 1 >= len(data):
                    raise ValueError("the scan breaks off")
                if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                    end += 2
                    continue
                break
            raw, at = data[at:end], end
            parts = [raw]
            if interval:
                parts, begin, i = [], 0, 0
                while (i := raw.find(b"\xff", i)) >= 0:
                    if 0xD0 <= raw[i + 1] <= 0xD7:
                        parts.append(raw[begin:i])
                        begin = i + 2
                    i += 2
                parts.append(raw[begin:])
            parts = [p.replace(b"\xff\x00", b"\xff") for p in parts]
            bodies = [tables.get((0x10 if first else 0) | ((s & 15) if first else s >> 4), b"") for s in selectors]
            places = [_raster(c.width, c.height, c.stride) for c in chosen] if len(chosen) == 1 else [_interleaved(across, down, c.h, c.v) for c in chosen]
            if fast and len(parts) == 1 and _fast_scan(parts[0], chosen, places, bodies, first, last, high, low):
                continue
            order = [[(c, int(b)) for c, p in zip(chosen, places, strict=True) for b in p[u]] for u in range(len(places[0]))]
            looked = [_lookup(b) if b else (np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)) for b in bodies]
            each = [t for t, p in zip(looked, places, strict=True) for _ in range(p.shape[1])]
            _slow_scan(parts, order, interval, each, first, last, high, low)
    if image is None:
        raise ValueError("the file has no frame")
    return image


def to_rgb(image: Image) -> np.ndarray:
    """Height x width x 3 samples, uint8: the inverse transform, chroma at full resolution."""
    h, v = max(c.h for c in image.components), max(c.v for c in image.components)
    planes = []
    for c in image.components:
        samples = (c.blocks * image.quant[c.quant]).astype(np.float32) @ _idct()
        plane = samples.reshape(-1, c.stride, 8, 8).transpose(0, 2, 1, 3).reshape(-1, c.stride * 8)
        if (c.v, c.h) != (v, h):
            plane = plane.repeat(v // c.v, axis=0).repeat(h // c.h, axis=1)
        planes.append(plane[: image.height, : image.width])
    if len(planes) == 1:
        rgb = np.stack([planes[0] + 128] * 3, axis=-1)
    else:
        y, cb, cr = planes[0] + 128, planes[1], planes[2]
        # fixed values: YCbCr to RGB of JFIF
        rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=-1)
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)


def payload_of(image: Image) -> bytes:
    """The payload that ``write_jpeg`` stored."""
    length = next((int(c[8:]) for c in image.comments if c.startswith(b"payload=")), None)
    if length is None:
        raise ValueError("no payload")
    values = np.concatenate([c.blocks for c in image.components]).ravel()[:length]
    return (values + np.where(values > 0, 126, 129)).astype(np.uint8).tobytes()


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (-len(raw) % UNIT or (0 if raw else UNIT)), len(raw)


# ---- columns -------------------------------------------------------------------------------------------------


def store(text: Column) -> Column:
    """The media column: each text's payload as a progressive JPEG."""

    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: write_jpeg(padded(t)[0]))

    return run(text)


def tensors(media: Column) -> Column:
    """A struct (height, width, rgb) with the full-resolution tensor of each JPEG, rows first, 3 bytes a pixel."""

    @F.pandas_udf("height int, width int, rgb binary")
    def run(images: pd.Series) -> pd.DataFrame:
        found = [to_rgb(read_jpeg(x)) for x in images]
        return pd.DataFrame({"height": [x.shape[0] for x in found], "width": [x.shape[1] for x in found], "rgb": [x.tobytes() for x in found]})

    return run(media)


DESCRIPTION = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _described(images: pd.Series, stored: pd.DataFrame | None = None) -> pd.DataFrame:
    out = []
    for i, data in enumerate(images):
        image = read_jpeg(data)
        payload = payload_of(image)
        rgb = to_rgb(image) if stored is None else np.frombuffer(stored["rgb"].iloc[i], np.uint8).reshape(stored["height"].iloc[i], stored["width"].iloc[i], 3)
        pixels = rgb.reshape(-1, 3)
        mean = pixels.mean(axis=0, dtype=np.float64)
        deviation = np.sqrt(np.maximum(0, np.square(pixels, dtype=np.uint32).mean(axis=0, dtype=np.float64) - mean**2))
        feature = " ".join(f"{x:.2f}" for x in (*mean, *deviation)) + f" {image.width}x{image.height} {crc32(rgb):08x}"
        out.append((len(payload), sha256(payload).hexdigest(), crc32(payload[-16:]), len(data), sha256(data).hexdigest(), feature))
    return pd.DataFrame(out, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def describe(media: Column) -> Column:
    """Reads stored JPEGs back: digests of payload and file, and features of the RGB tensor (means and deviations
    of the channels, and the CRC-32 of the tensor)."""

    @F.pandas_udf(DESCRIPTION)
    def run(images: pd.Series) -> pd.DataFrame:
        return _described(images)

    return run(media)


def media(documents: DataFrame) -> DataFrame:
    """``documents(doc_id, text)`` as doc_id, n_bytes, media."""
    return documents.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), store(F.col("text")).alias("media"))


def digests(stored: DataFrame) -> DataFrame:
    """Of ``media``'s rows: what reading them back shows. A stored tensor, if there, is read, not made anew."""

    @F.pandas_udf(DESCRIPTION)
    def both(images: pd.Series, found: pd.DataFrame) -> pd.DataFrame:
        return _described(images, found)

    d = both("media", "tensor") if "tensor" in stored.columns else describe(F.col("media"))
    return stored.select("doc_id", "n_bytes", d.alias("d")).select("doc_id", "n_bytes", "d.*")


def stored(documents: DataFrame) -> DataFrame:
    """``media``'s rows with their full-resolution RGB tensors, as a table in the shared folder."""
    return materialize(media(documents).withColumn("tensor", tensors(F.col("media"))))


def sliced_digests(documents: DataFrame, slices: int = SLICES) -> DataFrame:
    """``digests`` of all documents from stored media and stored tensors. The media of all documents are a table in the
    shared folder; the tensors, three times their size, are written and read back slice by slice, and a slice is deleted
    before the next one is written. The digests are a table, too."""
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(slices)).cast("int").alias("slice")
    rows = documents.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), store(F.col("text")).alias("media"), part)
    kept = materialize(rows, by="slice", compression="zstd")
    paths = []
    for k in range(slices):
        part = materialize(kept.where(F.col("slice") == k).drop("slice").withColumn("tensor", tensors(F.col("media"))), compression="zstd")
        found = materialize(digests(part))
        discard(part)
        paths.append(found._graphloom_folder)
    return documents.sparkSession.read.schema(found.schema).parquet(*paths)
