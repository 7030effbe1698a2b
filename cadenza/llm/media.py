"""Progressive JPEG media columns.

Payload bytes are stored as DCT coefficients, the unit in which a JPEG file is lossless. The decoder
accumulates all scans (spectral selection and successive approximation) into coefficient arrays,
reads the payload back from them, inverse-transforms the blocks in numpy, upsamples the chroma
planes and returns full-resolution RGB tensors.

Entropy-coded scans are decoded symbol by symbol in general. Where a scan's Huffman table has one
symbol only, as in the scans written here, every block of it has the same number of bits and the
whole scan is unpacked at once.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import text_of

#: The zigzag order of an 8x8 block, from its rule: antidiagonals, every other one reversed.
ZIGZAG = np.array([r * 8 + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))])
#: A coefficient is a byte plus this: all coefficients share one size category, so none is zero.
BASE = 256
LEVELS = 12  # DC size categories 0..11, as codes of four bits each
DCT = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)], np.float32)
#: Scans after the first DC scan: component, first and last coefficient, high and low bit.
SCANS = [(0, 1, 5, 0, 1), (0, 6, 63, 0, 1), (1, 1, 63, 0, 1), (2, 1, 63, 0, 1), (0, 1, 63, 1, 0), (1, 1, 63, 1, 0), (2, 1, 63, 1, 0)]


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _stuffed(bits: np.ndarray) -> bytes:
    """Bits as entropy-coded bytes: padded with ones, 0xFF followed by 0."""
    short = -len(bits) % 8
    if short:
        bits = np.concatenate([bits, np.ones(short, np.uint8)])
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def _table(kind: int, at: int, symbols: list[int], length: int) -> bytes:
    counts = bytearray(16)
    counts[length - 1] = len(symbols)
    return _segment(0xC4, bytes([kind << 4 | at]) + bytes(counts) + bytes(symbols))


#: Everything in a file that doesn't depend on the payload: one quantization table of ones, a DC table
#: with codes of four bits, and AC tables of one symbol each (size 8; end of block), codes of one bit.
TABLES = _segment(0xDB, bytes([0]) + bytes([1] * 64)) + _table(0, 0, list(range(LEVELS)), 4) + _table(1, 0, [0x08], 1) + _table(1, 1, [0x00], 1)


def shape(blocks: int) -> tuple[int, int]:
    """Width and height in MCUs (four luma and two chroma blocks each) that hold so many blocks."""
    mcus = max(1, -(-blocks // 6))
    wide = int(np.ceil(np.sqrt(mcus)))
    return wide, -(-mcus // wide)


def encode(payload: bytes) -> bytes:
    """A progressive 4:2:0 JPEG whose coefficients, in component order, are the payload's bytes plus BASE.

    The payload is a multiple of 64 bytes; blocks of zero bytes fill the last MCUs, and a comment
    segment tells the payload's length.
    """
    wide, high = shape(len(payload) // 64)
    m = wide * high
    if max(wide, high) > 4095:
        raise ValueError("the payload needs an image larger than the format allows")
    data = np.zeros((6 * m, 64), np.uint8)
    data.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    part = [data[: 4 * m], data[4 * m : 5 * m], data[5 * m :]]
    frame = struct.pack(">BHHB", 8, 16 * high, 16 * wide, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    out = [b"\xff\xd8", TABLES, _segment(0xFE, struct.pack(">Q", len(payload))), _segment(0xC2, frame)]
    for i, p in enumerate(part):  # DC, bits above the lowest, a scan for each component
        dc = (p[:, 0].astype(np.int64) + BASE) >> 1
        diff = np.diff(dc, prepend=0)
        size = np.where(diff == 0, 0, np.floor(np.log2(np.maximum(np.abs(diff), 1))).astype(int) + 1)
        extra = np.where(diff < 0, diff + (1 << size) - 1, diff)
        word, width = (size << 11) | (extra << (11 - size)), 4 + size  # code and extra bits, left-aligned in 15
        bits = ((word[:, None] >> np.arange(14, -1, -1)) & 1).astype(np.uint8)
        out += [_scan([i], 0, 0, 0, 1, 0), _stuffed(bits[np.arange(15)[None, :] < width[:, None]])]
    for i, first, last, high_bit, low in SCANS:
        p = part[i][:, first : last + 1]
        if high_bit == 0:  # code 0, then the eight bits of (byte + BASE) >> 1
            bits = np.zeros((*p.shape, 9), np.uint8)
            bits[:, :, 1:] = np.unpackbits(0x80 | p >> 1, axis=1).reshape(*p.shape, 8)
            out += [_scan([i], first, last, 0, low, 0), _stuffed(bits.reshape(-1))]
        else:  # end of block, then a correction bit for every coefficient
            bits = np.zeros((len(p), p.shape[1] + 1), np.uint8)
            bits[:, 1:] = p & 1
            out += [_scan([i], first, last, high_bit, low, 1), _stuffed(bits.reshape(-1))]
    for i, p in enumerate(part):
        out += [_scan([i], 0, 0, 1, 0, 0), _stuffed(p[:, 0] & 1)]
    out.append(b"\xff\xd9")
    return b"".join(out)


def _scan(components: list[int], first: int, last: int, high: int, low: int, table: int) -> bytes:
    return _segment(0xDA, bytes([len(components)]) + b"".join(bytes([c + 1, table]) for c in components) + bytes([first, last, high << 4 | low]))


@dataclass
class Component:
    key: int
    h: int
    v: int
    quant: int
    wide: int = 0
    high: int = 0
    stride: int = 0
    coef: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int32))


@dataclass
class Image:
    """A decoded file: its size, its components' coefficients (blocks in rows, zigzag order) and its comment."""

    width: int
    height: int
    components: list[Component]
    quant: dict[int, np.ndarray]
    comment: bytes


class Bits:
    """Reads an entropy-coded segment bit by bit; past its end come zeros."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.acc, self.n = raw, 0, 0, 0

    def bits(self, n: int) -> int:
        while self.n < n:
            self.acc = (self.acc << 8) | (self.raw[self.at] if self.at < len(self.raw) else 0)
            self.at += 1
            self.n += 8
        self.n -= n
        out = self.acc >> self.n
        self.acc &= (1 << self.n) - 1
        return out

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.bits(1)
            if (length, code) in table:
                return table[length, code]
        raise ValueError("a code that isn't in the Huffman table")

    def signed(self, size: int) -> int:
        x = self.bits(size) if size else 0
        return x if size == 0 or x >> (size - 1) else x - (1 << size) + 1


def decode(raw: bytes) -> Image:
    """All scans of a progressive (or sequential-spectral) Huffman file, accumulated."""
    huff: dict[tuple[int, int], dict[tuple[int, int], int]] = {}
    quant: dict[int, np.ndarray] = {}
    image: Image | None = None
    comment, restart, at = b"", 0, 2
    if raw[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    while at < len(raw):
        if raw[at] != 0xFF:
            raise ValueError("a marker was expected")
        marker = raw[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        n = struct.unpack_from(">H", raw, at + 2)[0]
        body = raw[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xDB:
            p = 0
            while p < len(body):
                wide = body[p] >> 4
                quant[body[p] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, p + 1).astype(np.int32)
                p += 65 + 64 * bool(wide)
        elif marker == 0xC4:
            p = 0
            while p < len(body):
                counts = body[p + 1 : p + 17]
                huff[body[p] >> 4, body[p] & 15], p = _codes(counts, body[p + 17 :]), p + 17 + sum(counts)
        elif marker == 0xFE:
            comment = bytes(body)
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xC2:
            image = _frame(body, quant)
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only progressive Huffman files are decoded")
        elif marker == 0xDA:
            end = at
            while True:  # to the next marker that isn't a restart or a stuffed byte
                end = raw.find(b"\xff", end)
                if end < 0:
                    end = len(raw)
                    break
                if raw[end + 1 : end + 2] and raw[end + 1] != 0 and not 0xD0 <= raw[end + 1] <= 0xD7:
                    break
                end += 2
            _read_scan(image, body, raw[at:end], huff, restart)
            at = end
    if image is None:
        raise ValueError("no frame")
    image.comment = comment
    return image


def _codes(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    out, code, k = {}, 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            out[length, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _frame(body: bytes, quant: dict[int, np.ndarray]) -> Image:
    _, height, width, n = struct.unpack_from(">BHHB", body)
    parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
    hm, vm = max(c.h for c in parts), max(c.v for c in parts)
    mw, mh = -(-width // (8 * hm)), -(-height // (8 * vm))
    for c in parts:
        c.wide, c.high = -(-(-(-width * c.h // hm)) // 8), -(-(-(-height * c.v // vm)) // 8)
        c.stride = mw * c.h
        c.coef = np.zeros((mh * c.v * c.stride, 64), np.int32)
    return Image(width, height, parts, quant, b"")


def _read_scan(image: Image, body: bytes, data: bytes, huff: dict, restart: int) -> None:
    n = body[0]
    chosen = [(next(c for c in image.components if c.key == body[1 + 2 * i]), body[2 + 2 * i]) for i in range(n)]
    first, last, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
    if n == 1 and not restart and _read_uniform(*chosen[0], data.replace(b"\xff\x00", b"\xff"), first, last, high, low, huff):
        return
    units: list[list[tuple[Component, int, int]]] = []
    if n == 1:
        c, t = chosen[0]
        units = [[(c, t, y * c.stride + x)] for y in range(c.high) for x in range(c.wide)]
    else:
        c0 = chosen[0][0]
        for my in range(len(c0.coef) // c0.stride // c0.v):
            for mx in range(c0.stride // c0.h):
                units.append([(c, t, (my * c.v + y) * c.stride + mx * c.h + x) for c, t in chosen for y in range(c.v) for x in range(c.h)])
    per = restart or len(units)
    pieces = _restarts(data) if restart else [data]
    for k, piece in enumerate(pieces):
        bits, dc, run = Bits(piece.replace(b"\xff\x00", b"\xff")), dict.fromkeys((c.key for c, _ in chosen), 0), [0]
        for unit in units[k * per : (k + 1) * per]:
            for c, t, at in unit:
                z = c.coef[at]
                if first == 0:
                    if high:
                        z[0] |= bits.bits(1) << low
                    else:
                        dc[c.key] += bits.signed(bits.symbol(huff[0, t >> 4]))
                        z[0] = dc[c.key] << low
                elif high:
                    _refine(bits, z, huff[1, t & 15], first, last, low, run)
                else:
                    _first_ac(bits, z, huff[1, t & 15], first, last, low, run)


def _restarts(data: bytes) -> list[bytes]:
    out, at = [], 0
    k = data.find(b"\xff")
    while k >= 0:
        if k + 1 < len(data) and 0xD0 <= data[k + 1] <= 0xD7:
            out.append(data[at:k])
            at = k + 2
        k = data.find(b"\xff", k + 2)
    return [*out, data[at:]]


def _first_ac(bits: Bits, z: np.ndarray, table: dict, first: int, last: int, low: int, run: list[int]) -> None:
    if run[0]:
        run[0] -= 1
        return
    k = first
    while k <= last:
        s = bits.symbol(table)
        zeros, size = s >> 4, s & 15
        if size:
            k += zeros
            z[k] = bits.signed(size) * (1 << low)
            k += 1
        elif zeros == 15:
            k += 16
        else:
            run[0] = (1 << zeros) - 1 + (bits.bits(zeros) if zeros else 0)
            return


def _refine(bits: Bits, z: np.ndarray, table: dict, first: int, last: int, low: int, run: list[int]) -> None:
    one, k = 1 << low, first

    def correct(i: int) -> None:
        if bits.bits(1) and not abs(int(z[i])) & one:
            z[i] += one if z[i] > 0 else -one

    if not run[0]:
        while k <= last:
            s = bits.symbol(table)
            zeros, size = s >> 4, s & 15
            new = 0
            if size:
                new = one if bits.bits(1) else -one
            elif zeros < 15:
                run[0] = (1 << zeros) + (bits.bits(zeros) if zeros else 0)
                break
            while k <= last:
                if z[k]:
                    correct(k)
                elif zeros == 0:
                    if new:
                        z[k] = new
                    k += 1
                    break
                else:
                    zeros -= 1
                k += 1
    if run[0]:
        for i in range(k, last + 1):
            if z[i]:
                correct(i)
        run[0] -= 1


def _read_uniform(c: Component, t: int, data: bytes, first: int, last: int, high: int, low: int, huff: dict) -> bool:
    """Unpack a scan whose blocks all have the same bits: one symbol of one bit, or DC corrections. False if it isn't one."""
    if c.stride != c.wide or len(c.coef) != c.wide * c.high:
        return False
    n, width = len(c.coef), last - first + 1
    if first == 0 and high:
        c.coef[:, 0] |= np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(np.int32) << low
        return True
    table = huff.get((first > 0, t & 15 if first else t >> 4), {})
    if first == 0:
        if [k[0] for k in table] != [4] * len(table):
            return False
        code, at, dc, out = int.from_bytes(data + b"\0\0", "big"), 0, 0, []
        text = bin(code | 1 << (8 * len(data) + 16))[3:]
        sizes = {format(k[1], "04b"): s for k, s in table.items()}
        for _ in range(n):
            s = sizes[text[at : at + 4]]
            at += 4 + s
            if s:
                x = int(text[at - s : at], 2)
                dc += x if x >> (s - 1) else x - (1 << s) + 1
            out.append(dc)
        c.coef[:, 0] = np.array(out, np.int32) << low
        return True
    if list(table) != [(1, 0)]:
        return False
    symbol = table[1, 0]
    if high == 0 and symbol == 8:
        bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width * 9).reshape(n, width, 9)
        if bits[:, :, 0].any() or not bits[:, :, 1].all():  # another code, or a negative value
            return False
        c.coef[:, first : last + 1] = np.packbits(bits[:, :, 1:], axis=2)[:, :, 0].astype(np.int32) << low
        return True
    own = c.coef[:, first : last + 1]
    if high and symbol == 0 and (own > 0).all():
        bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * (width + 1)).reshape(n, width + 1)
        if bits[:, 0].any():
            return False
        own |= bits[:, 1:].astype(np.int32) << low
        return True
    return False


def payload_of(image: Image) -> bytes:
    """The payload that ``encode`` stored."""
    flat = np.concatenate([c.coef for c in image.components])
    return (flat - BASE).astype(np.uint8).tobytes()[: struct.unpack(">Q", image.comment)[0]]


def rgb(image: Image) -> np.ndarray:
    """The full-resolution tensor (height, width, 3) of bytes: inverse transform, chroma upsampling, colour conversion."""
    hm, vm = max(c.h for c in image.components), max(c.v for c in image.components)
    planes = []
    for c in image.components:
        blocks = np.zeros((len(c.coef), 64), np.float32)
        blocks[:, ZIGZAG] = c.coef * image.quant[c.quant]
        pixels = DCT.T @ blocks.reshape(-1, 8, 8) @ DCT + 128
        plane = pixels.reshape(-1, c.stride, 8, 8).swapaxes(1, 2).reshape(-1, c.stride * 8)
        planes.append(plane.repeat(vm // c.v, axis=0).repeat(hm // c.h, axis=1)[: image.height, : image.width])
    if len(planes) < 3:
        planes = [planes[0]] * 3
        return np.clip(np.rint(np.stack(planes, axis=-1)), 0, 255).astype(np.uint8)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    return np.clip(np.rint(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=-1)), 0, 255).astype(np.uint8)


def padded(raw: bytes) -> bytes:
    """Bytes 0 up to a positive multiple of 64."""
    return raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))


def feature(tensor: np.ndarray) -> str:
    """Size, then mean and deviation of each channel in thousandths: equal tensors, equal strings."""
    x = tensor.reshape(-1, 3)
    n = len(x)
    total, square = x.sum(axis=0, dtype=np.int64), (x.astype(np.int64) ** 2).sum(axis=0)
    mean = [int(1000 * t // n) for t in total]
    dev = [int(1000 * max(0.0, (int(s) * n - int(t) ** 2) / n**2) ** 0.5) for s, t in zip(square, total)]
    return f"{tensor.shape[1]}x{tensor.shape[0]}:" + ",".join(map(str, mean + dev))


def encode_media(docs: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """The rows with ``media_col`` added: each whole text (null: empty) as UTF-8, padded, as a progressive JPEG."""
    own = [c for c in docs.columns if c != media_col]
    df = docs.select(*own, text_of(F.col(text_col)).cast("binary").alias("__md_raw"))
    schema = docs.select(*own, F.lit(b"").alias(media_col)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                p = b.slice(at, 512)
                media = [encode(padded(x.as_py())) for x in p.column(p.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*(p.column(i) for i in range(p.num_columns - 1)), pa.array(media, pa.binary())], names=schema.names)

    return df.mapInArrow(run, schema)


def decode_media(df: DataFrame, media_col: str = "media", tensors: bool = True) -> DataFrame:
    """The rows with what the stored bytes hold: payload size, digest and last block's crc32, size and digest of the
    file, a feature string, and with ``tensors`` the RGB tensor's ``height``, ``width`` and ``rgb`` bytes, instead of the file.

    A null file gives nulls; bytes that aren't such a file raise an error. Columns of those names are replaced.
    """
    made = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", height int, width int, rgb binary" * tensors
    names = [x.split()[0] for x in made.split(", ")]
    own = [c for c in df.columns if c not in names and c != media_col]
    schema = df.select(*own, *[F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in made.split(", ")]).schema

    def read(raw: bytes | None) -> list:
        if raw is None:
            return [None] * len(names)
        image = decode(raw)
        payload, tensor = payload_of(image), rgb(image)
        out = [len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(tensor)]
        return [*out, tensor.shape[0], tensor.shape[1], tensor.tobytes()] if tensors else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary()]
        for b in batches:
            for at in range(0, b.num_rows, 256):
                p = b.slice(at, 256)
                rows = [read(x.as_py()) for x in p.column(p.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*(p.column(i) for i in range(p.num_columns - 1)), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=schema.names)

    return df.select(*own, media_col).mapInArrow(run, schema)
