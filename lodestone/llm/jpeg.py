"""Media columns of baseline JPEG files: dimensions, DC-only thumbnails and their hashes.

The markers of a file are parsed, its scan is Huffman-decoded (AC symbols only
as far as needed to skip them), and the DC terms of luminance, one per 8 x 8
block, are dequantised in numpy to a picture of an eighth of the size: each
pixel is the mean of its block. A small encoder of the same format builds media
columns where a table has none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "media_id long, width int, height int, components int, thumb_width int, thumb_height int, thumb_hash string, thumb_sha256 string, error string"


class Broken(ValueError):
    """The file can't be decoded; the message says why."""


class _Codes:
    """A Huffman table: look[next 16 bits] = length << 8 | symbol, 0 where no code fits."""

    def __init__(self, counts: bytes, symbols: bytes):
        look = np.zeros(1 << 16, np.int32)
        code, at, self.codes = 0, 0, {}
        for bits, many in enumerate(counts, 1):
            for symbol in symbols[at : at + many]:
                lo = code << (16 - bits)
                if lo >= 1 << 16:
                    raise Broken("overfull Huffman table")
                look[lo : lo + (1 << (16 - bits))] = bits << 8 | symbol
                self.codes[symbol] = (code, bits)
                code += 1
            at += many
            code <<= 1
        self.look = look.tolist()


def _be(data: bytes, at: int) -> int:
    if at + 2 > len(data):
        raise Broken("file ends inside a segment")
    return data[at] << 8 | data[at + 1]


_TABLES: dict[bytes, _Codes] = {}


def _codes(body: bytes) -> _Codes:
    if body not in _TABLES:
        if len(_TABLES) > 256:
            _TABLES.clear()
        _TABLES[body] = _Codes(body[:16], body[16:])
    return _TABLES[body]


def parse(data: bytes) -> tuple[dict, dict, dict, list, int, int]:
    """(frame, quantisation tables, Huffman tables, scan components, restart interval, start of the entropy-coded data)."""
    if data[:2] != b"\xff\xd8":
        raise Broken("no start of image")
    at, frame, quant, huff, restart = 2, None, {}, {}, 0
    while True:
        if at >= len(data):
            raise Broken("no scan")
        if data[at] != 0xFF:
            raise Broken("no marker where one is due")
        while at < len(data) and data[at] == 0xFF:
            at += 1
        if at >= len(data):
            raise Broken("no scan")
        marker = data[at]
        at += 1
        if marker == 0xD9:
            raise Broken("no scan")
        if marker == 0x01 or 0xD0 <= marker <= 0xD7:
            continue
        size = _be(data, at)
        body = data[at + 2 : at + size]
        if size < 2 or at + size > len(data):
            raise Broken("file ends inside a segment")
        at += size
        if marker in (0xC0, 0xC1):
            if len(body) < 6 or len(body) < 6 + 3 * body[5]:
                raise Broken("short frame header")
            if body[0] != 8:
                raise Broken("not 8 bits a sample")
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            frame = {"height": _be(body, 1), "width": _be(body, 3), "parts": parts}
            if not frame["height"] or not frame["width"] or not parts or any(not 1 <= x <= 4 or not 1 <= y <= 4 for _, x, y, _ in parts):
                raise Broken("bad frame header")
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise Broken("not baseline")
        elif marker == 0xC4:
            while body:
                many = sum(body[1:17])
                if len(body) < 17 + many:
                    raise Broken("short Huffman table")
                huff[body[0]] = _codes(body[1 : 17 + many])
                body = body[17 + many :]
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                need = 1 + 64 * (1 + wide)
                if len(body) < need:
                    raise Broken("short quantisation table")
                quant[body[0] & 15] = _be(body, 1) if wide else body[1]
                body = body[need:]
        elif marker == 0xDD:
            restart = _be(body, 0)
        elif marker == 0xDA:
            if frame is None:
                raise Broken("scan before frame")
            if not body or len(body) < 1 + 2 * body[0]:
                raise Broken("short scan header")
            return frame, quant, huff, [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])], restart, at


def luminance_dc(data: bytes) -> tuple[int, int, int, np.ndarray]:
    """(width, height, components, thumbnail of dtype uint8); raises Broken."""
    frame, quant, huff, scan, restart, at = parse(data)
    parts = {p[0]: p for p in frame["parts"]}
    if any(c not in parts for c, _, _ in scan):
        raise Broken("scan of an unknown component")
    first = frame["parts"][0]
    if first[0] not in [c for c, _, _ in scan]:
        raise Broken("first scan has no luminance")
    if first[3] not in quant:
        raise Broken("no quantisation table")
    hmax, vmax = max(p[1] for p in frame["parts"]), max(p[2] for p in frame["parts"])
    single = len(scan) == 1
    wide, high = -(-frame["width"] * first[1] // (8 * hmax)), -(-frame["height"] * first[2] // (8 * vmax))
    if single:
        p = parts[scan[0][0]]
        columns, rows = -(-frame["width"] * p[1] // (8 * hmax)), -(-frame["height"] * p[2] // (8 * vmax))
        plan = [(0, scan[0], 1)]
    else:
        columns, rows = -(-frame["width"] // (8 * hmax)), -(-frame["height"] // (8 * vmax))
        plan = [(i, s, parts[s[0]][1] * parts[s[0]][2]) for i, s in enumerate(scan)]
    try:
        plan = [(i, huff[s[1]].look, huff[16 + s[2]].look, blocks, s[0] == first[0]) for i, s, blocks in plan]
    except KeyError:
        raise Broken("no Huffman table") from None
    # entropy-coded data without stuffing, cut at restart markers
    end, segments, start = at, [], at
    while True:
        end = data.find(b"\xff", end)
        if end < 0 or end + 1 >= len(data):
            segments.append(data[start:])
            break
        if data[end + 1] == 0:
            end += 2
        elif 0xD0 <= data[end + 1] <= 0xD7:
            segments.append(data[start:end])
            start = end = end + 2
        elif data[end + 1] == 0xFF:
            end += 1
        else:
            segments.append(data[start:end])
            break
    units, values, done = columns * rows, [], 0
    per = restart or units
    for segment in segments:
        if done >= units:
            break
        raw = segment.replace(b"\xff\x00", b"\xff")
        limit = 8 * len(raw)
        raw += b"\xff" * 8
        bit, last = 0, [0] * len(plan)
        for _ in range(min(per, units - done)):
            for i, dc, ac, blocks, wanted in plan:
                for _ in range(blocks):
                    byte = bit >> 3
                    found = dc[(int.from_bytes(raw[byte : byte + 3], "big") >> (8 - (bit & 7))) & 0xFFFF]
                    if not found:
                        raise Broken("bad Huffman code")
                    bit += found >> 8
                    size = found & 255
                    if size:
                        if size > 11:
                            raise Broken("bad DC size")
                        byte = bit >> 3
                        more = (int.from_bytes(raw[byte : byte + 3], "big") >> (24 - (bit & 7) - size)) & ((1 << size) - 1)
                        bit += size
                        last[i] += more if more >> (size - 1) else more - (1 << size) + 1
                    if wanted:
                        values.append(last[i])
                    k = 1
                    while k < 64:
                        byte = bit >> 3
                        found = ac[(int.from_bytes(raw[byte : byte + 3], "big") >> (8 - (bit & 7))) & 0xFFFF]
                        if not found:
                            raise Broken("bad Huffman code")
                        bit += found >> 8
                        symbol = found & 255
                        if symbol & 15:
                            bit += symbol & 15
                            k += (symbol >> 4) + 1
                        elif symbol == 0xF0:
                            k += 16
                        else:
                            break
                    if bit > limit:
                        raise Broken("scan ends early")
            done += 1
    if done < units:
        raise Broken("scan ends early")
    dc = np.array(values, np.int64)
    if single:
        grid = dc.reshape(rows, columns)
    else:
        grid = dc.reshape(rows, columns, first[2], first[1]).transpose(0, 2, 1, 3).reshape(rows * first[2], columns * first[1])
    pixels = np.clip(np.rint(grid[:high, :wide] * quant[first[3]] / 8 + 128), 0, 255).astype(np.uint8)
    return frame["width"], frame["height"], len(frame["parts"]), pixels


def resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area means over a grid of height x width (nearest pixels where the picture is smaller)."""
    total = np.zeros((pixels.shape[0] + 1, pixels.shape[1] + 1))
    total[1:, 1:] = pixels.astype(float).cumsum(0).cumsum(1)
    y, x = np.arange(height + 1) * pixels.shape[0] // height, np.arange(width + 1) * pixels.shape[1] // width
    y0, x0 = np.minimum(y[:-1], pixels.shape[0] - 1), np.minimum(x[:-1], pixels.shape[1] - 1)
    y1, x1 = np.maximum(y[1:], y0 + 1), np.maximum(x[1:], x0 + 1)
    area = (y1 - y0)[:, None] * (x1 - x0)[None, :]
    return (total[np.ix_(y1, x1)] - total[np.ix_(y0, x1)] - total[np.ix_(y1, x0)] + total[np.ix_(y0, x0)]) / area


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits as hex: whether each cell of an 8 x 9 reduction is darker than its right neighbour."""
    small = resize(pixels, 8, 9)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def describe(data: bytes | None) -> tuple:
    """The columns of SCHEMA after media_id."""
    if data is None:
        return (None,) * 7 + (None,)
    try:
        width, height, parts, thumb = luminance_dc(bytes(data))
    except Broken as e:
        return (None,) * 7 + (str(e),)
    return width, height, parts, thumb.shape[1], thumb.shape[0], difference_hash(thumb), hashlib.sha256(thumb.tobytes()).hexdigest(), None


def media_columns(media: DataFrame) -> DataFrame:
    """SCHEMA of media(media_id, content binary, ...).

    A file that is no baseline JPEG, is cut off or is empty has null columns and
    an `error`; null content has null columns and no error. Null ids stay null,
    repeated rows are described each, an empty table gives an empty result, and
    other columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in SCHEMA.split(", ")][1:]
        for rows in batches:
            found = pd.DataFrame([describe(c) for c in rows["content"]], columns=names)
            for c in names[:5]:
                found[c] = found[c].astype("Int32")
            found.insert(0, "media_id", rows["media_id"].astype("Int64").to_numpy())
            yield found.astype({"media_id": "Int64"})

    return media.select(F.col("media_id").cast("long").alias("media_id"), "content").mapInPandas(run, SCHEMA)


# The typical Huffman tables of the public standard's annex K, as counts by length and symbols.
DC_COUNTS, DC_SYMBOLS = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12))
AC_COUNTS = bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125])
AC_SYMBOLS = bytes.fromhex(
    "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a535455565758595a"
    "636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa".replace(" ", "")
)
_DCT = np.array([[np.sqrt((1 if u else 0.5) / 4) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
_ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


def encode(pixels: np.ndarray, step: int = 8, restart: int = 0) -> bytes:
    """A grey baseline JPEG of pixels (uint8), all quantised by `step`; sides are padded to blocks by repetition."""
    height, width = pixels.shape
    full = np.pad(pixels, ((0, -height % 8), (0, -width % 8)), mode="edge").astype(float) - 128
    blocks = full.reshape(full.shape[0] // 8, 8, full.shape[1] // 8, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)
    terms = np.rint(_DCT @ blocks @ _DCT.T / step).astype(int).reshape(-1, 64)[:, _ZIGZAG].tolist()
    dc, ac = _codes(DC_COUNTS + DC_SYMBOLS).codes, _codes(AC_COUNTS + AC_SYMBOLS).codes
    out, bits, last = [], [], 0

    def flush():
        text = "".join(bits)
        text += "1" * (-len(text) % 8)
        out.append(int(text or "0", 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\x00") if text else b"")
        bits.clear()

    def put(code):
        bits.append(format(code[0], f"0{code[1]}b"))

    def number(value, size):
        if size:
            bits.append(format(value if value > 0 else value + (1 << size) - 1, f"0{size}b"))

    for n, block in enumerate(terms):
        if restart and n and n % restart == 0:
            flush()
            out.append(bytes([0xFF, 0xD0 + (n // restart - 1) % 8]))
            last = 0
        size = abs(block[0] - last).bit_length()
        put(dc[size])
        number(block[0] - last, size)
        last, zeros = block[0], 0
        for value in block[1:]:
            if not value:
                zeros += 1
                continue
            while zeros > 15:
                put(ac[0xF0])
                zeros -= 16
            put(ac[zeros << 4 | abs(value).bit_length()])
            number(value, abs(value).bit_length())
            zeros = 0
        if zeros:
            put(ac[0])
    flush()
    two = lambda x: x.to_bytes(2, "big")
    head = b"\xff\xd8\xff\xdb" + two(67) + b"\0" + bytes([step]) * 64 + b"\xff\xc0" + two(11) + b"\x08" + two(height) + two(width) + b"\x01\x01\x11\x00"
    head += b"\xff\xc4" + two(19 + len(DC_SYMBOLS)) + b"\x00" + DC_COUNTS + DC_SYMBOLS + b"\xff\xc4" + two(19 + len(AC_SYMBOLS)) + b"\x10" + AC_COUNTS + AC_SYMBOLS
    if restart:
        head += b"\xff\xdd" + two(4) + two(restart)
    return head + b"\xff\xda" + two(8) + b"\x01\x01\x00\x00\x3f\x00" + b"".join(out) + b"\xff\xd9"


def picture_of(vector, cell: int = 8) -> np.ndarray:
    """A grey picture of a vector: one cell x cell square a number, with a slope inside, in rows of 8."""
    v = np.nan_to_num(np.asarray(vector, float))
    rows = max(1, -(-len(v) // 8))
    grid = np.zeros(rows * 8)
    grid[: len(v)] = v
    level = 128 + 100 * np.clip(grid / (np.abs(grid).max() or 1), -1, 1).reshape(rows, 8)
    slope = np.add.outer(np.arange(cell), np.arange(cell)) - (cell - 1)
    return np.clip(np.rint(np.kron(level, np.ones((cell, cell))) + np.tile(slope, (rows, 8))), 0, 255).astype(np.uint8)


def media_of_vectors(vectors: DataFrame) -> DataFrame:
    """media_id, content: a JPEG picture of each row of vectors(vec_id, embedding, ...); a null or empty embedding has null content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"media_id": rows["vec_id"].astype("Int64"), "content": [None if v is None or not len(v) else encode(picture_of(v)) for v in rows["embedding"]]})

    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).mapInPandas(run, "media_id long, content binary")
