"""TIFF rasters: georeferenced cells and images."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maploom.functions.text import no_data
from maploom.sources.files import binary, parsed

_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_CODE = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d"}
#: Codecs by number.
CODECS = {1: "none", 5: "LZW", 8: "Deflate", 32946: "Deflate", 32773: "PackBits"}


def directory(data: bytes) -> tuple[str, dict[int, list]]:
    """(byte order, tags) of the first image; unknown value types are passed over."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None:
        raise ValueError("not a TIFF: no byte-order mark")
    magic = struct.unpack_from(order + "H", data, 2)[0]
    if magic == 43:
        raise ValueError("BigTIFF is not supported; export as a classic TIFF")
    if magic != 42:
        raise ValueError("not a TIFF: bad version")
    at = struct.unpack_from(order + "I", data, 4)[0]
    tags: dict[int, list] = {}
    for i in range(struct.unpack_from(order + "H", data, at)[0]):
        e = at + 2 + 12 * i
        tag, kind, count = struct.unpack_from(order + "HHI", data, e)
        if kind not in _SIZE:
            continue
        size = _SIZE[kind]
        p = e + 8 if size * count <= 4 else struct.unpack_from(order + "I", data, e + 8)[0]
        count = max(0, min(count, (len(data) - p) // size))
        if kind in (5, 10):
            v = struct.unpack_from(f"{order}{2 * count}{'I' if kind == 5 else 'i'}", data, p)
            tags[tag] = [a / b if b else 0.0 for a, b in zip(v[::2], v[1::2], strict=True)]
        else:
            tags[tag] = list(struct.unpack_from(f"{order}{count}{_CODE[kind]}", data, p))
    return order, tags


def place(tags: dict[int, list], width: int, height: int) -> tuple[float, float, float, bool]:
    """(cell, west, north, georeferenced); cells that aren't square and rotated rasters are refused."""
    scale, tie, matrix = tags.get(33550, []), tags.get(33922, []), tags.get(34264, [])
    if len(scale) >= 2 and len(tie) >= 6:
        sx, sy = abs(scale[0]), abs(scale[1])
        if sx > 0 and sy > 0 and abs(sx - sy) / max(sx, sy) > 1e-6:
            raise ValueError(f"pixels of {sx} x {sy} are not square; resample first")
        return sx, tie[3], tie[4], True
    if len(matrix) >= 16:
        if abs(matrix[1]) > 1e-9 or abs(matrix[4]) > 1e-9:
            raise ValueError("a rotated raster; only north-up ones can be read")
        return abs(matrix[0]), matrix[3], matrix[7], True
    return 1.0, 0.0, float(height), False


def epsg(tags: dict[int, list]) -> str | None:
    """The projected code if there is one, else the geographic one."""
    keys = tags.get(34735, [])
    found = {}
    for i in range(keys[3] if len(keys) >= 4 else 0):
        key, where, _, value = keys[4 + 4 * i : 8 + 4 * i]
        if where == 0 and value not in (0, 32767):
            found[key] = value
    code = found.get(3072, found.get(2048))
    return f"EPSG:{code}" if code else None


def lzw(data: bytes, expected: int) -> bytes:
    """LZW as TIFF has it: codes from the high bit down, and one code early in growing."""
    table: list[bytes] = []
    out, last = bytearray(), None
    bits, held, width, at = 0, 0, 9, 0
    while len(out) < expected:
        while held < width:
            if at >= len(data):
                return bytes(out)
            bits, held, at = bits << 8 | data[at], held + 8, at + 1
        held -= width
        code = bits >> held & ((1 << width) - 1)
        bits &= (1 << held) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
            continue
        if not table:
            raise ValueError("LZW data doesn't begin with a clear code")
        if code < len(table):
            piece = table[code]
        elif code == len(table) and last is not None:
            piece = last + last[:1]
        else:
            raise ValueError("a code beyond the LZW table")
        out += piece
        if last is not None:
            table.append(last + piece[:1])
        last = piece
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out[:expected])


def packbits(data: bytes, expected: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < expected:
        n = data[at] - 256 if data[at] > 127 else data[at]
        at += 1
        if n >= 0:
            out += data[at : at + n + 1]
            at += n + 1
        elif n != -128:
            out += data[at : at + 1] * (1 - n)
            at += 1
    return bytes(out[:expected])


def inflate(data: bytes, expected: int | None = None) -> bytes:
    """Deflate with or without a zlib header, as far as expected."""
    wrapped = len(data) > 1 and data[0] & 15 == 8 and (data[0] << 8 | data[1]) % 31 == 0
    tool = zlib.decompressobj(15 if wrapped else -15)
    try:
        return tool.decompress(data, expected or 0)
    except zlib.error as e:
        raise ValueError(f"bad Deflate data: {e}") from e


def unpacked(codec: int, data: bytes, expected: int) -> bytes:
    if codec == 1:
        return data[:expected]
    if codec in (8, 32946):
        return inflate(data, expected)
    if codec == 5:
        return lzw(data, expected)
    if codec == 32773:
        return packbits(data, expected)
    raise ValueError(f"compression {codec} is not supported; there are {', '.join(sorted(set(CODECS.values())))}")


def unpredicted(block: np.ndarray) -> np.ndarray:
    """Predictor 2: differences along rows, by sample, modulo the sample's width; block is rows x columns x samples."""
    unsigned = block.view(f"{block.dtype.byteorder.replace('|', '=')}u{block.dtype.itemsize}") if block.dtype.itemsize > 1 else block.view("u1")
    native = unsigned.astype(f"u{unsigned.dtype.itemsize}")
    return np.cumsum(native, axis=1, dtype=native.dtype).astype(unsigned.dtype).view(block.dtype)


def unpredicted_float(raw: bytes, rows: int, columns: int, samples: int, size: int) -> np.ndarray:
    """Predictor 3: bytes summed along each row, which holds the values' bytes plane by plane, highest first."""
    planes = np.cumsum(np.frombuffer(raw, np.uint8).reshape(rows, -1), axis=1, dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(rows, size, columns * samples).transpose(0, 2, 1)).view(f">f{size}").reshape(rows, columns, samples)


@dataclass
class Image:
    width: int
    height: int
    samples: int
    data: np.ndarray
    cell: float
    origin_x: float
    origin_y: float
    georeferenced: bool
    crs: str | None
    nodata: float | None
    notes: list[str] = field(default_factory=list)


def read_image(data: bytes) -> Image:
    """All samples, rows x columns x samples, as doubles; what a file lacks is NaN."""
    order, tags = directory(data)
    one = lambda tag, default: tags.get(tag, [default])[0]
    width, height, spp = one(256, 0), one(257, 0), one(277, 1)
    if not width or not height:
        raise ValueError("the TIFF has no size")
    bits, kinds = tags.get(258, [8]), tags.get(339, [1])
    if len(set(bits)) > 1:
        raise ValueError("mixed sample widths are not supported")
    kind = {3: "f", 2: "i"}.get(kinds[0], "u")
    if bits[0] not in {"f": (32, 64), "i": (8, 16, 32), "u": (8, 16, 32)}[kind]:
        raise ValueError(f"unsupported sample: {bits[0]}-bit format {kinds[0]}")
    if one(284, 1) != 1 and spp > 1:
        raise ValueError("band-separate TIFFs are not supported; export with interleaved pixels")
    predictor, codec = one(317, 1), one(259, 1)
    if predictor not in (1, 2, 3) or predictor == 3 and kind != "f":
        raise ValueError(f"predictor {predictor} doesn't fit sample format {kinds[0]}")
    size = bits[0] // 8
    dtype = np.dtype(f"{order}{kind}{size}")
    tiled = 322 in tags and 323 in tags
    bw, bh = (tags[322][0], tags[323][0]) if tiled else (width, min(one(278, height), height))
    offsets, counts = (tags.get(324, []), tags.get(325, [])) if tiled else (tags.get(273, []), tags.get(279, []))
    out = np.full((height, width, spp), np.nan)
    across = -(-width // bw)
    for k, offset in enumerate(offsets):
        y, x = k // across * bh, k % across * bw
        if y >= height:
            break
        rows = bh if tiled else min(bh, height - y)
        expected = rows * bw * spp * size
        raw = unpacked(codec, data[offset : offset + (counts[k] if k < len(counts) else expected)], expected)
        if predictor == 3:
            block = unpredicted_float(raw.ljust(expected, b"\0"), rows, bw, spp, size)
        else:
            whole = len(raw) // (bw * spp * size) * bw * spp * size
            part = np.frombuffer(raw[:whole], dtype).reshape(-1, bw, spp)
            block = unpredicted(part) if predictor == 2 else part
        block = block[: height - y, : width - x]
        out[y : y + block.shape[0], x : x + block.shape[1]] = block
    text = bytes(int(c) & 255 for c in tags.get(42113, [])).split(b"\0")[0].decode("latin-1").strip()
    try:
        nodata = float(text) if text else None
    except ValueError:
        nodata = None
    return Image(width, height, spp, out, *place(tags, width, height), epsg(tags), nodata if nodata is None or np.isfinite(nodata) else None)


META = "nrows int, ncols int, samples int, cell double, origin_x double, origin_y double, georeferenced boolean, crs string, nodata double"


def raster_meta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path and one row of meta data a file."""
    def parse(data: bytes, name: str):
        m = read_image(data)
        yield m.height, m.width, m.samples, m.cell, m.origin_x, m.origin_y, m.georeferenced, m.crs, m.nodata

    return parsed(binary(spark, path), parse, META)


def read_samples(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, band, r, c, v and the declared nodata of every sample."""
    def parse(data: bytes, name: str):
        m = read_image(data)
        for r in range(m.height):
            for band in range(m.samples):
                for c, v in enumerate(m.data[r, :, band]):
                    yield band, r, c, None if np.isnan(v) else float(v), m.nodata

    return parsed(binary(spark, path), parse, "band int, r int, c int, v double, nodata double")


def read_elevation(spark: SparkSession, path: str | list[str], band: int = 0) -> DataFrame:
    """path, r, c, z of one band, null where the number stands for no measurement."""
    rows = read_samples(spark, path).where(F.col("band") == band)
    return rows.select("path", "r", "c", no_data(F.col("v"), F.col("nodata")).cast("float").alias("z"))


def read_ortho(spark: SparkSession, path: str) -> DataFrame:
    """y, x, red, green, blue of the first three bands, as they are; see symbols.rescaled_bands."""
    rows = read_samples(spark, path).where("band < 3").groupBy(F.col("r").alias("y"), F.col("c").alias("x"))
    return rows.agg(*[F.max(F.when(F.col("band") == i, F.col("v"))).alias(n) for i, n in enumerate(("red", "green", "blue"))])


def write_image(data: np.ndarray, codec: int = 1, predictor: int = 1, rows_per_strip: int | None = None, tile: int | None = None, cell: float = 1, origin_x: float = 0, origin_y: float | None = None, code: int | None = None, nodata: str | None = None) -> bytes:
    """A little-endian TIFF of rows x columns x samples, for exchange and for tests; codecs 1, 8 and 32773."""
    data = data if data.ndim == 3 else data[:, :, None]
    height, width, spp = data.shape
    kind = {"f": 3, "i": 2, "u": 1}[data.dtype.kind]
    data = data.astype(data.dtype.newbyteorder("<"))

    def packed(block: np.ndarray) -> bytes:
        if predictor == 2:
            u = block.view(f"<u{block.dtype.itemsize}")
            block = np.concatenate([u[:, :1], u[:, 1:] - u[:, :-1]], axis=1)
        raw = np.ascontiguousarray(block).tobytes()
        if predictor == 3:
            n = block.dtype.itemsize
            planes = np.ascontiguousarray(block.astype(f">f{n}")).view(np.uint8).reshape(block.shape[0], -1, n).transpose(0, 2, 1).reshape(block.shape[0], -1)
            raw = np.concatenate([planes[:, :1], planes[:, 1:] - planes[:, :-1]], axis=1).tobytes()
        if codec == 8:
            return zlib.compress(raw)
        if codec == 32773:
            return b"".join(bytes([len(raw[i : i + 128]) - 1]) + raw[i : i + 128] for i in range(0, len(raw), 128))
        return raw

    if tile:
        pad = np.pad(data, ((0, -height % tile), (0, -width % tile), (0, 0)))
        blocks = [packed(pad[y : y + tile, x : x + tile]) for y in range(0, height, tile) for x in range(0, width, tile)]
    else:
        step = rows_per_strip or height
        blocks = [packed(data[y : y + step]) for y in range(0, height, step)]
    tags: list[tuple[int, int, list]] = [(256, 4, [width]), (257, 4, [height]), (258, 3, [data.dtype.itemsize * 8] * spp), (259, 3, [codec]), (277, 3, [spp]), (317, 3, [predictor]), (339, 3, [kind] * spp)]
    tags += [(33550, 12, [cell, cell, 0.0]), (33922, 12, [0.0, 0.0, 0.0, origin_x, height * cell if origin_y is None else origin_y, 0.0])]
    if code:
        tags.append((34735, 3, [1, 1, 0, 1, 3072, 0, 1, code]))
    if nodata is not None:
        tags.append((42113, 2, list(nodata.encode() + b"\0")))
    tags += [(322, 3, [tile]), (323, 3, [tile]), (324, 4, [0] * len(blocks)), (325, 4, [len(b) for b in blocks])] if tile else [(278, 4, [rows_per_strip or height]), (273, 4, [0] * len(blocks)), (279, 4, [len(b) for b in blocks])]
    tags.sort()
    body = 8 + 2 + 12 * len(tags) + 4
    extra, entries = b"", b""
    spot = body
    lengths = {t: len(v) * _SIZE[k] for t, k, v in tags}
    start = body + sum(n + n % 2 for n in lengths.values() if n > 4)
    places, at = [], start
    for b in blocks:
        places.append(at)
        at += len(b)
    for tag, k, v in tags:
        v = places if tag in (273, 324) else v
        raw = struct.pack(f"<{len(v)}{_CODE[k]}", *v)
        if len(raw) <= 4:
            entries += struct.pack("<HHI", tag, k, len(v)) + raw.ljust(4, b"\0")
        else:
            entries += struct.pack("<HHII", tag, k, len(v), spot)
            raw += b"\0" * (len(raw) % 2)
            extra += raw
            spot += len(raw)
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(tags)) + entries + b"\0\0\0\0" + extra + b"".join(blocks)
