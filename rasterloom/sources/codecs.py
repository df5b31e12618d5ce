"""Encoders and decoders of raster files, in Python and numpy: GeoTIFF (strips and tiles; raw, deflate, LZW, PackBits), PNG, NPY, JP2 headers."""

from __future__ import annotations

import io
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

# TIFF tags and sample formats.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS_PER_STRIP, COUNTS, PLANAR, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 339
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
PIXEL_SCALE, TIEPOINT, GEO_KEYS, NODATA = 33550, 33922, 34735, 42113
# Geo keys of the model, and of the reference system, projected or geographic.
MODEL_TYPE, PROJECTED, GEOGRAPHIC = 1024, 3072, 2048
TYPE_SIZES = {1: ("B", 1), 2: ("c", 1), 3: ("H", 2), 4: ("I", 4), 11: ("f", 4), 12: ("d", 8)}
KINDS = {1: "u", 2: "i", 3: "f"}


@dataclass
class Raster:
    bands: np.ndarray  # band, row, column
    transform: tuple[float, float, float, float, float, float] = (0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
    nodata: float | None = None
    meta: dict = field(default_factory=dict)


def decode_tiff(data: bytes) -> Raster:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack_from(order + "I", data, 4)[0]
    tags = {}
    for i in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if kind not in TYPE_SIZES:
            continue
        code, size = TYPE_SIZES[kind]
        place = at + 2 + 12 * i + 8
        if n * size > 4:
            place = struct.unpack_from(order + "I", data, place)[0]
        raw = data[place : place + n * size]
        tags[tag] = raw.rstrip(b"\0").decode("ascii") if kind == 2 else struct.unpack(order + code * n, raw)
    width, height, bits = tags[WIDTH][0], tags[HEIGHT][0], tags.get(BITS, (8,))[0]
    samples, packed, planar = tags.get(SAMPLES, (1,))[0], tags.get(COMPRESSION, (1,))[0], tags.get(PLANAR, (1,))[0]
    dtype = np.dtype(f"{order}{KINDS[tags.get(FORMAT, (1,))[0]]}{bits // 8}")
    tiled = TILE_OFFSETS in tags
    high, wide = (tags[TILE_HEIGHT][0], tags[TILE_WIDTH][0]) if tiled else (min(height, tags.get(ROWS_PER_STRIP, (height,))[0]), width)
    offsets, counts = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if tiled else (tags[OFFSETS], tags[COUNTS])
    depth = 1 if planar == 2 else samples
    across, down = -(-width // wide), -(-height // high)
    bands = np.zeros((samples, height, width), dtype.newbyteorder("="))
    for k, (offset, count) in enumerate(zip(offsets, counts)):
        plane, place = divmod(k, across * down)
        top, left = place // across * high, place % across * wide
        rows = high if tiled else min(high, height - top)
        chunk = np.frombuffer(unpacked(data[offset : offset + count], packed), dtype, rows * wide * depth).astype(bands.dtype).reshape(rows, wide, depth)
        chunk = undone(chunk, tags.get(PREDICTOR, (1,))[0])
        part = chunk[: height - top, : width - left].transpose(2, 0, 1)
        bands[plane if planar == 2 else slice(None), top : top + part.shape[1], left : left + part.shape[2]] = part[0] if planar == 2 else part
    transform = (0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
    if PIXEL_SCALE in tags and TIEPOINT in tags:
        sx, sy = tags[PIXEL_SCALE][:2]
        i, j, _, x, y, _ = tags[TIEPOINT][:6]
        transform = (x - i * sx, sx, 0.0, y + j * sy, 0.0, -sy)
    nodata = tags.get(NODATA)
    return Raster(bands, transform, float(nodata) if nodata else None, {"width": width, "height": height, "count": samples, "dtype": str(bands.dtype), "epsg": epsg(tags.get(GEO_KEYS, ()))})


def epsg(keys: tuple) -> int | None:
    """Code of the reference system among the geo keys of a file."""
    found = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    code = found.get(PROJECTED if found.get(MODEL_TYPE) == 1 else GEOGRAPHIC)
    return code if code and code != 32767 else None


def unpacked(chunk: bytes, packed: int) -> bytes:
    if packed == 1:
        return chunk
    if packed in (8, 32946):
        return zlib.decompress(chunk)
    if packed == 5:
        return unpack_lzw(chunk)
    if packed == 32773:
        return unpack_runs(chunk)
    raise ValueError(f"TIFF compression {packed} isn't supported")


def undone(chunk: np.ndarray, predictor: int) -> np.ndarray:
    """Rows whose values are kept as differences from their left neighbours, as values again."""
    if predictor == 1:
        return chunk
    if predictor != 2 or chunk.dtype.kind == "f":
        raise ValueError(f"TIFF predictor {predictor} isn't supported for {chunk.dtype}")
    return np.cumsum(chunk, axis=1, dtype=chunk.dtype)


def unpack_runs(chunk: bytes) -> bytes:
    """PackBits: a count and so many bytes as they are, or a negative one and a byte that is repeated."""
    out, at = bytearray(), 0
    while at < len(chunk):
        n = chunk[at]
        if n < 128:
            out += chunk[at + 1 : at + 2 + n]
            at += 2 + n
        elif n > 128:
            out += chunk[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def unpack_lzw(chunk: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant first; 256 starts a new table, 257 ends, and codes widen one entry early."""
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, held, bits, before, out = first[:], 9, 0, 0, b"", []
    for byte in chunk:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, before = first[:], 9, b""
            continue
        entry = table[code] if code < len(table) else before + before[:1]
        out.append(entry)
        if before:
            table.append(before + entry[:1])
        before = entry
        width = min(12, (len(table) + 1).bit_length())
    return b"".join(out)


def encode_tiff(raster: Raster, compress: bool = True) -> bytes:
    bands = np.ascontiguousarray(raster.bands)
    if bands.ndim != 3:
        raise ValueError("bands must have three axes: band, row, column")
    bands = bands.astype(bands.dtype.newbyteorder("<"))
    n, height, width = bands.shape
    kind = {"u": 1, "i": 2, "f": 3}[bands.dtype.kind]
    body = [zlib.compress(b.tobytes(), 6) if compress else b.tobytes() for b in bands]
    x0, xres, _, y0, _, yres = raster.transform
    entries = [
        (WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [bands.dtype.itemsize * 8] * n), (COMPRESSION, 3, [8 if compress else 1]), (PHOTOMETRIC, 3, [1]),
        (OFFSETS, 4, [0] * n), (SAMPLES, 3, [n]), (ROWS_PER_STRIP, 4, [height]), (COUNTS, 4, [len(b) for b in body]), (PLANAR, 3, [2]), (FORMAT, 3, [kind] * n),
        (PIXEL_SCALE, 12, [xres, -yres, 0.0]), (TIEPOINT, 12, [0.0, 0.0, 0.0, x0, y0, 0.0]),
    ]
    if code := raster.meta.get("epsg"):
        projected = not 4000 <= code < 5000
        entries.append((GEO_KEYS, 3, [1, 1, 0, 2, MODEL_TYPE, 0, 1, 1 if projected else 2, PROJECTED if projected else GEOGRAPHIC, 0, 1, code]))
    if raster.nodata is not None:
        entries.append((NODATA, 2, list(f"{raster.nodata:g}\0".encode())))
    head = 8 + 2 + 12 * len(entries) + 4
    sizes = {2: "B", 3: "H", 4: "I", 12: "d"}
    large = [struct.pack("<" + sizes[k] * len(v), *v) for _, k, v in entries]
    place, places = head, []
    for raw in large:
        places.append(place if len(raw) > 4 else None)
        place += len(raw) + len(raw) % 2 if len(raw) > 4 else 0
    starts = [place + sum(map(len, body[:i])) for i in range(n)]
    out = io.BytesIO()
    out.write(b"II*\0" + struct.pack("<IH", 8, len(entries)))
    tail = b""
    for (tag, k, v), raw, where in zip(entries, large, places):
        if tag == OFFSETS:
            raw = struct.pack("<" + "I" * n, *starts)
        out.write(struct.pack("<HHI", tag, k, len(v)))
        if where is None:
            out.write(raw.ljust(4, b"\0"))
        else:
            out.write(struct.pack("<I", where))
            tail += raw + b"\0" * (len(raw) % 2)
    out.write(b"\0\0\0\0" + tail + b"".join(body))
    return out.getvalue()


def encode_png(bands: np.ndarray) -> bytes:
    """PNG of 1 to 4 bands of bytes."""
    if bands.dtype != np.uint8 or bands.ndim != 3 or not 1 <= len(bands) <= 4:
        raise ValueError("a PNG takes one to four bands of bytes")
    n, height, width = bands.shape
    rows = np.zeros((height, 1 + width * n), np.uint8)
    rows[:, 1:] = bands.transpose(1, 2, 0).reshape(height, -1)
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[n]
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """Bands of a PNG of bytes (not interlaced, no palette)."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, packed, head = 8, b"", b""
    while at < len(data):
        n, name = struct.unpack_from(">I4s", data, at)
        if name == b"IHDR":
            head = data[at + 8 : at + 8 + n]
        elif name == b"IDAT":
            packed += data[at + 8 : at + 8 + n]
        at += 12 + n
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", head)
    if depth != 8 or interlaced or colour not in (0, 2, 4, 6):
        raise ValueError("only plain PNGs of bytes are supported")
    n = {0: 1, 4: 2, 2: 3, 6: 4}[colour]
    raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * n)
    out = np.zeros((height, width * n), np.uint8)
    before = np.zeros(width * n, np.int64)
    for y in range(height):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        if kind == 2:
            line = (line + before) & 255
        elif kind in (1, 3, 4):
            for x in range(width * n):
                a, b, c = (line[x - n] if x >= n else 0), before[x], (before[x - n] if x >= n else 0)
                if kind == 1:
                    guess = a
                elif kind == 3:
                    guess = (a + b) // 2
                else:
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                line[x] = (line[x] + guess) & 255
        out[y] = line
        before = line
    return out.reshape(height, width, n).transpose(2, 0, 1)


def jp2_bit_depth(data: bytes) -> int:
    """Bits of a sample by the image header box of a JP2 file."""
    place = data.find(b"ihdr")
    if place < 0:
        raise ValueError("no image header box")
    return (data[place + 4 + 10] & 0x7F) + 1


def decode_npy(data: bytes) -> np.ndarray:
    return np.load(io.BytesIO(data), allow_pickle=False)


def encode_npy(a: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, a, allow_pickle=False)
    return out.getvalue()
