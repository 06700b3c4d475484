"""Image files as packed matrices: PNG, BMP and PNM here; JPEG and GIF by Spark's own image source."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.packed import _ARROW, SCHEMA, as_array, as_row
from gridloom.shipping import ship
from gridloom.sources import jpeg

UNCHANGED, GRAYSCALE, COLOR = -1, 0, 1
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _unfiltered(data: bytes, rows: int, stride: int, step: int) -> np.ndarray:
    """PNG scan lines without their filters."""
    out = np.zeros((rows, stride), dtype=np.uint8)
    before = np.zeros(stride, dtype=np.int64)
    for y in range(rows):
        kind, line = data[y * (stride + 1)], np.frombuffer(data, dtype=np.uint8, count=stride, offset=y * (stride + 1) + 1).astype(np.int64)
        if kind == 0:
            now = line
        elif kind == 2:
            now = (line + before) & 255
        elif kind == 1:
            now = line.copy()
            for s in range(step):
                now[s::step] = np.cumsum(line[s::step]) & 255
        else:
            now = line.copy()
            for i in range(stride):
                a, b = (int(now[i - step]) if i >= step else 0), int(before[i])
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    c = int(before[i - step]) if i >= step else 0
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                now[i] = (int(line[i]) + guess) & 255
        out[y], before = now, now
    return out


def decode_png(data: bytes) -> np.ndarray:
    """rows, cols, channels of 8 bits, in the file's order (gray, gray and alpha, RGB, RGBA)."""
    at, packed, palette, clear = 8, b"", None, b""
    width = height = depth = kind = lace = 0
    while at < len(data):
        (n,), name = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if name == b"IHDR":
            width, height, depth, kind, _, _, lace = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, dtype=np.uint8).reshape(-1, 3)
        elif name == b"tRNS":
            clear = body
        elif name == b"IDAT":
            packed += body
        at += 12 + n
    if lace:
        raise ValueError("interlaced")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    stride = (width * channels * depth + 7) // 8
    lines = _unfiltered(zlib.decompress(packed), height, stride, max(1, channels * depth // 8))
    if depth == 16:
        lines = lines[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(lines, axis=1).reshape(height, -1, depth)
        lines = (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint8)[:, : width * channels]
        if kind == 0:
            lines = (lines.astype(int) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    image = lines.reshape(height, width, channels)
    if kind == 3:
        colours = palette
        if clear:
            alpha = np.full((len(palette), 1), 255, dtype=np.uint8)
            alpha[: len(clear), 0] = np.frombuffer(clear, dtype=np.uint8)
            colours = np.hstack([palette, alpha])
        image = colours[image[:, :, 0]]
    return image


def encode_png(image: np.ndarray) -> bytes:
    """image: 1 to 4 channels, gray or RGB order."""
    h, w, n = image.shape
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    lines = np.hstack([np.zeros((h, 1), dtype=np.uint8), image.reshape(h, w * n)]).tobytes()
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[n], 0, 0, 0)
    return _SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed, 8 (palette), 24 or 32 bits; gray or RGB(A) order."""
    start, size, w, h, _, bits, kind = struct.unpack("<I", data[10:14]) + struct.unpack("<IiiHHI", data[14:34])
    if kind not in (0, 3):
        raise ValueError("compressed")
    n = bits // 8
    stride = (w * n + 3) // 4 * 4
    rows = np.frombuffer(data, dtype=np.uint8, count=stride * abs(h), offset=start).reshape(abs(h), stride)[:, : w * n].reshape(abs(h), w, n)
    rows = rows[::-1] if h > 0 else rows
    if n == 1:
        table = np.frombuffer(data, dtype=np.uint8, count=start - 14 - size, offset=14 + size).reshape(-1, 4)[:, 2::-1]
        return table[rows[:, :, 0]]
    return rows[:, :, [2, 1, 0, *([3] if n == 4 else [])]]


def encode_bmp(image: np.ndarray) -> bytes:
    """24 bits; 32 with alpha. Gray becomes colour."""
    h, w, n = image.shape
    image = np.repeat(image[:, :, :1], 3, axis=2) if n < 3 else image
    n = image.shape[2]
    rows = image[::-1][:, :, [2, 1, 0, *([3] if n == 4 else [])]].reshape(h, w * n)
    rows = np.pad(rows, ((0, 0), (0, -(w * n) % 4)))
    return b"BM" + struct.pack("<IHHI", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8 * n, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def decode_pnm(data: bytes) -> np.ndarray:
    """P5 and P6, up to 8 bits."""
    m = re.match(rb"(P[56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(?:#[^\n]*\n\s*)*(\d+)\s+(?:#[^\n]*\n\s*)*(\d+)\s", data)
    w, h, n = int(m[2]), int(m[3]), 3 if m[1] == b"P6" else 1
    return np.frombuffer(data, dtype=np.uint8, count=w * h * n, offset=m.end()).reshape(h, w, n)


def as_asked(image: np.ndarray, flags: int) -> np.ndarray:
    """To blue, green, red order, or gray."""
    n = image.shape[2]
    if flags == UNCHANGED:
        return image if n < 3 else image[:, :, [2, 1, 0, *([3] if n == 4 else [])]]
    if flags == GRAYSCALE:
        if n < 3:
            return image[:, :, :1]
        r, g, b = (image[:, :, k].astype(np.int64) for k in range(3))
        return ((77 * r + 150 * g + 29 * b) >> 8).astype(np.uint8)[:, :, None]
    return np.repeat(image[:, :, :1], 3, axis=2) if n < 3 else image[:, :, [2, 1, 0]]


def _decode(data: bytes) -> np.ndarray | None:
    try:
        if data[:8] == _SIGNATURE:
            return decode_png(data)
        if data[:2] == b"BM":
            return decode_bmp(data)
        if data[:2] in (b"P5", b"P6"):
            return decode_pnm(data)
    except (ValueError, KeyError, IndexError, TypeError, struct.error, zlib.error):
        return None
    return None


def imread(spark: SparkSession, path: str | list[str], flags: int = COLOR) -> DataFrame:
    """Packed 8U matrices, mat_id their path. Files that can't be decoded give an empty matrix. Files are read where the executors run; none passes the driver."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    other = F.lower(F.substring_index("path", ".", -1)).isin("jpg", "jpeg", "gif")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                image = _decode(row["content"])
                a = np.zeros((0, 0, 1), dtype=np.uint8) if image is None else as_asked(image, flags)
                yield pa.RecordBatch.from_pylist([as_row(row["path"], a, "8U")], schema=_ARROW)

    out = files.where(~other).mapInArrow(run, SCHEMA)
    paths = [path] if isinstance(path, str) else path
    if any(re.search(r"\.(jpe?g|gif)$|\*$|/$", p, re.IGNORECASE) for p in paths):
        out = out.unionByName(_by_spark(spark, path, flags))
    return out


def _by_spark(spark: SparkSession, path: str | list[str], flags: int) -> DataFrame:
    """JPEG and GIF: Spark's source gives bytes in blue, green, red order."""
    pictures = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*").where(F.lower(F.substring_index("origin", ".", -1)).isin("jpg", "jpeg", "gif"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                n, a = max(row["nChannels"], 1), np.zeros((0, 0, 1), dtype=np.uint8)
                if row["height"] > 0:
                    bgr = np.frombuffer(row["data"], dtype=np.uint8).reshape(row["height"], row["width"], n)
                    a = as_asked(bgr if n < 3 else bgr[:, :, [2, 1, 0, *([3] if n == 4 else [])]], flags)
                yield pa.RecordBatch.from_pylist([as_row(row["origin"], a, "8U")], schema=_ARROW)

    return pictures.mapInArrow(run, SCHEMA)


def encoded(packed: DataFrame, form: str) -> DataFrame:
    """mat_id, content (null if the matrix or the format can't be written): png, bmp, or jpg (quality 95, without alpha)."""
    ship(packed.sparkSession)

    def run(batches):
        for batch in batches:
            ids, out = [], []
            for row in batch.to_pylist():
                a = as_array(row)
                ids.append(row["mat_id"])
                ok = row["depth"] == "8U" and a.size and a.shape[2] <= 4 and form in ("png", "bmp", "jpg", "jpeg")
                rgb = a if a.shape[2] < 3 else a[:, :, [2, 1, 0, *([3] if a.shape[2] == 4 else [])]]
                out.append({"png": encode_png, "bmp": encode_bmp}.get(form, jpeg.encode)(rgb) if ok else None)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(out, pa.binary())], names=["mat_id", "content"])

    return packed.mapInArrow(run, "mat_id string, content binary")


def imwrite(packed: DataFrame, folder: str, form: str = "png") -> DataFrame:
    """A file for each matrix in a folder that all executors reach (a URI of a file system that Arrow knows), named by its mat_id. mat_id, path, ok; it runs when that is read.

    Executors encode and write; a task that is repeated writes the same file again.
    """
    ship(packed.sparkSession)
    form = form.lower().lstrip(".")

    def run(batches):
        from pyarrow import fs

        to, root = fs.FileSystem.from_uri(folder)
        to.create_dir(root, recursive=True)
        for batch in batches:
            ids, paths, done = [], [], []
            for r in batch.to_pylist():
                name = f"{root.rstrip('/')}/{re.sub('[^A-Za-z0-9]', '_', r['mat_id'])[-60:]}-{zlib.crc32(r['mat_id'].encode()):08x}.{form}"
                if r["content"] is not None:
                    with to.open_output_stream(name) as out:
                        out.write(r["content"])
                ids.append(r["mat_id"])
                paths.append(name)
                done.append(r["content"] is not None)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(paths, pa.string()), pa.array(done, pa.bool_())], names=["mat_id", "path", "ok"])

    return encoded(packed, form).mapInArrow(run, "mat_id string, path string, ok boolean")
