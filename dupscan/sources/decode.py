"""Decoding of image files to tensors.

Pillow is used where it is installed; otherwise PNG, PNM and BMP are decoded here, and what the JVM can read besides (JPEG,
GIF, TIFF, WBMP) by Spark's image source. Everything else is reported as undecodable.
"""

from __future__ import annotations

import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dupscan.functions.tensors import resample

try:
    from PIL import Image
except ImportError:
    Image = None

#: Extensions that are left to the JVM where there is no Pillow.
JVM_EXTENSIONS = ("jpg", "jpeg", "jpe", "jfif", "jif", "gif", "tif", "tiff")
NO_DECODER = "no decoder for this format"
#: Pixels of an image at most.
MOST_PIXELS = 178_956_970


class DecodeError(ValueError):
    pass


def _unfilter(raw: memoryview, height: int, stride: int, step: int) -> np.ndarray:
    """Rows of a PNG image without their filters."""
    out = np.zeros((height, stride), np.uint8)
    before = np.zeros(stride, np.uint8)
    for y in range(height):
        kind = raw[y * (stride + 1)]
        line = np.frombuffer(raw[y * (stride + 1) + 1 : (y + 1) * (stride + 1)], np.uint8)
        if kind == 0:
            row = line.copy()
        elif kind == 1:
            row = np.empty(stride, np.uint8)
            for k in range(min(step, stride)):
                row[k::step] = np.cumsum(line[k::step], dtype=np.uint8)
        elif kind == 2:
            row = line + before
        elif kind in (3, 4):
            row = bytearray(line.tobytes())
            up = before.tolist()
            for i in range(stride):
                left = row[i - step] if i >= step else 0
                if kind == 3:
                    guess = (left + up[i]) // 2
                else:
                    corner = up[i - step] if i >= step else 0
                    p = left + up[i] - corner
                    guess = min((abs(p - left), 0, left), (abs(p - up[i]), 1, up[i]), (abs(p - corner), 2, corner))[2]
                row[i] = (row[i] + guess) & 255
            row = np.frombuffer(bytes(row), np.uint8)
        else:
            raise DecodeError("broken PNG filter")
        out[y] = before = row
    return out


def _png_samples(raw: memoryview, width: int, height: int, depth: int, channels: int) -> tuple[np.ndarray, int]:
    """(height x width x channels samples, bytes used); 16-bit samples lose their low byte."""
    stride = (width * channels * depth + 7) // 8
    size = height * (stride + 1) if width else 0
    if len(raw) < size:
        raise DecodeError("PNG data end too early")
    rows = _unfilter(raw, height, stride, max(1, channels * depth // 8))
    if depth == 16:
        rows = rows[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(height, -1, depth)
        rows = (bits << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(2).astype(np.uint8)
    return rows[:, : width * channels].reshape(height, width, channels), size


def _png(data: bytes) -> np.ndarray:
    at, header, palette, packed = 8, None, None, []
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
        at += 12 + n
    if not header:
        raise DecodeError("PNG without header")
    width, height, depth, colour, _, _, laced = header
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if not channels or not width or not height or width * height > MOST_PIXELS:
        raise DecodeError("PNG of unknown kind or size")
    raw = memoryview(zlib.decompress(b"".join(packed)))
    if laced:
        pixels, used = np.zeros((height, width, channels), np.uint8), 0
        for x, y, dx, dy in ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)):
            w, h = -(-(width - x) // dx), -(-(height - y) // dy)
            if w > 0 and h > 0:
                pixels[y::dy, x::dx], n = _png_samples(raw[used:], w, h, depth, channels)
                used += n
    else:
        pixels, _ = _png_samples(raw, width, height, depth, channels)
    if colour == 3:
        if palette is None:
            raise DecodeError("PNG without palette")
        return palette[np.minimum(pixels[..., 0], len(palette) - 1)]
    if colour in (0, 4):
        grey = pixels[..., :1].astype(np.uint16) * (255 // ((1 << min(depth, 8)) - 1))
        return np.repeat(grey.astype(np.uint8), 3, 2)
    return pixels[..., :3]


def _pnm(data: bytes) -> np.ndarray:
    at, numbers = 2, []
    need = 2 if data[1:2] in b"14" else 3
    while len(numbers) < need:
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        numbers.append(int(data[at:end]))
        at = end
    width, height = numbers[:2]
    most = numbers[2] if need == 3 else 1
    kind, channels = data[1:2], 3 if data[1:2] in b"36" else 1
    n = width * height * channels
    if not 0 < width * height <= MOST_PIXELS or not 0 < most < 65536:
        raise DecodeError("PNM of unknown size")
    if kind in b"123":
        text = b" ".join(data[at:].replace(b"", b" ").split()) if kind == b"1" else data[at:]
        values = np.array(text.split()[:n], np.int64)
    elif kind == b"4":
        rows = np.frombuffer(data, np.uint8, offset=at + 1)[: height * -(-width // 8)].reshape(height, -1)
        values = np.unpackbits(rows, axis=1)[:, :width].ravel().astype(np.int64)
    else:
        values = np.frombuffer(data, np.uint8 if most < 256 else ">u2", offset=at + 1)[:n].astype(np.int64)
    if len(values) != n:
        raise DecodeError("PNM data end too early")
    values = (1 - values) * 255 if kind in b"14" else values * 255 // most if most != 255 else values
    out = values.astype(np.uint8).reshape(height, width, channels)
    return out if channels == 3 else np.repeat(out, 3, 2)


def _bmp(data: bytes) -> np.ndarray:
    start, head = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    width, height, _, depth, packing = struct.unpack_from("<iiHHI", data, 18)
    up, height = height > 0, abs(height)
    if packing not in (0, 3) or depth not in (1, 4, 8, 24, 32) or not 0 < width * height <= MOST_PIXELS:
        raise DecodeError("BMP of unknown kind or size")
    stride = (width * depth + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, height * stride, start).reshape(height, stride)
    if depth <= 8:
        bits = np.unpackbits(rows, axis=1).reshape(height, -1, depth)
        places = (bits << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(2)[:, :width]
        table = np.frombuffer(data[14 + head : start], np.uint8)
        table = table[: len(table) // 4 * 4].reshape(-1, 4)
        out = table[np.minimum(places, len(table) - 1)][..., 2::-1]
    else:
        out = rows[:, : width * depth // 8].reshape(height, width, -1)[..., 2::-1]
    return out[::-1] if up else out


def decode_image(data: bytes) -> np.ndarray:
    """H x W x 3 RGB bytes of an image; alpha is dropped, grey and palettes become RGB."""
    if Image is not None:
        import warnings

        with warnings.catch_warnings():
            warnings.simplefilter("error", UserWarning)
            warnings.simplefilter("error", Image.DecompressionBombWarning)
            img = Image.open(io.BytesIO(data))
            return np.asarray(img if img.getbands() == ("R", "G", "B") else img.convert("RGB"))
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return _png(data)
    if data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
        return _pnm(data)
    if data[:2] == b"BM":
        return _bmp(data)
    raise DecodeError(NO_DECODER)


def to_tensor(image: np.ndarray, px: int) -> tuple[int, int, bytes, int]:
    """(width, height, tensor, sum of its bytes); the size is the image's own, before it is resampled."""
    small = np.ascontiguousarray(resample(image, px))
    return image.shape[1], image.shape[0], small.tobytes(), int(small.sum(dtype=np.int64))


_KEPT = ("file_id", "group_id", "root", "path", "ext")
SCHEMA = "file_id bigint, group_id int, root string, path string, ext string, width int, height int, tensor binary, px_sum bigint, decode_error string"
_NEW = (("width", pa.int32()), ("height", pa.int32()), ("tensor", pa.binary()), ("px_sum", pa.int64()), ("decode_error", pa.string()))


def _rows(batch: pa.RecordBatch, results: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array([r[i] for r in results], t) for i, (_, t) in enumerate(_NEW)]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in _KEPT), *columns], [*_KEPT, *(n for n, _ in _NEW)])


def decode_files(files: DataFrame, px: int) -> DataFrame:
    """files with width, height, tensor, px_sum, or with decode_error; one file is in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 64):
                batch, results = whole.slice(at, 64), []
                for path in batch.column("path").to_pylist():
                    try:
                        with open(path, "rb") as f:
                            results.append((*to_tensor(decode_image(f.read()), px), None))
                    except Exception as e:  # noqa: BLE001  whatever a broken file makes of the decoder is its error
                        results.append((None, None, None, None, str(e) or type(e).__name__))
                yield _rows(batch, results)

    return files.mapInArrow(run, SCHEMA)


def _either_case(extension: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in extension)


def decode_in_jvm(spark: SparkSession, files: DataFrame, roots: list[str], px: int, recursive: bool = True) -> DataFrame:
    """decode_files by Spark's image source, for the files that it finds below the roots (names that begin with _ aren't).

    Only files of JVM_EXTENSIONS are read, and subfolders if the listing had them. Roots are taken literally.
    """
    glob = "*.{" + ",".join(map(_either_case, JVM_EXTENSIONS)) + "}"
    literal = [re.sub(r"([\\*?\[\]{}])", r"\\\1", x) for x in roots]
    raw = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", recursive).option("pathGlobFilter", glob).load(literal).select("image.*")
    plain = F.url_decode(F.regexp_replace(F.regexp_replace("origin", "^file:(//)?", ""), r"\+", "%2B"))
    met = files.join(raw.select(plain.alias("_path"), F.col("height").alias("_h"), F.col("width").alias("_w"), F.col("nChannels").alias("_n"), "data"), F.col("path") == F.col("_path"), "left").drop("_path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results = []
            for h, w, n, data in zip(*(batch.column(c).to_pylist() for c in ("_h", "_w", "_n", "data")), strict=True):
                if data is None or (h or -1) < 0:
                    results.append((None, None, None, None, "could not be identified as an image"))
                    continue
                bgr = np.frombuffer(data, np.uint8).reshape(h, w, n)
                results.append((*to_tensor(np.repeat(bgr, 3, 2) if n == 1 else bgr[..., 2::-1], px), None))
            yield _rows(batch, results)

    return met.mapInArrow(run, SCHEMA)
