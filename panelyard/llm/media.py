"""Media columns: Netpbm and BMP in binary columns, decoded to numpy arrays, resized and written as NPY tiles.

Decoders: Netpbm P2, P3, P5 and P6 with 8-bit samples and comments in the header; uncompressed BMP with 8 bits and a
palette, or 24 bits, bottom-up or top-down. Area resizing reads every output pixel off an integral image: the mean of
exactly the input area it covers, with edge pixels weighted by their covered part. A difference hash compares each
pixel of a resized tile with its right neighbour.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelyard.session import staged

LINE = 64
PIXEL = 3
STEP = LINE * PIXEL
TILE = 32
HASH_SIDE = 8


def encode_netpbm(pixels: np.ndarray) -> bytes:
    kind = b"P6" if pixels.ndim == 3 else b"P5"
    return kind + b"\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """A 24-bit bottom-up BMP of RGB pixels."""
    height, width, _ = pixels.shape
    line = -(-width * 3 // 4) * 4
    rows = np.zeros((height, line), np.uint8)
    rows[:, : width * 3] = pixels[::-1, :, ::-1].reshape(height, width * 3)
    head = struct.pack("<2sIHHI", b"BM", 54 + line * height, 0, 0, 54)
    return head + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, line * height, 2835, 2835, 0, 0) + rows.tobytes()


def decode_netpbm(data: bytes) -> tuple[np.ndarray, int]:
    kind, fields, at = data[:2], [], 2
    while len(fields) < 3:
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = (data + b"\n").index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
        stop = at
        while data[stop : stop + 1].isdigit():
            stop += 1
        fields.append(int(data[at:stop]))
        at = stop
    width, height, most = fields
    if not 0 < most < 256:
        raise ValueError("only 8-bit samples")
    channels = 3 if kind in (b"P3", b"P6") else 1
    if not 0 < width * height * channels <= len(data):
        raise ValueError("no samples, or more than the file holds")
    if kind in (b"P5", b"P6"):
        samples = np.frombuffer(data, np.uint8, width * height * channels, at + 1)
    elif kind in (b"P2", b"P3"):
        samples = np.array([int(v) for v in data[at:].split()[: width * height * channels]], np.int64)
    else:
        raise ValueError("not a Netpbm picture of grey or colour samples")
    if samples.min(initial=0) < 0 or samples.max(initial=0) > most:
        raise ValueError("a sample outside the stated range")
    return samples.astype(np.uint8).reshape((height, width, 3) if channels == 3 else (height, width)), most


def decode_bmp(data: bytes) -> np.ndarray:
    start, = struct.unpack_from("<I", data, 10)
    head, width, height, _, depth, packing, _, _, _, colours = struct.unpack_from("<IiiHHIIiiI", data, 14)
    if packing or depth not in (8, 24):
        raise ValueError("only uncompressed BMP of 8 or 24 bits")
    if width <= 0 or not 0 < abs(height) * width <= len(data):
        raise ValueError("no samples, or more than the file holds")
    line = -(-width * depth // 32) * 4
    rows = np.frombuffer(data, np.uint8, line * abs(height), start).reshape(abs(height), line)
    rows = rows[::-1] if height > 0 else rows
    if depth == 24:
        return np.ascontiguousarray(rows[:, : width * 3].reshape(abs(height), width, 3)[:, :, ::-1])
    palette = np.frombuffer(data, np.uint8, (colours or 256) * 4, 14 + head).reshape(-1, 4)[:, 2::-1]
    return palette[rows[:, :width]]


def decode_with_range(data: bytes) -> tuple[np.ndarray, int]:
    """Samples of a picture, and the value that stands for full brightness."""
    return (decode_bmp(data), 255) if data[:2] == b"BM" else decode_netpbm(data)


def decode(data: bytes) -> np.ndarray:
    """Samples of a picture as an array (height, width) or (height, width, 3)."""
    return decode_with_range(data)[0]


def grey(pixels: np.ndarray, most: int = 255) -> np.ndarray:
    """Brightness from 0 to 255."""
    flat = pixels.astype(np.float64) if pixels.ndim == 2 else pixels.astype(np.float64).mean(axis=2)
    return flat if most == 255 else flat * (255 / most)


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the covered area per output pixel, from differences of the integral image at fractional borders."""
    total = np.zeros((pixels.shape[0] + 1, pixels.shape[1] + 1))
    total[1:, 1:] = pixels.cumsum(axis=0).cumsum(axis=1)
    for axis, count in ((0, height), (1, width)):
        size = pixels.shape[axis]
        border = np.arange(count + 1) * (size / count)
        low = np.minimum(border.astype(np.int64), size - 1)
        part = border - low
        part = part[:, None] if axis == 0 else part[None, :]
        total = total.take(low, axis) * (1 - part) + total.take(low + 1, axis) * part
    area = (pixels.shape[0] / height) * (pixels.shape[1] / width)
    return (total[1:, 1:] - total[:-1, 1:] - total[1:, :-1] + total[:-1, :-1]) / area


def difference_hash(pixels: np.ndarray, side: int = HASH_SIDE, most: int = 255) -> str:
    small = np.round(area_resize(grey(pixels, most), side, side + 1), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy_tile(pixels: np.ndarray, side: int = TILE, most: int = 255) -> bytes:
    """The picture resized to a square of 8-bit grey samples, in NPY format."""
    out = io.BytesIO()
    np.save(out, np.clip(np.round(area_resize(grey(pixels, most), side, side)), 0, 255).astype(np.uint8))
    return out.getvalue()


def as_picture(text: str | None) -> tuple[int, bytes]:
    """UTF-8 bytes of a text as rows of 64 RGB pixels, padded with spaces; BMP if the number of rows is even, else PPM."""
    raw = (text or "").encode()
    size = max(1, -(-len(raw) // STEP)) * STEP
    pixels = np.frombuffer(raw.ljust(size, b" "), np.uint8).reshape(-1, LINE, PIXEL)
    return len(raw), encode_netpbm(pixels) if len(pixels) % 2 else encode_bmp(pixels)


def text_pictures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text stored losslessly as a picture; a null text counts as empty."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                made = [as_picture(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([m for _, m in made], pa.binary())], ["doc_id", "n_bytes", "media"]
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(draw, "doc_id long, n_bytes long, media binary")


def picture_features(media: DataFrame) -> DataFrame:
    """Add to a table with a binary column ``media``: sizes, digests, an NPY tile and its difference hash.

    Columns: height, width, samples (bytes of all samples), payload_sha256, tail_crc32 (of the last 16 sample bytes),
    media_bytes, media_sha256, dhash, tile. Samples and their digest are as stored; hash and tile are scaled to 255. A null
    picture or one that cannot be read (cut short, empty, samples out of range, sizes that the file cannot hold) gets
    nulls, never an error.
    """
    added = T.StructType.fromDDL(
        "height int, width int, samples long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, dhash string, tile binary"
    )
    names = added.names
    kept = [c for c in media.columns if c != "media"]
    schema = T.StructType([*media.select(*kept).schema.fields, *added.fields])

    def look(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * len(names)
        stored = (len(data), hashlib.sha256(data).hexdigest())
        try:
            pixels, most = decode_with_range(data)
            samples = pixels.tobytes()
            return (
                *pixels.shape[:2], len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), *stored,
                difference_hash(pixels, most=most), npy_tile(pixels, most=most),
            )
        except (ValueError, IndexError, OverflowError, struct.error):
            return (None, None, None, None, None, *stored, None, None)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                rows = [look(data.as_py()) for data in part.column(batch.schema.get_field_index("media"))]
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*[part.column(batch.schema.get_field_index(c)) for c in kept], *columns], [*kept, *names])

    return media.select(*kept, "media").mapInArrow(scan, schema)


def text_features(docs: DataFrame) -> DataFrame:
    """Pictures of all texts, written to the shared folder, read back and decoded; one row per document."""
    return picture_features(staged(text_pictures(docs), "pictures"))
