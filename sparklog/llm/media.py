"""Media columns: bytes as 8-bit grey PNG images, read back with every checksum tested, and hashes of low frequencies.

A payload is rows of ``WIDTH`` samples. The encoder writes one IDAT chunk, with one filter for all rows (none, the one
before, or the one above), whichever leaves the smallest sum of differences. The decoder knows all five filters: those
without a prediction from decoded values of the same row are undone for whole images by running sums in numpy. Chunks
are tested for their CRC, the stream by zlib for its Adler sum; anything wrong raises ValueError.

The feature is a perceptual hash: means over a 32 x 32 grid, a two-dimensional cosine transform, and for the 8 x 8 lowest
frequencies whether each is above the median: 16 hex digits.

Null and empty texts are one row of zeros. Rows that repeat give equal values; a null doc_id is kept; other columns are
left aside; an empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, arrow_schema, checked, text_slices

WIDTH, LEVEL = 64, 1
SIGNATURE = b"\x89PNG\r\n\x1a\n"
MEDIA = arrow_schema(doc_id=pa.int64(), n_bytes=pa.int64(), media=pa.binary())
DECODED = arrow_schema(doc_id=pa.int64(), n_bytes=pa.int64(), media=pa.binary(), payload=pa.binary(), feature=pa.string())

_GRID, _LOW = 32, 8
_COSINE = np.cos(np.pi * np.outer(np.arange(_LOW), np.arange(_GRID) + 0.5) / _GRID)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(image: np.ndarray) -> bytes:
    """A grey 8-bit image, rows by columns."""
    height, width = image.shape
    left, up = image.copy(), image.copy()
    left[:, 1:] -= image[:, :-1]
    up[1:] -= image[:-1]
    tries = (image, left, up)
    kind = int(np.argmin([int(np.minimum(x, (~x) + np.uint8(1)).sum(dtype=np.int64)) for x in tries]))
    lines = np.empty((height, width + 1), np.uint8)
    lines[:, 0], lines[:, 1:] = kind, tries[kind]
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(type, data) of each chunk, tested."""
    if data[:8] != SIGNATURE:
        raise ValueError("this isn't a PNG file")
    at = 8
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError("a chunk is cut off")
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if len(body) < n or data[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError(f"the checksum of chunk {kind!r} is wrong")
        yield kind, body
        at += 12 + n
        if kind == b"IEND":
            return
    raise ValueError("there is no IEND chunk")


def unfilter(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Samples (one byte each) from filtered rows."""
    height, width = lines.shape
    if not height:
        return lines
    if (kinds == 0).all():
        return lines
    if (kinds == 1).all():
        return np.cumsum(lines, axis=1, dtype=np.uint8)
    if (kinds == 2).all():
        return np.cumsum(lines, axis=0, dtype=np.uint8)
    out = np.zeros((height + 1, width), np.uint8)
    for y in range(height):
        kind, line, above = int(kinds[y]), lines[y], out[y]
        if kind == 0:
            out[y + 1] = line
        elif kind == 1:
            out[y + 1] = np.cumsum(line, dtype=np.uint8)
        elif kind == 2:
            out[y + 1] = line + above
        elif kind in (3, 4):
            a = c = 0
            row = bytearray(width)
            for x, (v, b) in enumerate(zip(line.tolist(), above.tolist())):
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
                a, c = (v + guess) & 255, b
                row[x] = a
            out[y + 1] = np.frombuffer(bytes(row), np.uint8)
        else:
            raise ValueError(f"there is no filter {kind}")
    return out[1:]


def decode_png(data: bytes) -> np.ndarray:
    """The image of a grey 8-bit PNG file without interlace."""
    head, stream = None, []
    for kind, body in chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            stream.append(body)
    if head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("this isn't a grey image of 8 bits")
    width, height = head[:2]
    try:
        raw = zlib.decompress(b"".join(stream))
    except zlib.error as e:
        raise ValueError(str(e)) from e
    if len(raw) != height * (width + 1):
        raise ValueError("the image has another size than its header says")
    lines = np.frombuffer(raw, np.uint8).reshape(height, width + 1)
    return unfilter(lines[:, 0], lines[:, 1:])


def _shrink(image: np.ndarray, axis: int) -> np.ndarray:
    """Means over 32 equal parts of an axis; a shorter axis repeats its samples."""
    n = image.shape[axis]
    edge = np.arange(_GRID + 1) * n // _GRID
    low = np.minimum(edge[:-1], n - 1)
    size = np.maximum(edge[1:], low + 1) - low
    if n >= _GRID:
        total = np.add.reduceat(image, low, axis=axis)
    else:
        total = image.take(low, axis=axis)
        size = np.ones(_GRID, np.int64)
    return total / (size[:, None] if axis == 0 else size)


def low_frequencies(image: np.ndarray) -> str:
    small = _shrink(_shrink(image.astype(np.float64), 0), 1)
    low = np.round(_COSINE @ small @ _COSINE.T, 6).ravel()
    bits = low > np.median(low)
    return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, raw, off in text_slices(batch, "text"):
            media = []
            for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
                image = np.zeros((max(1, -(-(b - a) // WIDTH)), WIDTH), np.uint8)
                image.reshape(-1)[: b - a] = raw[a:b]
                media.append(encode_png(image))
            yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), pa.array(np.diff(off)), pa.array(media, pa.binary())], schema=MEDIA)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            rows = batch.slice(i, 256)
            images = [decode_png(x) for x in rows.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([x.tobytes() for x in images], pa.binary()), pa.array([low_frequencies(x) for x in images])], schema=DECODED)


def stored(documents: DataFrame) -> DataFrame:
    """A row for each document row: doc_id, n_bytes (of its text), media (its PNG image)."""
    return arrow_map(checked(documents, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")), _stored, MEDIA)


def read_back(media: DataFrame) -> DataFrame:
    """The same rows with payload (the image's samples) and feature."""
    return arrow_map(checked(media, "doc_id", "n_bytes", "media"), _read, DECODED)


def op10(documents: DataFrame) -> DataFrame:
    df = read_back(stored(documents))
    return df.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, length(payload) - 63, 64)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
