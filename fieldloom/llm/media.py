"""Media columns: bytes as 8-bit grey PNG images, and hashes of their low frequencies.

``encode`` writes PNG by hand: one filter (None, Sub or Up) for all rows of an image, the
one that compresses its first rows best; zlib; data chunks with checksums. ``decode``
tests the signature, each chunk's CRC-32 and zlib's Adler-32, and undoes any mix of the
five filters with numpy. The feature is a 64-bit hash: the image's means over a 32 x 32 grid,
their two-dimensional cosine transform, and for each of the 8 x 8 lowest frequencies
whether it is above the median of those but the constant one.

Each row is handled alone, in its own task: no shuffle, nothing kept between rows.

Defined results: null bytes are empty ones; a payload has at least one unit (all
padding, if empty); equal bytes have equal results; repeated rows and null ids are kept;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIGNATURE = b"\x89PNG\r\n\x1a\n"
GRID, LOW = 32, 8


def pad(data: bytes, unit: int, fill: int = 255) -> bytes:
    """The data, filled up to a positive multiple of ``unit`` bytes."""
    return data + bytes([fill]) * (-len(data) % unit if data else unit)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _filtered(image: np.ndarray, kind: int) -> np.ndarray:
    out = np.empty((image.shape[0], image.shape[1] + 1), np.uint8)
    out[:, 0] = kind
    out[:, 1:] = image
    if kind == 1:
        out[:, 2:] -= image[:, :-1]
    elif kind == 2:
        out[1:, 1:] -= image[:-1]
    return out


def encode(payload: bytes, width: int, level: int = 6, data_chunk: int = 1 << 16) -> bytes:
    """The PNG of a payload whose length is a multiple of ``width``."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, width)
    trial = image[: max(1, (1 << 13) // width)]
    kind = min(range(3), key=lambda k: len(zlib.compress(_filtered(trial, k), 1)))
    packed = zlib.compress(_filtered(image, kind), level)
    head = struct.pack(">IIBBBBB", width, len(image), 8, 0, 0, 0, 0)
    data = [_chunk(b"IDAT", packed[i : i + data_chunk]) for i in range(0, len(packed), data_chunk)]
    return b"".join([SIGNATURE, _chunk(b"IHDR", head), *data, _chunk(b"IEND", b"")])


def _unfilter(rows: np.ndarray) -> np.ndarray:
    """Undo the filters of 8-bit grey rows; runs of rows with one filter go together."""
    kinds, image = rows[:, 0], rows[:, 1:].copy()
    cuts = np.flatnonzero(np.r_[True, kinds[1:] != kinds[:-1]])
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(rows)]):
        kind = int(kinds[a])
        if kind == 1:
            np.cumsum(image[a:b], axis=1, dtype=np.uint8, out=image[a:b])
        elif kind == 2:
            if a:
                image[a] += image[a - 1]
            np.cumsum(image[a:b], axis=0, dtype=np.uint8, out=image[a:b])
        elif kind in (3, 4):
            for r in range(a, b):
                up = image[r - 1].tolist() if r else [0] * image.shape[1]
                line, left, corner = image[r].tolist(), 0, 0
                for i, above in enumerate(up):
                    if kind == 3:
                        guess = (left + above) >> 1
                    else:
                        p = left + above - corner
                        guess = min((abs(p - left), 0, left), (abs(p - above), 1, above), (abs(p - corner), 2, corner))[2]
                    line[i] = left = (line[i] + guess) & 255
                    corner = above
                image[r] = line
        elif kind:
            raise ValueError("unknown PNG filter")
    return image


def decode(data: bytes) -> np.ndarray:
    """The samples of an 8-bit grey PNG, height by width; raises if a checksum is wrong."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, size, packed = 8, None, []
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError(f"wrong checksum of PNG chunk {kind!r}")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
        at += 12 + n
    if size is None or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("only plain 8-bit grey PNGs")
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    return _unfilter(rows.reshape(size[1], size[0] + 1))


def _means(a: np.ndarray, n: int) -> np.ndarray:
    """Means over ``n`` equal stretches of the first axis, cells shared by parts."""
    sums = np.zeros((len(a) + 1, a.shape[1]))
    np.cumsum(a, axis=0, out=sums[1:])
    at = np.arange(n + 1) * (len(a) / n)
    whole = np.minimum(at.astype(np.int64), len(a) - 1)
    edge = sums[whole] + (at - whole)[:, None] * a[whole]
    return np.diff(edge, axis=0) * (n / len(a))


_COS = np.cos(np.pi / GRID * (np.arange(GRID)[None, :] + 0.5) * np.arange(LOW)[:, None])


def frequency_hash(image: np.ndarray) -> str:
    """16 hex digits: which low frequencies are above their median."""
    grid = _means(_means(image.astype(np.float64), GRID).T, GRID).T
    low = np.round(_COS @ grid @ _COS.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def _fields(docs: DataFrame, id_col: str, *more: T.StructField) -> T.StructType:
    return T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *more])


def to_media(rows: DataFrame, id_col: str, bytes_col: str, unit: int = 576, width: int = 32, level: int = 6) -> DataFrame:
    """The id, ``n_bytes`` (unpadded) and ``media``, the PNG of the padded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media, sizes = [], []
            for x in batch.column(1):
                data = x.as_py() or b""
                sizes.append(len(data))
                media.append(encode(pad(data, unit), width, level))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=schema.names)

    schema = _fields(rows, id_col, T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType()))
    return rows.select(F.col(id_col), F.col(bytes_col).cast("binary")).mapInArrow(run, schema)


def from_media(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The columns of ``to_media``, ``payload`` as decoded, and ``feature``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payload, feature = [], []
            for x in batch.column(2):
                image = decode(x.as_py())
                payload.append(image.tobytes())
                feature.append(frequency_hash(image))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(payload, pa.binary()), pa.array(feature, pa.string())], names=schema.names)

    schema = _fields(rows, id_col, *[T.StructField(n, k) for n, k in (("n_bytes", T.LongType()), ("media", T.BinaryType()), ("payload", T.BinaryType()), ("feature", T.StringType()))])
    return rows.select(id_col, "n_bytes", "media").mapInArrow(run, schema)
