"""Token-id files: bit- or byte-plane shuffled blocks under zstandard.

A file is one binary value, so that it can lie in any store that Spark writes to:

    magic "PLID1", kind of planes (1: bytes, 2: bits), zeros (2 bytes)
    u32 ids per block, u32 number of blocks, u64 number of ids, u32 number of documents
    chunk index: per block and plane a u32 length of the compressed plane (0: all zero)
    u64 bytes of the compressed document table, then the table: i64 ids, i64 lengths
    the compressed planes, block by block

All integers are little-endian. A block is transposed to four byte planes or 32 bit
planes, and each plane that isn't all zero is compressed alone.

Defined results: a null text is an empty one and gives its end id alone; rows that
repeat an id follow each other, ordered by text; a null id comes first; an empty
table gives no files; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"PLID1"
HEAD = "<5sBxxIIQI"
#: A null document id in the document table.
NO_ID = -(1 << 63)


def encode_file(ids: np.ndarray, doc_ids, lengths, block: int = 1 << 16, planes: str = "bytes") -> bytes:
    """The file of ``ids`` (uint32), which belong to documents of such lengths."""
    import zstandard

    press = zstandard.ZstdCompressor(level=1).compress
    ids = np.ascontiguousarray(ids, dtype="<u4")
    index: list[int] = []
    body: list[bytes] = []
    for i in range(0, len(ids), block):
        part = ids[i : i + block]
        if planes == "bytes":
            rows = part.view(np.uint8).reshape(-1, 4).T
        else:
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
            rows = np.packbits(bits.T, axis=1, bitorder="little")
        for row in rows:
            packed = press(row.tobytes()) if row.any() else b""
            index.append(len(packed))
            body.append(packed)
    table = press(np.array([NO_ID if d is None else d for d in doc_ids], "<i8").tobytes() + np.asarray(lengths, "<i8").tobytes())
    kind = 1 if planes == "bytes" else 2
    head = struct.pack(HEAD, MAGIC, kind, block, -(-len(ids) // block), len(ids), len(lengths))
    return b"".join([head, np.asarray(index, "<u4").tobytes(), struct.pack("<Q", len(table)), table, *body])


def decode_file(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, document ids and lengths of a file."""
    import zstandard

    magic, kind, block, blocks, n, docs = struct.unpack_from(HEAD, data)
    if magic != MAGIC:
        raise ValueError("not a token-id file")
    width = 4 if kind == 1 else 32
    at = struct.calcsize(HEAD)
    index = np.frombuffer(data, "<u4", blocks * width, at).reshape(blocks, width)
    at += index.nbytes
    (size,) = struct.unpack_from("<Q", data, at)
    at += 8
    open_ = zstandard.ZstdDecompressor().decompress
    table = np.frombuffer(open_(data[at : at + size]), "<i8")
    at += size
    out = np.empty(n, "<u4")
    for b in range(blocks):
        m = min(block, n - b * block)
        rows = np.zeros((width, m if kind == 1 else -(-m // 8)), np.uint8)
        for p in range(width):
            if size := int(index[b, p]):
                rows[p] = np.frombuffer(open_(data[at : at + size]), np.uint8)
                at += size
        if kind == 1:
            part = np.ascontiguousarray(rows.T).view("<u4").ravel()
        else:
            bits = np.unpackbits(rows, axis=1, bitorder="little")[:, :m]
            part = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u4").ravel()
        out[b * block : b * block + m] = part
    return out, table[:docs], table[docs:]


def write(
    docs: DataFrame,
    path: str,
    tokenizer_file: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    file_ids: int = 1 << 20,
    planes: str = "bytes",
) -> None:
    """Write all documents' ids in ascending order of their id, as a table of files.

    ``part`` and ``file`` order the files, ``first`` counts the ids before a file in
    its part, ``n_ids`` its own. A file ends with the document that takes it to
    ``file_ids``. Rows are dealt by ranges of the id (and of the text's hash, so that
    one id with very many rows doesn't land in one task).
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(n, "id", "tie").sortWithinPartitions("id", "tie", "text").drop("tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from fieldloom.llm.tokens import encoder as kept

        encoder, part = kept(tokenizer_file, spaces=False), TaskContext.get().partitionId()
        parts: list[np.ndarray] = []
        doc_ids: list = []
        file = first = held = 0

        def close() -> pa.RecordBatch:
            data = encode_file(np.concatenate(parts), doc_ids, [len(p) for p in parts], planes=planes)
            columns = [pa.array([x], pa.int64()) for x in (part, file, first, held)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([data], pa.binary())], names=["part", "file", "first", "n_ids", "data"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.ids(text.as_py(), end_id)
                parts.append(ids)
                doc_ids.append(doc_id)
                held += len(ids)
                if held >= file_ids:
                    yield close()
                    parts, doc_ids, file, first, held = [], [], file + 1, first + held, 0
        if parts:
            yield close()

    rows.mapInArrow(run, "part long, file long, first long, n_ids long, data binary").write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents of written files: ``doc_id, start, n_tokens`` and ``ids``, their ids
    as little-endian unsigned 32-bit integers. ``start`` counts all ids before a document.

    The driver gets one total per part (there are as many as shuffle partitions).
    """
    files = spark.read.schema("part long, file long, first long, n_ids long, data binary").parquet(path)
    totals = {r["part"]: r["n"] for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    before, so_far = {}, 0
    for part in sorted(totals):
        before[part] = so_far
        so_far += totals[part]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first, data in zip(*(batch.column(i) for i in range(3))):
                ids, doc_ids, lengths = decode_file(data.as_py())
                ends = np.cumsum(lengths)
                starts = ends - lengths
                raw, step = ids.tobytes(), 1 + len(lengths) * (1 << 20) // max(1, len(ids))
                base = before[part.as_py()] + first.as_py()
                for i in range(0, len(lengths), step):
                    few = slice(i, i + step)
                    columns = [
                        pa.array([None if d == NO_ID else d for d in doc_ids[few].tolist()], pa.int64()),
                        pa.array(starts[few] + base),
                        pa.array(lengths[few]),
                        pa.array([raw[4 * a : 4 * b] for a, b in zip(starts[few].tolist(), ends[few].tolist())], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids"])

    return files.select("part", "first", "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
