"""Packing documents into fixed windows by the sum-of-squares rule.

Online, in the order of a partition's rows: a document gives its full windows
first; its rest goes to the fill level that makes the sum over levels of the
squared count of partially filled windows smallest (a new window is level 0). The
counts are a level array. Windows that are open at the end of a partition are merged by
cutting pieces, so that at most one of them stays partly empty.

``max_open`` bounds a task's memory: where more windows are open, which the rule itself
seldom leads to, they are merged in the same way, and the rule starts anew. All rows are
packed either way; 4096 windows of 2048 ids are 32 MB.

Nothing is shuffled: each input partition packs its own rows, and holds only its
open windows. A lost executor's partition is packed again in the same way.

Defined results: a null text is an empty one and gives its end id alone; repeated
rows are packed each; null ids stay null; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A piece: document id, ids before it in its document, its ids, ids of the document.
Piece = tuple[object, int, np.ndarray, int]

#: Windows that a task holds open at most, unless a caller says otherwise.
MAX_OPEN = 4096


class SumOfSquares:
    """The packer of one partition."""

    def __init__(self, capacity: int, max_open: int = MAX_OPEN):
        self.capacity, self.max_open = capacity, max_open
        self.count = np.zeros(capacity + 1, dtype=np.int64)
        self.at: list[list[list[Piece]]] = [[] for _ in range(capacity)]
        self.open = 0

    def add(self, doc_id, ids: np.ndarray) -> Iterator[list[Piece]]:
        """Place a document; gives the windows that it completes."""
        n, c = len(ids), self.capacity
        whole = n - n % c
        for i in range(0, whole, c):
            yield [(doc_id, i, ids[i : i + c], n)]
        if whole < n:
            yield from self._place((doc_id, whole, ids[whole:].copy(), n))
        if self.open > self.max_open:
            yield from self.flush(keep_last=True)

    def _place(self, piece: Piece) -> Iterator[list[Piece]]:
        s, c, n = len(piece[2]), self.capacity, self.count
        change = n[s:] - n[: c - s + 1]  # halved change of the sum, but for its constant
        change = change * 2 + 2
        change[0] -= 1
        change[-1] -= 1
        change[1:][n[1 : c - s + 1] == 0] = np.iinfo(np.int64).max
        level = len(change) - 1 - int(np.argmin(change[::-1]))  # ties: the fullest
        if level:
            window = self.at[level].pop()
            n[level] -= 1
            self.open -= 1
        else:
            window = []
        window.append(piece)
        if level + s < c:
            self._put(level + s, window)
        else:
            yield window

    def _put(self, level: int, window: list[Piece]) -> None:
        self.at[level].append(window)
        self.count[level] += 1
        self.open += 1

    def flush(self, keep_last: bool = False) -> Iterator[list[Piece]]:
        """Merge the open windows, the emptiest into the fullest; pieces are cut."""
        c = self.capacity
        rest = [w for level in self.at for w in level]
        self.count[:] = 0
        self.at = [[] for _ in range(c)]
        self.open = 0
        low, high, spare = 0, len(rest) - 1, [p for p in rest[0]] if rest else []
        while low < high:
            window = rest[high]
            room = c - sum(len(p[2]) for p in window)
            while room and (spare or low + 1 < high):
                if not spare:
                    low += 1
                    spare = list(rest[low])
                doc_id, start, ids, n = spare.pop()
                take = min(room, len(ids))
                window.append((doc_id, start, ids[:take], n))
                if take < len(ids):
                    spare.append((doc_id, start + take, ids[take:], n))
                room -= take
            if room:
                break
            yield window
            high -= 1
            if not spare:
                low += 1
                spare = list(rest[low]) if low <= high else []
        last = rest[high] if low < high else spare
        if last and keep_last:
            self._put(sum(len(p[2]) for p in last), last)
        elif last:
            yield last


def pack(
    docs: DataFrame,
    tokenizer_file: str,
    end_id: int,
    capacity: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    cache_chunks: int | None = None,
    max_open: int = MAX_OPEN,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, doc_tokens, sequence_id, offset``
    and ``ids``, the piece's ids as little-endian unsigned 32-bit integers."""
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema[id_col].dataType),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("doc_tokens", T.LongType()),
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from fieldloom.llm.shared import release_memory
        from fieldloom.llm.tokens import encoder as kept

        encoder, packer = kept(tokenizer_file, spaces=True), SumOfSquares(capacity, max_open)
        encoder.limit = cache_chunks or encoder.limit
        next_id = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []
        held = 0

        def windows() -> Iterator[list[Piece]]:
            nonlocal id_type
            for batch in batches:
                id_type = batch.column(0).type
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    yield from packer.add(doc_id, encoder.ids(text.as_py(), end_id))
            yield from packer.flush()

        def batch_of() -> pa.RecordBatch:
            kinds = [id_type, *[pa.int64()] * 5, pa.binary()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        id_type = pa.int64()
        for window in windows():
            offset = 0
            for doc_id, start, ids, n in window:
                rows.append((doc_id, start, len(ids), n, next_id, offset, ids.tobytes()))
                offset += len(ids)
            held += offset
            next_id += 1
            if held >= 1 << 20:
                yield batch_of()
                rows.clear()
                held = 0
        if rows:
            yield batch_of()
        encoder.forget()
        release_memory()

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
