"""Sum-of-squares online packing of documents into fixed windows of token ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafgrain.llm.common import materialize, small_batches, texts_of
from leafgrain.llm.tokens import word_encoder

CAPACITY = 2048
END_ID = 1
#: Open windows of a task, at most: 16 MB of ids.
OPEN_WINDOWS = 2048
#: A piece inside a window: row of the document, first id, its ids as little-endian 32-bit bytes.
Piece = tuple[int, int, bytes]


class LevelPacker:
    """Places one piece after another into the partial windows of one task.

    ``levels[h]`` counts the open windows filled to ``h``. A piece of size ``s`` goes to the level (0: a new window)
    for which the sum of the squared counts grows least; of equals, to the fullest. Open windows are kept by level, so
    memory is their ids only. Sizes of which no two fit together would leave a window open for each piece: at ``most``
    open windows all are joined by cutting, which leaves one.
    """

    def __init__(self, capacity: int, most: int = OPEN_WINDOWS):
        self.capacity, self.most, self.held = capacity, most, 0
        self.levels = np.zeros(capacity + 1, np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(capacity)]

    def level_for(self, size: int) -> int:
        top = self.capacity - size
        before, after = self.levels[:top + 1], self.levels[size:]
        growth = 2 * (after - before) + 2
        growth[top] = 1 - 2 * before[top]  # a full window is no longer counted
        growth[0] = 2 * after[0] + 1 if top else 0
        growth[1:][before[1:] == 0] = np.iinfo(np.int64).max
        return int(top - np.argmin(growth[::-1]))

    def place(self, piece: Piece) -> list[Piece] | None:
        """Returns the window that the piece filled, if it did."""
        size = len(piece[2]) // 4
        if size == self.capacity:
            return [piece]
        level = self.level_for(size)
        window = self.open[level].pop() if level else []
        self.levels[level] -= bool(level)
        self.held -= bool(level)
        window.append(piece)
        if level + size == self.capacity:
            return window
        self.keep(window, level + size)
        return None

    def keep(self, window: list[Piece], level: int) -> None:
        self.open[level].append(window)
        self.levels[level] += 1
        self.held += 1

    def relieve(self) -> Iterator[list[Piece]]:
        """The full windows that joining gives once ``most`` are open; a partial one stays open."""
        if self.held < self.most:
            return
        for window in self.close():
            size = sum(len(p[2]) for p in window) // 4
            if size == self.capacity:
                yield window
            else:
                self.keep(window, size)

    def close(self) -> Iterator[list[Piece]]:
        """Fills the fullest open windows from the emptiest, cutting pieces; at most one stays partial."""
        left = [w for level in self.open for w in level]
        self.levels[:] = 0
        self.open, self.held = [[] for _ in range(self.capacity)], 0
        first, last = 0, len(left) - 1
        while last >= first:
            window = left[last]
            room = self.capacity - sum(len(p[2]) for p in window) // 4
            while room and first < last:
                row, start, ids = left[first][-1]
                moved = ids[:room * 4]
                window.append((row, start, moved))
                room -= len(moved) // 4
                if len(moved) < len(ids):
                    left[first][-1] = (row, start + len(moved) // 4, ids[len(moved):])
                else:
                    left[first].pop()
                    first += not left[first]
            last -= 1
            yield window


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Cuts and packs every document; a row per piece.

    (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids array<int>]). A document is its ids and
    ``end_id``. Runs of ``capacity`` ids fill windows of their own; the rest is placed by the sum-of-squares rule among
    the open windows of its task, and what is open at the end of a task is joined by cutting, so a task leaves at most
    one partial window. No rows are shuffled: only each task's number of windows is, and their prefix sums number the
    sequences without gaps.

    Null text is the empty text (one piece with ``end_id``). Repeated rows and null ids are documents of their own. A
    text of any length is cut into whole windows. An empty table gives no rows; other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer, end = word_encoder(tokenizer_path), LevelPacker(capacity), np.uint32(end_id).tobytes()
        part, known = TaskContext.get().partitionId(), {}
        made = windows = 0
        rows: list[tuple] = []

        def emit(window: list[Piece]) -> None:
            nonlocal windows
            offset = 0
            for row, start, ids in window:
                doc_id, total, pending = known[row]
                rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), total, part, windows, offset, np.frombuffer(ids, "<i4") if with_ids else None))
                offset += len(ids) // 4
                if pending == len(ids) // 4:
                    del known[row]
                else:
                    known[row] = (doc_id, total, pending - len(ids) // 4)
            windows += 1

        def flush() -> pa.RecordBatch:
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "window", "offset", "ids"]
            kinds = [id_type, *[pa.int64()] * 4, pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
            rows.clear()
            return out if with_ids else out.select(names[:-1])

        id_type = None
        for batch in small_batches(batches, "text"):
            id_type = batch.schema.field(0).type
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts_of(batch.column(1)))):
                ids += end
                total, step = len(ids) // 4, capacity * 4
                known[made] = (doc_id, total, total)
                for at in range(0, len(ids), step):
                    if done := packer.place((made, at // 4, ids[at:at + step])):
                        emit(done)
                    for done in packer.relieve():
                        emit(done)
                made += 1
            if rows:
                yield flush()
        for window in packer.close():
            emit(window)
            if len(rows) >= 10_000:
                yield flush()
        if rows:
            yield flush()

    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, part int, window bigint, offset bigint"
    pieces = materialize(docs.mapInArrow(run, schema + (", ids array<int>" if with_ids else "")), "packed")
    counts = pieces.groupBy("part").agg((F.max("window") + 1).alias("_n"))
    # One small row for each task that packed.
    bases = counts.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_base"))
    return pieces.join(bases, "part").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("_base") + F.col("window")).alias("sequence_id"), "offset",
        *(["ids"] if with_ids else []))
