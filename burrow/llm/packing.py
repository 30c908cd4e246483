"""Best-fit packing of documents into training sequences (operator 10).

Bounded-space online best-fit: each task holds a fixed number of open bins. Their free spaces are the bits of
one integer, so the fullest bin that a piece fits in is found with a shift and a lowest-set-bit. If a piece
fits nowhere and all bins are in use, the fullest bin closes. Tasks pack what they read, without a shuffle; a
bounded look-ahead of pieces is dealt out longest first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from burrow.llm.tokens import encoder

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class BestFit:
    """Places lengths into bins of `capacity`; at most `bins` are open at a time."""

    def __init__(self, capacity: int, bins: int, first: int = 0):
        self.capacity, self.bins, self.next = capacity, bins, first
        self.free = 0  # bit f is set if an open bin has f places left
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = 0

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset in it) of a piece of 1 to capacity tokens."""
        if fits := self.free >> length:
            free = length + (fits & -fits).bit_length() - 1
            found = self._take(free)
        else:
            if self.open == self.bins:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
            free, found = self.capacity, self.next
            self.next += 1
        if left := free - length:
            self.by_free[left].append(found)
            self.free |= 1 << left
            self.open += 1
        return found, self.capacity - free

    def _take(self, free: int) -> int:
        found = self.by_free[free].pop()
        if not self.by_free[free]:
            self.free &= ~(1 << free)
        self.open -= 1
        return found


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    end_id: int = 0,
    bins: int = 4096,
    look_ahead: int = 65_536,
) -> DataFrame:
    """Every document's tokens and an end token, placed into sequences of at most `capacity` tokens.

    Returns a row per piece: doc_id, piece (from 0), start (the document's ids before it), length, ids_crc32 (of
    its little-endian unsigned 32-bit ids), sequence_id and offset (its place there; a sequence has no gaps).
    Only documents longer than a sequence are cut. A null or empty text is one end token; a null id stays null;
    repeated rows are packed as often as they occur; other columns are not read. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_encoder = encoder(tokenizer_path)
        ids_of = held_encoder.encode
        packer = BestFit(capacity, bins, TaskContext.get().partitionId() << 36)
        end, step = end_id.to_bytes(4, "little"), 4 * capacity
        held: list[tuple] = []
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), ids_of(batch.column(1).to_pylist()), strict=True):
                ids += end
                for at in range(0, len(ids), step):
                    part = ids[at : at + step]
                    held.append((len(part) // 4, doc, at // step, at // 4, zlib.crc32(part)))
            if len(held) >= look_ahead:
                yield placed(packer, held)
                held = []
        held_encoder.rest()
        if held:
            yield placed(packer, held)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def placed(packer: BestFit, held: list[tuple]) -> pa.RecordBatch:
    held.sort(key=lambda x: -x[0])
    rows = [(doc, piece, start, n, crc, *packer.place(n)) for n, doc, piece, start, crc in held]
    kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 5)
    names = [field.split()[0] for field in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
