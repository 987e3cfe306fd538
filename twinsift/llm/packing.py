"""Packing documents into training sequences: harmonic classes, filled by each worker on its own.

A document of more than C tokens (C: the capacity) gives whole sequences first; what remains of it, like
every shorter document, stays in one piece wherever it can. Its class is k if its length lies in
(C/(k+1), C/k], and a bin of class k takes exactly k such documents. Such a bin is short of C by at most
C/(k+1). Short bins wait for later documents: one that fits into the room of a waiting bin goes there
whole; one that no bin can hold, but all together can, is cut at their borders. A cut fills a bin, so
there are never more cuts than sequences.

Every task fills the bins of its own rows. It keeps at most one open bin per class, of which there are
fewer than 2 sqrt(C), and ``MOST_SHORT`` waiting ones; when there are as many, the next document is cut
into them in any case. What is left at the end of a task is laid end to end, cut only at the ends of
sequences, and the last sequence is split into parts whose lengths are powers of two. Sequences are
padded to C unless their length is a power of two, so no padding arises at all. No row is shuffled.

Null texts are empty ones, an empty text is its end id alone, repeated rows are packed each, and an
empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.llm.encode import encoder, share_tokenizer
from twinsift.llm.session import give_back, string

CAPACITY = 4096
# Most bins of a task that have all their documents and wait for something to fill their room.
MOST_SHORT = 64
# Sequence numbers of a task start at its partition number shifted by this much.
_TASK_BITS = 38
_COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]


def cut(length: int, capacity: int) -> list[int]:
    """Lengths of unpadded sequences for what is left: whole ones, then the binary digits of the rest."""
    rest = length % capacity
    return [capacity] * (length // capacity) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


class _Bin:
    def __init__(self, room: int):
        self.room, self.pieces = room, []

    def put(self, doc, start: int, length: int) -> None:
        self.pieces.append((doc, start, length))
        self.room -= length


class Bins:
    """The bins of one task. ``add`` and ``finish`` return placed pieces: (doc, start, length, sequence, offset)."""

    def __init__(self, task: int, capacity: int, most_short: int = MOST_SHORT):
        self.capacity, self.most_short, self.next = capacity, most_short, task << _TASK_BITS
        self.open: dict[int, _Bin] = {}
        self.short: list[_Bin] = []

    def add(self, doc, start: int, length: int) -> list[tuple]:
        end, out = start + length, []
        while end - start >= self.capacity:
            out += self._place([(doc, start, self.capacity)])
            start += self.capacity
        for room in self._rooms(end - start):
            taken = min(room.room, end - start)
            room.put(doc, start, taken)
            start += taken
            if not room.room:
                self.short.remove(room)
                out += self._place(room.pieces)
        return out + self._classed(doc, start, end - start) if start < end else out

    def _rooms(self, length: int) -> list[_Bin]:
        """The waiting bins that take a document: the tightest one that holds it, or several, widest first."""
        if not length:
            return []
        if fits := [b for b in self.short if b.room >= length]:
            return [min(fits, key=lambda b: b.room)]
        if len(self.short) < self.most_short and sum(b.room for b in self.short) < length:
            return []
        taken, used = [], 0
        for waiting in sorted(self.short, key=lambda b: -b.room):
            if used >= length:
                break
            taken.append(waiting)
            used += waiting.room
        return taken

    def _classed(self, doc, start: int, length: int) -> list[tuple]:
        k = self.capacity // length
        held = self.open.setdefault(k, _Bin(self.capacity))
        held.put(doc, start, length)
        if len(held.pieces) < k:
            return []
        del self.open[k]
        if not held.room:
            return self._place(held.pieces)
        self.short.append(held)
        return []

    def _place(self, pieces: list[tuple]) -> list[tuple]:
        sequence, offset, out = self.next, 0, []
        self.next += 1
        for doc, start, length in pieces:
            out.append((doc, start, length, sequence, offset))
            offset += length
        return out

    def finish(self) -> list[tuple]:
        bins = self.short + [self.open[k] for k in sorted(self.open)]
        left = [piece for held in bins for piece in held.pieces][::-1]
        out = []
        for size in cut(sum(length for _, _, length in left), self.capacity):
            sequence = _Bin(size)
            while sequence.room:
                doc, start, length = left.pop()
                taken = min(sequence.room, length)
                sequence.put(doc, start, taken)
                if taken < length:
                    left.append((doc, start + taken, length - taken))
            out += self._place(sequence.pieces)
        self.open, self.short = {}, []
        return out


def pack(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 2, with_ids: bool = False
) -> DataFrame:
    """``docs(doc_id, text)`` -> one row per piece, with its place in a sequence and, if asked, its ids."""
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    tokenizer = share_tokenizer(docs.sparkSession, tokenizer_path)
    kinds = [pa.int64()] * 7 + ([pa.binary()] if with_ids else [])
    names = _COLUMNS if with_ids else _COLUMNS[:-1]

    def batch_of(placed: list[tuple]) -> pa.RecordBatch:
        rows = []
        for (doc_id, ids, first, total), start, length, sequence, offset in placed:
            own = ids[4 * (start - first) : 4 * (start - first + length)]
            row = (doc_id, start, length, zlib.crc32(own), total, sequence, offset)
            rows.append((*row, bytes(own)) if with_ids else row)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        bins = Bins(TaskContext.get().partitionId(), capacity)
        for batch in batches:
            placed: list[tuple] = []
            doc_ids = batch.column(0).to_pylist()
            for first, last, ids, bounds in encode.encode(batch.column(1), end_id):
                raw = memoryview(ids.astype("<u4").tobytes())
                for k, doc_id in enumerate(doc_ids[first:last]):
                    own = raw[4 * int(bounds[k]) : 4 * int(bounds[k + 1])]
                    total = len(own) // 4
                    whole = total - total % capacity
                    if whole:
                        placed += bins.add((doc_id, own, 0, total), 0, whole)
                    # What waits in a bin owns its ids, so no block is kept alive by it.
                    if whole < total:
                        placed += bins.add((doc_id, bytes(own[4 * whole :]), whole, total), whole, total - whole)
            if placed:
                yield batch_of(placed)
        if placed := bins.finish():
            yield batch_of(placed)
        give_back()

    schema = ", ".join(f"{name} bigint" for name in _COLUMNS[:-1]) + (", ids binary" if with_ids else "")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), string("text").alias("text")).mapInArrow(run, schema)


def sequences(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Whole sequences from pieces with ids: ``sequence_id``, ``length``, ``padded`` and the ids as bytes.

    A group is one sequence, so it never holds more than ``capacity`` ids.
    """
    placed = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id", "start")))
    whole = pieces.groupBy("sequence_id").agg(placed.alias("_p"), F.sum("length").alias("length"))
    joined = F.aggregate("_p", F.lit(b""), lambda out, p: F.concat(out, p["ids"]))
    power = F.col("length").bitwiseAND(F.col("length") - 1) == 0
    return whole.select(
        "sequence_id",
        "length",
        F.when(power, F.col("length")).otherwise(F.lit(capacity).cast("bigint")).alias("padded"),
        F.transform("_p", lambda p: F.struct(p["doc_id"], p["start"], p["offset"])).alias("pieces"),
        joined.alias("ids"),
    )
