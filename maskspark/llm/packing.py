"""Cost-balanced packing of token ids into sequences.

A piece of n tokens costs linear * n + quadratic * n * n (projections, and attention within the piece). Documents are
taken by windows of bounded size, from the longest remainder down, and each goes to the cheapest sequence that still has
room for it. A remainder that fits nowhere whole is cut at the cheapest sequences' free places, so that sequences fill.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import Encoder, crc, default_vocabulary

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_length long, cost double, ids binary"
)


@dataclass(slots=True)
class Piece:
    """Tokens start to start + length of a document; ids are the document's, four bytes each."""

    doc_id: int | None
    ids: bytes
    start: int
    length: int

    def cut(self, length: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.ids, self.start, length), Piece(self.doc_id, self.ids, self.start + length, self.length - length)


def assign(pieces: list[Piece], capacity: int, linear: float, quadratic: float) -> tuple[list[list[Piece]], list[Piece]]:
    """Full sequences of the pieces, and the pieces (less than capacity tokens together) that are left over."""
    count = sum(p.length for p in pieces) // capacity
    if not count:
        return [], pieces
    room, cost = np.full(count, capacity), np.zeros(count)
    bins: list[list[Piece]] = [[] for _ in range(count)]
    left: list[Piece] = []

    def put(piece: Piece, k: int) -> None:
        bins[k].append(piece)
        room[k] -= piece.length
        cost[k] += linear * piece.length + quadratic * piece.length**2

    for piece in sorted(pieces, key=lambda p: -p.length):  # sorted() keeps the order of equal lengths
        fits = room >= piece.length
        if fits.any():
            put(piece, int(np.argmin(np.where(fits, cost, np.inf))))
            continue
        while piece.length and (free := room > 0).any():
            k = int(np.argmin(np.where(free, cost, np.inf)))
            head, piece = piece.cut(min(piece.length, int(room[k])))
            put(head, k)
        if piece.length:
            left.append(piece)
    return bins, left


def powers(pieces: list[Piece]) -> list[list[Piece]]:
    """The last pieces as sequences whose lengths are powers of two, which need no padding."""
    out, todo = [], list(pieces)
    total = sum(p.length for p in pieces)
    for bit in reversed(range(total.bit_length())):
        if not total >> bit & 1:
            continue
        need, own = 1 << bit, []
        while need:
            piece = todo.pop(0)
            if piece.length > need:
                piece, rest = piece.cut(need)
                todo.insert(0, rest)
            own.append(piece)
            need -= piece.length
        out.append(own)
    return out


def pack(documents: Iterator[tuple[int | None, bytes]], capacity: int, window_tokens: int, linear: float, quadratic: float) -> Iterator[list[Piece]]:
    """Sequences of a stream of (doc_id, ids)."""
    held: list[Piece] = []
    tokens = 0
    for doc_id, ids in documents:
        n = len(ids) // 4
        whole = n - n % capacity
        for start in range(0, whole, capacity):
            yield [Piece(doc_id, ids, start, capacity)]
        if n > whole:
            held.append(Piece(doc_id, ids, whole, n - whole))
            tokens += n - whole
        if tokens >= window_tokens:
            bins, held = assign(held, capacity, linear, quadratic)
            yield from bins
            tokens = sum(p.length for p in held)
    bins, held = assign(held, capacity, linear, quadratic)
    yield from bins
    yield from powers(held)


def pack_sequences(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    vocabulary: str | None = None,
    capacity: int = 2048,
    end_id: int = 1,
    window_tokens: int = 1 << 18,
    linear: float = 1.0,
    quadratic: float = 1 / 2048,
    with_ids: bool = True,
) -> DataFrame:
    """Pieces of all documents with the sequence and the place that each has.

    Every partition packs its own documents where they lie: no shuffle, and memory holds one window. Sequences reach
    capacity exactly, but for those with a partition's last tokens, whose lengths are powers of two. sequence_id is the
    partition's number times 2^33 plus a counter.

    Null and empty texts are documents with the end id alone. Equal rows are separate documents. A null doc_id stays null.
    An empty table gives no rows. Other columns of the input, whatever their names, are not read.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of this task alone: the worker goes on to other stages, and would hold its memory there
        encode, end = Encoder(path).encode, int(end_id).to_bytes(4, "little")
        base = TaskContext.get().partitionId() << 33

        def documents():
            for batch in batches:
                for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                    yield k, encode(t.as_py()) + end

        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "cost", "ids"]
        types = [pa.int64()] * 8 + [pa.float64(), pa.binary()]
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [()] * len(names)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for number, sequence in enumerate(pack(documents(), capacity, window_tokens, linear, quadratic)):
            offset, length = 0, sum(p.length for p in sequence)
            for p in sequence:
                ids = p.ids[4 * p.start : 4 * (p.start + p.length)]
                price = linear * p.length + quadratic * p.length**2
                rows.append((p.doc_id, p.start, p.length, crc(ids), len(p.ids) // 4, base + number, offset, length, price, ids if with_ids else None))
                offset += p.length
            if len(rows) >= 2000:
                yield flush()
        if rows:
            yield flush()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCHEMA)
