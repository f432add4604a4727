"""Harmonic packing of token sequences.

Class k holds the lengths in (capacity / (k + 1), capacity / k], and a bin of class k takes
exactly k of them. A document's whole sequences go first; what is left of it, one piece,
goes to the open bin of its class. A bin that has its k pieces and still has room is filled
up with the beginning of the next document, the only other place where one is cut. So a
worker packs its documents in one pass, with one open bin for each class, and hears nothing
from the others; what its open bins hold at the end is cut into full sequences and, for the
last capacity - 1 tokens at most, into sequences of powers of two. There is no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .workers import claim

BATCH_PIECES = 20_000
#: Sequences are numbered within a worker; its number stands above these bits.
WORKER_SHIFT = 40

#: (key, start, length, ids, tokens of the document)
Piece = tuple[object, int, int, bytes, int]


class Packer:
    """Bins of one worker: documents in, whole sequences (lists of pieces) out."""

    def __init__(self, capacity: int):
        if capacity < 1:
            raise ValueError("capacity must be positive")
        self.capacity = capacity
        self.open: dict[int, list[Piece]] = {}  # class -> fewer pieces than its number
        self.filling: list[Piece] = []  # a bin that has them all and waits for what fills it
        self.gap = 0

    def add(self, key: object, ids: bytes) -> Iterator[list[Piece]]:
        total, at = len(ids) // 4, 0
        if self.gap:
            at = min(self.gap, total)
            self.filling.append((key, 0, at, ids[: 4 * at], total))
            self.gap -= at
            if not self.gap:
                yield self.filling
        while total - at >= self.capacity:
            yield [(key, at, self.capacity, ids[4 * at : 4 * (at + self.capacity)], total)]
            at += self.capacity
        if at < total:
            k = self.capacity // (total - at)
            held = self.open.setdefault(k, [])
            held.append((key, at, total - at, ids[4 * at :], total))
            if len(held) == k:
                del self.open[k]
                self.filling, self.gap = held, self.capacity - sum(p[2] for p in held)
                if not self.gap:
                    yield held

    def finish(self) -> Iterator[list[Piece]]:
        left = (self.filling if self.gap else []) + [p for k in sorted(self.open) for p in self.open[k]]
        full, rest = divmod(sum(p[2] for p in left), self.capacity)
        sizes = [self.capacity] * full + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]
        left.reverse()
        for size in sizes:
            made = []
            while size:
                key, start, length, ids, total = left.pop()
                part = min(length, size)
                made.append((key, start, part, ids[: 4 * part], total))
                if part < length:
                    left.append((key, start + part, length - part, ids[4 * part :], total))
                size -= part
            yield made
        self.open, self.filling, self.gap = {}, [], 0


def pack(docs: DataFrame, path: str, *, capacity: int = 2048, end_id: int = 1, keep_ids: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) of every piece.

    Each document's ids (tokenizer file at path, no special tokens) and end_id are cut into
    pieces; every id lies in one piece, and the pieces of a sequence follow each other
    without a gap. A sequence is full or a power of two long. sequence_id is the worker's
    number, shifted, plus its count of sequences: unique, but not dense. keep_ids adds the
    pieces' own ids (little-endian unsigned 32-bit). Nothing is shuffled; a worker holds a
    batch's pieces and less than one sequence for each class.

    Null text counts as empty and is one piece, end_id alone. Repeated rows, and rows with
    equal or null keys, are packed as separate documents. An empty table gives no piece.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bpe", bpe.codec.cache_clear)
        codec, end, packer = bpe.codec(path), end_id.to_bytes(4, "little"), Packer(capacity)
        number, rows = TaskContext.get().partitionId() << WORKER_SHIFT, []

        def place(sequences: Iterator[list[Piece]]) -> None:
            nonlocal number
            for sequence in sequences:
                offset = 0
                for k, start, length, ids, total in sequence:
                    rows.append((k, start, length, zlib.crc32(ids), total, number, offset, ids if keep_ids else None))
                    offset += length
                number += 1

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                place(packer.add(k, codec.encode(t.as_py()) + end))
                if len(rows) >= BATCH_PIECES:
                    yield out(rows)
                    rows.clear()
        place(packer.finish())
        if rows:
            yield out(rows)
        codec.forget()

    kind = docs.schema[key].dataType
    fields = f"{key} {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * keep_ids
    names = [f.split()[0] for f in fields.split(", ")]
    own = _arrow(docs, key)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [own, *[pa.int64()] * 6, pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind, _ in zip(zip(*rows), kinds, names)], names)

    return docs.select(key, text).mapInArrow(run, fields)


def _arrow(docs: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema[column].dataType)


def report(pieces: DataFrame, *, capacity: int = 2048, short: int = 16) -> DataFrame:
    """One row: pieces, sequences, tokens, padding (of sequences that are no power of two) and
    how many pieces begin a document, are cut, or hold fewer than short tokens."""
    n = F.count(F.lit(1))
    power = F.col("tokens").bitwiseAND(F.col("tokens") - 1) == 0
    sequences = pieces.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), n.alias("n"), *(F.sum(c.cast("long")).alias(a) for c, a in ((F.col("start") == 0, "documents"), (F.col("length") < F.col("doc_tokens"), "cut"), (F.col("length") < short, "short"))))
    padding = F.when(power, 0).otherwise(capacity - F.col("tokens"))
    return sequences.agg(n.alias("sequences"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("documents", "tokens")), F.coalesce(F.sum("n"), F.lit(0)).alias("pieces"), F.coalesce(F.sum(padding), F.lit(0)).alias("padding"), F.coalesce(F.sum("cut"), F.lit(0)).alias("cut"), F.coalesce(F.sum("short"), F.lit(0)).alias("short"))
