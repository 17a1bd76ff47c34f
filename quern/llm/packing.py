"""Bounded-space online packing of token ids into sequences.

Each partition keeps a fixed number of open windows. A document longer than a window fills windows of its own; the rest goes where it fits best.
When it fits nowhere and no window may be opened, the fullest is topped up with the piece's first ids and emitted, so an emitted
window has no padding. What a partition leaves open is merged into full windows and one rest; rests are merged in rounds, many partitions to
one task, until one rest is left in all. That one is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import tokens
from quern.llm.common import written

LENGTH = 1024
OPEN = 32
#: Rests merged by one task.
FAN_IN = 64
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long, ids binary, _group long"
_ROUND, _GROUP = 56, 28
_BATCH_IDS = 1_000_000

#: A piece: doc_id, the document's ids before it, all of the document's ids, its own ids.
Piece = tuple[int | None, int, int, np.ndarray]


def _cut(piece: Piece, n: int) -> tuple[Piece, Piece]:
    doc_id, start, total, ids = piece
    return (doc_id, start, total, ids[:n]), (doc_id, start + n, total, ids[n:])


class Packer:
    """Places pieces; ``full`` collects the windows that are done."""

    def __init__(self, length: int = LENGTH, windows: int = OPEN) -> None:
        self.length, self.windows = length, windows
        self.open: list[tuple[int, list[Piece]]] = []
        self.full: list[list[Piece]] = []

    def add(self, piece: Piece) -> None:
        while len(piece[3]) >= self.length:
            whole, piece = _cut(piece, self.length)
            self.full.append([whole])
        while n := len(piece[3]):
            fits = [(self.length - used, k) for k, (used, _) in enumerate(self.open) if used + n <= self.length]
            if fits:
                self._put(min(fits)[1], piece)
                return
            if len(self.open) < self.windows:
                self.open.append((n, [piece]))
                return
            k = max(range(len(self.open)), key=lambda i: self.open[i][0])
            top, piece = _cut(piece, self.length - self.open[k][0])
            self._put(k, top)

    def _put(self, k: int, piece: Piece) -> None:
        used, pieces = self.open[k]
        self.open[k] = (used + len(piece[3]), [*pieces, piece])
        if self.open[k][0] == self.length:
            self.full.append(self.open.pop(k)[1])

    def finish(self) -> list[Piece]:
        """Merges the open windows, fullest first; the pieces of the one rest."""
        left = [p for _, pieces in sorted(self.open, key=lambda w: -w[0]) for p in pieces]
        self.open, self.windows = [], 1
        for piece in left:
            self.add(piece)
        return self.open.pop()[1] if self.open else []


def powers(pieces: list[Piece]) -> Iterator[list[Piece]]:
    """The pieces as windows whose lengths are powers of two, largest first."""
    left, queue = sum(len(p[3]) for p in pieces), list(pieces)
    while left:
        room = 1 << left.bit_length() - 1
        left -= room
        window = []
        while room:
            head, tail = _cut(queue.pop(0), room)
            window.append(head)
            room -= len(head[3])
            if len(tail[3]):
                queue.insert(0, tail)
        yield window


def _rows(windows: Iterable[tuple[int | None, list[Piece]]], group: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Windows as batches of piece rows; a rest has no sequence_id, and always its ids."""
    out: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        kinds = [(name, pa.binary() if kind == "binary" else pa.int64()) for name, kind in (c.split(" ") for c in SCHEMA.split(", "))]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*out), kinds)], names=[n for n, _ in kinds])

    for number, pieces in windows:
        at = 0
        for doc_id, start, total, ids in pieces:
            raw = ids.astype("<u4").tobytes()
            out.append((doc_id, start, len(ids), total, number, at, zlib.crc32(raw), raw if with_ids or number is None else None, group))
            at += len(ids)
        size += at
        if size >= _BATCH_IDS:
            yield batch()
            out, size = [], 0
    if out:
        yield batch()


def pack(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, windows: int = OPEN, with_ids: bool = True) -> DataFrame:
    """Packs all documents. Returns a row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (binary, 32-bit
    little-endian; left out without ``with_ids``), ids_crc32 (of these bytes, unsigned).

    Null texts are empty: the end id alone is packed. Null and repeated doc_ids are packed row by row; of windows that fit a piece equally well the one opened first
    takes it. Very long texts are encoded in parts. Only doc_id and text are read, so other columns cannot clash. No documents: no pieces. Memory: ``windows``
    open windows and one document per task; rests are under one window a partition, merged ``FAN_IN`` to a task. Each round is written
    to the shared folder.
    """

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encoder, packer, number = TaskContext.get().partitionId(), tokens.encoder(vocabulary), Packer(length, windows), 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.ended(text.as_py())
                packer.add((doc_id, 0, len(ids), ids))
                if len(packer.full) >= _BATCH_IDS // length:
                    yield from _rows([(part << _GROUP | number + i, w) for i, w in enumerate(packer.full)], part, with_ids)
                    number, packer.full = number + len(packer.full), []
        rest = packer.finish()
        yield from _rows([*((part << _GROUP | number + i, w) for i, w in enumerate(packer.full)), (None, rest)], part, with_ids)

    def later(turn: int, last: bool):
        def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            group, packer = None, Packer(length, 1)

            def close() -> Iterator[pa.RecordBatch]:
                rest = packer.finish()
                ends = list(powers(rest)) if last else []
                full = [*packer.full, *ends]
                yield from _rows([*((turn << _ROUND | group << _GROUP | i, w) for i, w in enumerate(full)), (None, [] if last else rest)], group, with_ids)

            for batch in batches:
                for row in batch.to_pylist():
                    if group not in (None, row["_group"]):
                        yield from close()
                        packer = Packer(length, 1)
                    group = row["_group"]
                    packer.add((row["doc_id"], row["start"], row["doc_tokens"], np.frombuffer(row["ids"], "<u4")))
            if group is not None:
                yield from close()

        return merge

    done = written(docs.select("doc_id", "text").mapInArrow(first, SCHEMA), "packed")
    tables, turn = [done.filter("sequence_id IS NOT NULL")], 0
    rest = done.filter("sequence_id IS NULL")
    groups = (rest.agg(F.max("_group")).first()[0] or 0) + 1
    while True:
        turn, groups = turn + 1, -(-groups // FAN_IN)
        grouped = rest.withColumn("_from", F.col("_group")).withColumn("_group", F.floor(F.col("_group") / FAN_IN).cast("long"))
        merged = grouped.repartition("_group").sortWithinPartitions("_group", "_from", "offset").drop("_from")
        done = written(merged.mapInArrow(later(turn, groups == 1), SCHEMA), "merged")
        tables.append(done.filter("sequence_id IS NOT NULL"))
        rest = done.filter("sequence_id IS NULL")
        if groups == 1:
            break
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.drop("_group") if with_ids else out.drop("_group", "ids")
