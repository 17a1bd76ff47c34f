"""Token ids in directly addressable codes.

An id is cut into chunks of eight bits, the lowest first. Level 0 holds the lowest chunk of every id; a bitmap says which ids go
on, and level 1 holds the next chunk of those only, and so forth. A rank directory (ones before each block of 512 bits) tells where
an id's next chunk is, so that any id is read with one look at each level and nothing around it is decoded.

A file: the magic line, the header's length (4 bytes), the header (JSON: counts and the place of every section), then the
sections, each at a multiple of 8 bytes: ids of documents and where each starts, and codes, bitmap and ranks of each level.
All numbers are little-endian.
"""

from __future__ import annotations

import json
import mmap
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm import tokens
from quern.llm.common import join_small, written
from quern.llm.stores import put
from quern.session import shared_dir

MAGIC = b"QUERN-DAC 1\n"
BITS = 8
BLOCK = 512
#: A file is closed once it holds so many ids.
FILE_IDS = 4_000_000


def levels(ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Codes, bitmap and ranks of each level."""
    left = ids.astype(np.uint32)
    while True:
        more = left >> BITS
        on = more > 0
        bitmap = np.packbits(on, bitorder="little")
        padded = np.zeros(-(-len(left) // BLOCK) * BLOCK // 8, dtype=np.uint8)
        padded[: len(bitmap)] = bitmap
        ones = np.bitwise_count(padded.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint64)
        yield (left & 0xFF).astype(np.uint8), padded, np.concatenate([[0], np.cumsum(ones)]).astype(np.uint64)
        if not on.any():
            return
        left = more[on]


def pack(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """One file's bytes."""
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.uint64)
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    parts = {"doc_ids": np.array([d or 0 for d in doc_ids], dtype=np.int64), "known": known, "starts": starts}
    depth = 0
    for depth, (codes, bitmap, ranks) in enumerate(levels(flat), 1):
        parts |= {f"codes{depth - 1}": codes, f"bitmap{depth - 1}": bitmap, f"ranks{depth - 1}": ranks}
    places, at = {}, 0
    for name, part in parts.items():
        places[name] = [at, len(part), part.dtype.str]
        at += -(-part.nbytes // 8) * 8
    header = json.dumps({"n_docs": len(doc_ids), "n_ids": len(flat), "levels": depth, "places": places}).encode()
    header += b" " * (-(len(MAGIC) + 4 + len(header)) % 8)
    body = b"".join(part.tobytes() + b"\0" * (-part.nbytes % 8) for part in parts.values())
    return MAGIC + len(header).to_bytes(4, "little") + header + body


class Codes:
    """Reads a file's bytes (or a memory map of them) in place."""

    def __init__(self, data: bytes | memoryview) -> None:
        view = memoryview(data)
        if bytes(view[: len(MAGIC)]) != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        start = len(MAGIC) + 4
        length = int.from_bytes(view[len(MAGIC) : start], "little")
        self.header = json.loads(bytes(view[start : start + length]))
        self.n_docs, self.n_ids, self.depth = (self.header[k] for k in ("n_docs", "n_ids", "levels"))
        base = start + length
        self.part = {
            name: np.frombuffer(view, dtype=np.dtype(kind), count=n, offset=base + at) for name, (at, n, kind) in self.header["places"].items()
        }

    def rank(self, level: int, i: int) -> int:
        """Ones before bit i of a level's bitmap: one directory entry and at most a block's bytes."""
        block, bitmap = i // BLOCK, self.part[f"bitmap{level}"]
        whole = bitmap[block * BLOCK // 8 : i // 8]
        ones = int(self.part[f"ranks{level}"][block]) + int(np.bitwise_count(whole).sum())
        return ones + (int(bitmap[i // 8]) & ((1 << i % 8) - 1)).bit_count() if i % 8 else ones

    def token(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value, level = 0, 0
        while True:
            value |= int(self.part[f"codes{level}"][i]) << BITS * level
            if not self.part[f"bitmap{level}"][i // 8] >> i % 8 & 1:
                return value
            i, level = self.rank(level, i), level + 1

    def tokens(self, start: int, end: int, level: int = 0) -> np.ndarray:
        """The ids from start up to end: those that go on are neighbours in the next level too."""
        found = self.part[f"codes{level}"][start:end].astype(np.uint32)
        if end > start and level + 1 < self.depth:
            first = start // 8
            on = np.unpackbits(self.part[f"bitmap{level}"][first : -(-end // 8)], bitorder="little")[start - 8 * first : end - 8 * first].astype(bool)
            if on.any():
                place = self.rank(level, start)
                found[on] |= self.tokens(place, place + int(on.sum()), level + 1) << BITS
        return found

    def document(self, k: int) -> tuple[int | None, int, np.ndarray]:
        """Document k: its id, its start and its ids."""
        start, end = int(self.part["starts"][k]), int(self.part["starts"][k + 1])
        return (int(self.part["doc_ids"][k]) if self.part["known"][k] else None), start, self.tokens(start, end)


def open_file(path: str) -> Codes:
    """A file on this machine, mapped into memory: reading a token touches the pages that it lies on."""
    with open(path, "rb") as file:
        return Codes(memoryview(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)))


def write(docs: DataFrame, folder: str, vocabulary: str | None = None, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the ids of all documents to files in ``folder``, in ascending doc_id order over the files' names.

    Returns the manifest: file, part, n_docs, n_ids (a row per file). Documents are dealt by ranges of doc_id and then of the text's
    hash, so that one id with many rows is split too; null ids come first, repeated rows stay. Null texts are empty (the end id
    only). Very long texts are encoded in parts. Only doc_id and text are read, so other columns cannot clash. No documents: no files. A task encodes and writes its range; if it is repeated, it replaces its files by equal ones.
    """
    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_h", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_h").asc()]

    def save(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encoder, rows, held = TaskContext.get().partitionId(), tokens.encoder(vocabulary), [], []

        def close() -> None:
            name = f"part-{part:06d}-{len(rows):04d}.dac"
            put(folder, name, pack([d for d, _ in held], [x for _, x in held]))
            rows.append({"file": name, "part": part, "n_docs": len(held), "n_ids": sum(len(x) for _, x in held)})
            held.clear()

        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.append((doc_id, ids := encoder.ended(text.as_py())))
                size += len(ids)
                if size >= file_ids:
                    close()
                    size = 0
        if held:
            close()
        if rows:
            yield pa.RecordBatch.from_pylist(rows)

    dealt = ordered.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return written(dealt.mapInArrow(save, "file string, part long, n_docs long, n_ids long"), "manifest")


def read(manifest: DataFrame, folder: str, with_ids: bool = True) -> DataFrame:
    """Every document in the files: doc_id, start (ids before it in all files), n_tokens, ids (binary, 32-bit little-endian; left out
    without ``with_ids``), ids_crc32 (of these bytes, unsigned).

    Files' starts are summed within a writing task's files, then over tasks (a row each).
    """
    spark = manifest.sparkSession
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("_all"))
    before = lambda w: F.coalesce(F.sum(F.col("n")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("n", F.col("_all")).select("part", before(W.orderBy("part")).alias("_before"))
    bases = manifest.withColumn("n", F.col("n_ids")).withColumn("_in", before(W.partitionBy("part").orderBy("file")))
    bases = written(bases.join(parts, "part").select("file", (F.col("_before") + F.col("_in")).alias("base")), "bases")

    def load(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                codes, name = Codes(content.as_buffer()), path.rpartition("/")[2]
                for k in range(0, codes.n_docs, 500):
                    found = [codes.document(i) for i in range(k, min(k + 500, codes.n_docs))]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "file": [name] * len(found),
                            "doc_id": pa.array([d for d, _, _ in found], pa.int64()),
                            "at": pa.array([s for _, s, _ in found], pa.int64()),
                            "n_tokens": pa.array([len(x) for _, _, x in found], pa.int64()),
                            "ids_crc32": pa.array([crc(x) for _, _, x in found], pa.int64()),
                            "ids": pa.array([x.astype("<u4").tobytes() if with_ids else None for _, _, x in found], pa.binary()),
                        }
                    )

    columns = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary").select(*columns)
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    loaded = files.mapInArrow(load, "file string, doc_id long, at long, n_tokens long, ids_crc32 long, ids binary")
    return join_small(loaded, bases, "file").withColumn("start", F.col("base") + F.col("at")).select(*columns)


def round_trip(docs: DataFrame, vocabulary: str | None = None, with_ids: bool = True) -> DataFrame:
    """Writes all documents to a new shared folder and reads them back."""
    folder = shared_dir(docs.sparkSession, "dac")
    return read(write(docs, folder, vocabulary), folder, with_ids)


def crc(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as 32-bit little-endian numbers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
