"""Sums of numpy arrays of many tasks, by a tree of rounds."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import written

#: Arrays that one task adds up.
FAN = 16
#: What arrays of different tasks are laid out as: ``slot`` says which array, ``part`` whose part of its sum. Values are packed.
PARTS = "slot long, part long, values binary"
_CODEC = pa.Codec("zstd", 1)


def packed(values: np.ndarray) -> bytes:
    """An array's bytes, compressed, after their number."""
    raw = values.tobytes()
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def unpacked(content: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(_CODEC.decompress(content[8:], int.from_bytes(content[:8], "little"), asbytes=True), dtype=kind)


def parts(slots: list[int], part: int, arrays: list[np.ndarray]) -> pa.RecordBatch:
    """One task's arrays as rows of ``PARTS``."""
    n = len(slots)
    columns = [pa.array(slots, pa.int64()), pa.array([part] * n, pa.int64()), pa.array([packed(a) for a in arrays], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["slot", "part", "values"])


def tree_sum(made: DataFrame, kind: str, name: str, add: Callable[[np.ndarray, int], np.ndarray]) -> DataFrame:
    """slot and values, the sum of all parts of each slot: every round adds up to ``FAN`` parts in a task, until each slot has one.

    ``made``: rows of ``PARTS``, arrays of dtype ``kind``, to be read with unpacked(). ``add``: from arrays (one a row) and their slot their sum, of the same dtype. Every level is written, so
    that a lost executor costs one level at most; a task holds ``FAN`` arrays, however many tasks made some.
    """

    def level(table: pa.Table) -> pa.Table:
        slot = table.column("slot")[0].as_py()
        total = add(np.stack([unpacked(v.as_py(), kind) for v in table.column("values")]), slot)
        return pa.Table.from_batches([parts([slot], table.column("part")[0].as_py(), [total])])

    rest = written(made, f"{name}-parts")
    while (rest.agg(F.max("part")).first()[0] or 0) > 0:
        rest = written(rest.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("slot", "part").applyInArrow(level, PARTS), f"{name}-sums")
    return rest.select("slot", "values")
