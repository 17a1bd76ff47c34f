"""Theta joins on two inequalities, counted without making their pairs."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.session import broadcast_up_to, landed

#: Rows of a slice of an order, about; slices at most.
SLICE, SLICES = 1 << 18, 1024
_SIGNS = {"<": (1, True), "<=": (1, False), ">": (-1, True), ">=": (-1, False)}
_ROW = "id long, x double, y double, side int, slice int, n long"


def theta_counts(left: DataFrame, right: DataFrame, first: tuple[str, str, str], second: tuple[str, str, str]) -> DataFrame:
    """The rows of ``left`` with ``n_matches``: how many rows of ``right`` fulfil both conditions (left column, operator, right column), each one of < <= > >=.

    Columns are numbers, times or dates. Nulls fulfil nothing; repeated rows count each; n_matches is 0 where there is no match.

    Both conditions say that the right row comes after the left one in an order. All rows are dealt to slices of the first order by range, then to slices of the second; equal values are told apart by the row,
    so they fill no slice. The matches of a left row are those in its slice of the first order, counted there; those in its slice of the second one and later slices of the first, counted there;
    and those in later slices of both, which are sums over a table with a cell for each pair of slices. So every row is shuffled twice, whatever the number of pairs, and
    nothing is compared with all of the other side.
    """
    (a, op1, c), (b, op2, d) = first, second
    (s1, strict1), (s2, strict2) = _SIGNS[op1], _SIGNS[op2]
    number = lambda df, col, sign: F.lit(sign) * _number(F.col(col), df.schema[col].dataType.typeName())
    rows = landed(left.withColumn("_id", F.monotonically_increasing_id()), "left")
    l = rows.select(F.col("_id").alias("id"), number(rows, a, s1).alias("x"), number(rows, b, s2).alias("y"), F.lit(0).alias("side"))
    r = right.select(F.monotonically_increasing_id().alias("id"), number(right, c, s1).alias("x"), number(right, d, s2).alias("y"), F.lit(1).alias("side"))
    both = landed(l.unionByName(r).filter("x IS NOT NULL AND y IS NOT NULL"), "both")
    slices = min(SLICES, both.count() // SLICE + 1)
    # of equal values, right rows stand before left ones if equality does not count, and after them if it does
    tie = lambda strict: F.col("side").desc() if strict else F.col("side").asc()

    def by_first(x: np.ndarray, y: np.ndarray, side: np.ndarray, _: np.ndarray) -> np.ndarray:
        return after(np.lexsort((_tie(side, strict1), x)), np.lexsort((_tie(side, strict2), y)), side)

    def by_second(x: np.ndarray, y: np.ndarray, side: np.ndarray, slice_: np.ndarray) -> np.ndarray:
        return after(np.lexsort((_tie(side, True), slice_)), np.lexsort((_tie(side, strict2), y)), side)

    cut = both.repartitionByRange(slices, "x", tie(strict1), "id").withColumn("slice", F.spark_partition_id()).withColumn("n", F.lit(0).cast("long"))
    cut = landed(cut.select("id", "x", "y", "side", "slice", "n").mapInArrow(_counting(by_first), _ROW), "by-first")
    cut = cut.repartitionByRange(slices, "y", tie(strict2), "id").mapInArrow(_counting(by_second), _ROW).withColumn("other", F.spark_partition_id())
    cut = landed(cut.select("id", "side", "slice", "other", "n"), "by-second")
    held = cut.filter("side = 1").groupBy("slice", "other").agg(F.count("*").alias("held"))
    every = cut.sparkSession.range(slices)
    cells = every.select(F.col("id").cast("int").alias("slice")).crossJoin(every.select(F.col("id").cast("int").alias("other"))).join(held, ["slice", "other"], "left")
    later = lambda value, by, order: F.sum(value).over(W.partitionBy(by).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, -1))
    cells = cells.withColumn("_row", later("held", "slice", "other")).withColumn("later", later("_row", "other", "slice"))
    cells = landed(cells.filter("later > 0").select("slice", "other", "later"), "cells")
    lefts = cut.filter("side = 0").join(broadcast_up_to(cells), ["slice", "other"], "left")
    sums = lefts.select(F.col("id").alias("_id"), (F.col("n") + F.coalesce("later", F.lit(0))).alias("_n"))
    return rows.join(sums, "_id", "left").withColumn("n_matches", F.coalesce("_n", F.lit(0)).cast("long")).drop("_id", "_n")


def _tie(side: np.ndarray, strict: bool) -> np.ndarray:
    return -side if strict else side


def _counting(count):
    """A function for mapInArrow that adds ``count`` (of x, y, side and slice of a partition's rows) to n."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        x, y, side, slice_ = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(1, 5))
        found, at = count(x, y, side, slice_), 0
        for b in held:
            n = pa.array(b.column(5).to_numpy() + found[at : at + b.num_rows])
            yield pa.RecordBatch.from_arrays([*b.columns[:5], n], names=["id", "x", "y", "side", "slice", "n"])
            at += b.num_rows

    return run


def after(first: np.ndarray, second: np.ndarray, side: np.ndarray) -> np.ndarray:
    """For each row of side 0 the number of rows of side 1 that come after it in both orders (each the places of the rows in it); 0 for others.

    Rows in the first order are parted stably by the bits of their place in the second one, highest first: at each bit, of the rows that agree in those before, rows with a one come after those with a zero.
    """
    m = len(side)
    counts = np.zeros(m, dtype=np.int64)
    place = np.empty(m, dtype=np.int64)
    place[second] = np.arange(m)
    row = first
    for bit in reversed(range(max(m - 1, 0).bit_length())):
        q = place[row]
        one = (q >> bit & 1).astype(bool)
        start = q >> bit + 1 << bit + 1
        end = np.minimum(start + (2 << bit), m)
        rights = np.concatenate([[0], np.cumsum(one & (side[row] == 1))])
        asks = np.flatnonzero(~one & (side[row] == 0))
        counts[row[asks]] += rights[end[asks]] - rights[asks]
        ones = np.concatenate([[0], np.cumsum(one)])
        before = ones[:m] - ones[start]
        to = np.where(one, start + (1 << bit) + before, np.arange(m) - before)
        moved = np.empty_like(row)
        moved[to] = row
        row = moved
    return counts


def _number(c: Column, kind: str) -> Column:
    """A column as a number in its own order; times as microseconds, which doubles hold exactly for 285 years around 1970."""
    return (F.unix_micros(c.cast("timestamp")) if kind.startswith("timestamp") or kind == "date" else c).cast("double")
