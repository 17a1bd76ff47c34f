"""Sub-directions found in the texts: sets of terms that a given share of the documents have together.

Documents are dealt evenly to shards of about ``SHARD_ROWS`` rows, and a shard keeps one bit a row for each frequent term. A set that has its share of all rows has it in one
shard at least, so every shard names the sets that have it there, grown depth first; what all shards name is then counted in every shard. Shards are bounded in rows whatever terms
their documents have, so a term that nearly all documents share fills no task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import text as topics
from quern.session import broadcast_up_to, landed

#: Rows to a shard, about; sets that are sent to tasks to be counted at once, about; sets counted in one step of a task.
SHARD_ROWS, LOT, _STEP = 8192, 200_000, 4096
#: Shares in per cent: a term or set is frequent from the first on; a term that more documents have than the second tells no direction apart. Terms in a set at most.
PERCENT, COMMON, MOST = 5, 30, 3


def term_sets(docs: DataFrame, percent: int = PERCENT, common: int = COMMON, most: int = MOST, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """terms (array, in order) and n_docs of all sets of 1 to ``most`` frequent terms that ``percent`` of the documents have at least. Only ``text`` is read.

    Every row is a document, repeated ones too; null and empty texts are documents without terms. No documents: no sets. There can't be more frequent terms than
    100 / percent times the average number of different terms in a document, however many documents there are.
    """
    dealt = landed(docs.select(F.monotonically_increasing_id().alias("row"), topics.terms(F.col("text")).alias("terms")), "terms")
    n = dealt.count()
    least = max(1, -(-n * percent // 100))
    items = _frequent(dealt, least, n * common // 100)
    shards = _shards(dealt, items, -(-n // shard_rows) or 1)
    held = shards.agg(F.sum("n_rows")).first()[0] or 0
    named = landed(shards.mapInArrow(_namer(least, held, most), "items array<int>").distinct(), "named")
    lots = named.count() // LOT + 1
    found = [_counted(shards, named.filter(F.pmod(F.xxhash64("items"), F.lit(lots)) == k)) for k in range(lots)]
    counted = found[0]
    for more in found[1:]:
        counted = counted.unionByName(more)
    enough = counted.filter(F.col("n_docs") >= least).select("items", "n_docs", F.explode("items").alias("item"))
    terms = enough.join(broadcast_up_to(items.select("item", "term")), "item").groupBy("items", "n_docs").agg(F.sort_array(F.collect_list("term")).alias("terms"))
    return terms.select("terms", "n_docs")


def closed(sets: DataFrame) -> DataFrame:
    """The sets that are in no other one with one term more and as many documents: what only repeats a part of a larger set is left out."""
    parts = sets.filter(F.size("terms") > 1).select("terms", "n_docs", F.explode(F.sequence(F.lit(0), F.size("terms") - 1)).alias("out"))
    less = parts.select(F.filter("terms", lambda t, k: k != F.col("out")).alias("terms"), "n_docs")
    return sets.join(less.distinct(), ["terms", "n_docs"], "left_anti")


def hot(docs: DataFrame, k: int, percent: int = PERCENT, common: int = COMMON, most: int = MOST) -> DataFrame:
    """The k sub-directions that most documents have: closed sets of two terms at least, as rank, direction (terms with blanks between them) and n_docs. Ties go to the smaller name."""
    named = closed(landed(term_sets(docs, percent, common, most), "sets")).filter(F.size("terms") > 1).select(F.concat_ws(" ", "terms").alias("direction"), "n_docs")
    first = named.orderBy(F.desc("n_docs"), "direction").limit(k)
    return first.select(F.row_number().over(W.orderBy(F.desc("n_docs"), "direction")).alias("rank"), "direction", "n_docs")


def _frequent(dealt: DataFrame, least: int, most: int) -> DataFrame:
    """term, n_docs and item (a number in the order of terms) of the terms that so many documents have."""
    counts = dealt.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_docs"))
    return landed(counts.filter(F.col("n_docs").between(least, most)).withColumn("item", F.row_number().over(W.orderBy("term")) - 1), "items")


def _shards(dealt: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """Of each shard that has frequent terms: n_rows (rows with some), its items in order, and for each of them one bit a row, whole 64-bit words together."""

    def packed(rows: pa.Table) -> pa.Table:
        there, place = np.unique(rows["row"].to_numpy(), return_inverse=True)
        own, at = np.unique(rows["item"].to_numpy(), return_inverse=True)
        bits = np.zeros((len(own), -(-len(there) // 64) * 64), dtype=bool)
        bits[at, place] = True
        columns = {"n_rows": pa.array([len(there)], pa.int64()), "items": pa.array([own.tolist()], pa.list_(pa.int32())), "bits": pa.array([np.packbits(bits, axis=1).tobytes()], pa.binary())}
        return pa.table(columns)

    rows = dealt.select("row", F.explode("terms").alias("term")).join(broadcast_up_to(items), "term")
    shard = F.pmod(F.xxhash64("row"), F.lit(n))
    return landed(rows.select("row", "item", shard.alias("shard")).groupBy("shard").applyInArrow(packed, "n_rows long, items array<int>, bits binary"), "shards")


def _opened(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """n_rows, items and words (items x words) of each shard."""
    for batch in batches:
        for n_rows, items, bits in zip(*(batch.column(c) for c in ("n_rows", "items", "bits"))):
            own = np.array(items.as_py(), dtype=np.int32)
            yield n_rows.as_py(), own, np.frombuffer(bits.as_py(), dtype=np.uint64).reshape(len(own), -1)


def _sizes(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words).sum(axis=-1, dtype=np.int64)


def _grown(words: np.ndarray, items: np.ndarray, least: int, most: int, before: tuple = ()) -> Iterator[tuple]:
    """All sets of ``before`` and 1 to ``most`` of the items; ``words``: the rows that each item shares with ``before``, ``least`` of them at least."""
    for k, item in enumerate(items):
        grown = *before, int(item)
        yield grown
        if most > 1:
            shared = words[k + 1 :] & words[k]
            enough = _sizes(shared) >= least
            yield from _grown(shared[enough], items[k + 1 :][enough], least, most - 1, grown)


def _namer(least: int, held: int, most: int):
    """A function for mapInArrow that gives the sets that have their share of a shard's rows, where ``least`` of ``held`` is the share of all."""

    def named(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n_rows, items, words in _opened(batches):
            here = -(-least * n_rows // held)
            enough = _sizes(words) >= here
            sets = []
            for grown in _grown(words[enough], items[enough], here, most):
                sets.append(grown)
                if len(sets) == LOT:
                    yield _lists(sets)
                    sets = []
            yield _lists(sets)

    return named


def _lists(sets: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(sets, pa.list_(pa.int32()))], names=["items"])


def _counted(shards: DataFrame, lot: DataFrame) -> DataFrame:
    """items and n_docs of the sets of a lot, counted in all shards; a task adds up its shards' counts before it gives them out. Only a lot comes to the driver."""
    sets = [tuple(r.items_) for r in lot.select(F.col("items").alias("items_")).collect()]
    wide = max(map(len, sets), default=1)
    # a set's last item is repeated, which changes no count
    asked = shards.sparkSession.sparkContext.broadcast(np.array([s + s[-1:] * (wide - len(s)) for s in sets], dtype=np.int32).reshape(-1, wide))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = asked.value
        n = np.zeros(len(sets), dtype=np.int64)
        for _, items, words in _opened(batches):
            at = np.minimum(np.searchsorted(items, sets), len(items) - 1)
            there = np.flatnonzero((items[at] == sets).all(axis=1))
            for start in range(0, len(there), _STEP):
                some = there[start : start + _STEP]
                shared = words[at[some, 0]]
                for column in range(1, sets.shape[1]):
                    shared &= words[at[some, column]]
                n[some] += _sizes(shared)
        for start in range(0, len(sets), LOT):
            some = np.flatnonzero(n[start : start + LOT]) + start
            lists = pa.ListArray.from_arrays(np.arange(len(some) + 1, dtype=np.int32) * sets.shape[1], pa.array(sets[some].ravel()))
            yield pa.RecordBatch.from_arrays([lists, pa.array(n[some])], names=["items", "n"])

    sums = shards.select("n_rows", "items", "bits").mapInArrow(count, "items array<int>, n long").groupBy("items").agg(F.sum("n").alias("n_docs"))
    return sums.select(F.array_distinct("items").alias("items"), "n_docs")
