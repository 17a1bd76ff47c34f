"""Exact duplicates by a tree-merge of sorted digest runs.

Every partition sorts its texts' digests to a run. Then partitions exchange runs in rounds, as in a binomial tree: in round r the ``FAN`` partitions whose numbers
differ in digit r (to the base ``FAN``) deal their runs among themselves by digit r of the digest's hash, and each merges the pieces it gets. After the last
round all entries of a digest have met, and at every level those that met before are one entry already: the smallest identifier in the operator's
order, verified on all 256 bits of the digest, and the number of rows it stands for. So a text with very many copies is a row of each run at most, and no run ever
lies in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import rows_up_to, BROADCAST_ROWS, written

#: Partitions that exchange runs in a round.
FAN = 4
#: Rows to a partition, about; rounds at least and at most.
ROWS, LEAST, MOST = 1 << 16, 2, 6
_ENTRY = "at long, sha binary, doc_id long, place long, n long"


def digest(text: bytes) -> bytes:
    """SHA-256 of a text with A-Z lowered."""
    return hashlib.sha256(text.lower()).digest()  # of bytes only A-Z have other forms


def digests(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` as ``row``, with doc_id and sha of the whole text. Null texts count as empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([digest(t.as_py()) for t in batch.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], names=["row", "doc_id", "sha"])

    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = docs.select(F.struct(*keep).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return slim.mapInArrow(run, slim.select("row", "doc_id", F.col("text").alias("sha")).schema)


def merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries sorted by digest, then by the operator's order, as one entry a digest: the first, with all their rows. Compares whole digests."""
    names = ["at", "sha", "doc_id", "place", "n"]
    open_: pa.RecordBatch | None = None

    def close(rows: pa.Table, last: bool) -> tuple[pa.RecordBatch, pa.RecordBatch | None]:
        sha = np.frombuffer(b"".join(rows.column("sha").to_pylist()), dtype=np.uint8).reshape(-1, 32)
        at = rows.column("at").to_numpy()
        first = np.flatnonzero(np.append(True, (sha[1:] != sha[:-1]).any(axis=1) | (at[1:] != at[:-1])))
        n = np.add.reduceat(rows.column("n").to_numpy(), first)
        out = rows.take(pa.array(first)).set_column(4, "n", pa.array(n)).combine_chunks().to_batches()[0]
        return (out, None) if last else (out.slice(0, len(out) - 1), out.slice(len(out) - 1))

    for batch in batches:
        if batch.num_rows:
            batch = batch.select(names)
            out, open_ = close(pa.Table.from_batches([*([open_.cast(batch.schema)] if open_ is not None else []), batch]), False)
            yield out
    if open_ is not None:
        yield open_


def tree_merge(hashed: DataFrame, rounds: int) -> DataFrame:
    """sha, doc_id, place and n of every different digest: the row of the largest doc_id (nulls last), of those the first in the table, and how many there are.

    ``hashed``: doc_id, sha, place. ``rounds``: the runs meet in ``FAN ** rounds`` partitions.
    """
    size = FAN**rounds
    order = ["at", "sha", F.col("doc_id").desc_nulls_last(), "place"]
    runs = hashed.select(F.pmod(F.spark_partition_id(), F.lit(size)).cast("long").alias("at"), "sha", "doc_id", "place", F.lit(1).cast("long").alias("n"))
    runs = runs.sortWithinPartitions(*order).mapInArrow(merged, _ENTRY)
    for r in range(rounds):
        step = FAN**r
        digit = lambda c: F.pmod(F.floor(c / F.lit(step)), F.lit(FAN))  # noqa: E731, B023
        runs = runs.withColumn("at", F.col("at") + (digit(F.pmod(F.xxhash64("sha"), F.lit(size))) - digit(F.col("at"))) * step)
        runs = runs.repartitionById(size, F.col("at").cast("int")).sortWithinPartitions(*order).mapInArrow(merged, _ENTRY)
    return runs.select("sha", "doc_id", "place", "n")


def rounds_for(rows: int) -> int:
    """Rounds after which a partition holds ``ROWS`` entries or fewer, within bounds. Merging streams, so memory does not depend on it."""
    rounds = LEAST
    while rounds < MOST and rows > ROWS * FAN**rounds:
        rounds += 1
    return rounds


def duplicates(docs: DataFrame) -> DataFrame:
    """Every row's doc_id, sha, keep_id (the doc_id of the row that stays), group_size and kept.

    Texts are equal if they are identical with A-Z lowered; of equal texts the row with the largest doc_id stays, of repeated rows with that id the first of the table. Null texts
    count as empty, and are equal to empty ones; blank ones are not. Null doc_ids come last: such a row stays if its text has no other, and then keep_id is null. Very long
    texts are hashed whole. An empty table gives none. Only doc_id and text are read, so other columns cannot clash.

    Rows and what stays for them meet by digest; only digests with copies take part. They are broadcast up to ``BROADCAST_ROWS``; beyond, both sides are written
    tables, so that Spark can split a hot digest's rows.
    """
    found = digests(docs, ["doc_id"]).select("doc_id", "sha", F.monotonically_increasing_id().alias("place"))
    hashed = written(found, "digests")
    entries = written(tree_merge(hashed, rounds_for(hashed.count())).filter("n > 1"), "runs")
    copies = entries.select(F.col("sha").alias("_sha"), F.col("doc_id").alias("_id"), F.col("place").alias("_place"), F.col("n").alias("_n"))
    if rows_up_to(entries, BROADCAST_ROWS) <= BROADCAST_ROWS:
        copies = F.broadcast(copies)
    joined = hashed.join(copies, F.col("sha") == F.col("_sha"), "left")
    alone = F.col("_n").isNull()
    return joined.select(
        "doc_id",
        "sha",
        F.when(alone, F.col("doc_id")).otherwise(F.col("_id")).alias("keep_id"),
        F.coalesce("_n", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("place") == F.col("_place"))).alias("kept"),
    )


def survivors(docs: DataFrame) -> DataFrame:
    """The input rows that stay, all columns unchanged."""
    kept = written(duplicates(docs).filter("kept").select("doc_id", "sha"), "survivors")
    rows = digests(docs, ["*"]).join(kept.select(F.col("doc_id").alias("_id"), F.col("sha").alias("_sha")), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")), "left_semi")
    return rows.dropDuplicates(["doc_id", "sha"]).select("row.*")
