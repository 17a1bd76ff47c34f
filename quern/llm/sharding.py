"""Sharding by a permutation-filled lookup table, with DataFrame functions only.

Each shard has its own permutation of the slots of a prime-sized table. Shards take turns, each claiming the first free slot of its
permutation, until the table is full: all shards own nearly equally many slots, and losing a shard moves little but its own keys. A key's hash picks a
slot; the slot names the shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import salt

#: Prime; a hundred slots a shard keep shares within about one per cent of each other.
TABLE_SIZE = 6553
N_SHARDS = 64
#: Hex digits of an MD5 that make up a hash (60 bits).
DIGITS = 15


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:DIGITS], 16)


def lookup_table(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """The table: slot to index of its shard. It is made once on the driver; its size is the parameter, whatever the data."""
    if len(set(shards)) != len(shards) or not shards:
        raise ValueError("shards need distinct names, one at least")
    if size < len(shards) or any(size % p == 0 for p in range(2, int(size**0.5) + 1)):
        raise ValueError("the table's size must be a prime, no smaller than the number of shards")
    place = [_hash(f"offset:{s}") % size for s in shards]
    skip = [_hash(f"skip:{s}") % (size - 1) + 1 for s in shards]
    owner = [-1] * size
    for turn in range(size):
        i = turn % len(shards)
        while owner[place[i]] >= 0:
            place[i] = (place[i] + skip[i]) % size
        owner[place[i]] = i
    return owner


def slot_of(*keys: Column, size: int = TABLE_SIZE) -> Column:
    """The slot of a key. A null part counts as the empty text, so null keys are placed like any other."""
    text = F.concat_ws("\x1f", *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("long") % size).cast("int")


def table_frame(spark: SparkSession, shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """The table as rows of slot and shard (its index), made on the JVM from one literal."""
    owners = F.split(F.lit(",".join(map(str, lookup_table(shards, size)))), ",")
    return spark.range(1).select(F.posexplode(owners).alias("_slot", "_owner")).select("_slot", F.col("_owner").cast("int").alias("_owner"))


def assign(df: DataFrame, keys: Sequence[str], shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """Every row as ``row``, with ``slot`` and ``shard`` (the shard's index).

    Equal keys share a shard, whatever their length, and repeated rows with them; null keys are placed like the empty text; an empty table stays empty; names of
    the input cannot clash, as its columns stay inside ``row``. Placing is a lookup in a broadcast table of exactly ``size`` rows, without a shuffle,
    so hot keys cost nothing here.
    """
    placed = df.select(F.struct("*").alias("row"), slot_of(*[F.col(k) for k in keys], size=size).alias("slot"))
    found = F.broadcast(table_frame(df.sparkSession, shards, size))
    return placed.join(found, F.col("slot") == F.col("_slot")).select("row", "slot", F.col("_owner").alias("shard"))


def write_shards(assigned: DataFrame, path: str, files_per_shard: int = 8) -> None:
    """Writes folders shard=0, 1, ...; a shard's rows are dealt over ``files_per_shard`` tasks by their place in the table, so that a hot shard
    fills no task, even of equal rows. Rows with a column named shard are refused, as folders could not tell it apart. No rows: no folders."""
    inner = [f.name for f in assigned.schema["row"].dataType.fields]
    if "shard" in inner:
        raise ValueError("the rows have a column named shard already")
    rows = assigned.select("row.*", "shard", salt(files_per_shard).alias("_deal"))
    rows.repartition("shard", "_deal").drop("_deal").write.partitionBy("shard").parquet(path)
