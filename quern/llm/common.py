"""What the operators share: the shared folder, tables that cut lineage, checked broadcasts, words."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import shared_dir

#: Fixed pattern: a word is a run of anything but space and the five ASCII controls from tab on.
WORD = r"[^\x20\x09-\x0D]+"
#: The characters that end words, for translate().
BLANKS = " \t\n\x0b\x0c\r"
#: Rows up to which a side is broadcast.
BROADCAST_ROWS = 100_000


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def rows_up_to(df: DataFrame, bound: int) -> int:
    """The number of rows, counted no further than bound + 1."""
    return df.limit(bound + 1).count()


def salt(salts: int) -> Column:
    """A number below ``salts`` by a row's place in its table: equal rows get different ones."""
    return F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int")


def join_small(big: DataFrame, small: DataFrame, key: str, salts: int = 32, bound: int = BROADCAST_ROWS, how: str = "inner") -> DataFrame:
    """Equi-join on a null-safe ``key`` that survives hot keys.

    ``small`` (already written, one row per key) is broadcast after counting no more than ``bound`` rows in it. Beyond
    that each of its rows is repeated once per salt, so that a hot key's rows on the big side are dealt over ``salts`` tasks. Salts go by a row's place in its
    table, so equal rows are dealt too; ``big`` is to be read from a table, where a repeated task finds each row at the same place.
    """
    right = small.withColumnRenamed(key, "_right_key")
    if rows_up_to(small, bound) <= bound:
        joined = big.join(F.broadcast(right), F.col(key).eqNullSafe(F.col("_right_key")), how)
        return joined.drop("_right_key")
    right = right.withColumn("_right_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = big.withColumn("_left_salt", salt(salts))
    on = F.col(key).eqNullSafe(F.col("_right_key")) & (F.col("_left_salt") == F.col("_right_salt"))
    return left.join(right.hint("merge"), on, how).drop("_right_key", "_right_salt", "_left_salt")  # Spark sizes it as before the explode, and would broadcast it whole


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once a row: inside a lambda, a plain column is worked out again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def give_back() -> None:
    """Returns what this worker has freed to the system, at the end of a task that held much: workers live on, and would keep it through later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def n_words(text: Column) -> Column:
    """The number of words of a text; none for null."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` written with column ``name``: each row's place from 0 in ``order``, without sorting in one task.

    Rows are dealt by ranges of ``order``, numbered within their partition, and shifted by the rows of the partitions before
    (one row per partition).
    """
    from pyspark.sql import Window as W

    dealt = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select(
        F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before")
    )
    local = dealt.withColumn("_at", F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1)
    return local.join(before, F.col("_part") == F.col("_p")).withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_p", "_before", "_at")
