"""Top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.session import landed


def top_k_per_group(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group in an order that should be total. Spark cuts groups to k rows before the shuffle too."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= k)


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with each row's place in ``order`` (total, or ties in any order), from 0, without sorting in one task.

    Rows are dealt by ranges of the order and numbered in them; a range's first place is the number of rows before it, one sum a range.
    """
    dealt = landed(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    local = dealt.withColumn("_at", F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1)
    return local.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_before", "_at")
