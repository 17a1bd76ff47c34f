"""Sketches kept as a table, one row a day and group, and merged for any range of days without reading what they were made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sizes of the sketches: distinct counts of 2 ** LG_K registers (standard error 1.04 / sqrt(2 ** LG_K), 1.6 %), quantiles of rank error 1.65 % at k = 200.
LG_K, K = 12, 200
#: Stated errors: of distinct counts (three standard errors), and of ranks.
DISTINCT_ERROR, RANK_ERROR = 3 * 1.04 / 2 ** (LG_K / 2), 0.02


def sketched(events: DataFrame, at: str, by: list[str], distinct: str, value: str) -> DataFrame:
    """day, ``by``, n, low, high and two sketches: of the different ``distinct`` and of the ``value`` of each day and group. Nulls count in n only; rows without time in nothing."""
    days = events.filter(F.col(at).isNotNull()).groupBy(F.to_date(at).alias("day"), *by)
    return days.agg(
        F.count("*").alias("n"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
        F.hll_sketch_agg(distinct, LG_K).alias("distinct_sketch"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), K).alias("value_sketch"),
    )


def keep(sketches: DataFrame, path: str) -> None:
    """Adds days to the table at ``path``, a folder a day; days that are there already are replaced, so a load may be repeated."""
    sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def merged(spark: SparkSession, path: str, by: list[str], first: str, last: str, ranks: list[float]) -> DataFrame:
    """``by``, n, low, high, distinct (estimated) and quantiles (at ``ranks``) from the first to the last day; only those days' sketches are read."""
    days = spark.read.parquet(path).filter(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    whole = days.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("distinct"),
        F.kll_merge_agg_double("value_sketch").alias("_values"),
    )
    known = F.kll_sketch_get_n_double("_values") > 0
    quantiles = F.when(known, F.array(*[F.kll_sketch_get_quantile_double("_values", F.lit(float(q))) for q in ranks]))
    return whole.select(*by, "n", "low", "high", "distinct", quantiles.alias("quantiles"))
