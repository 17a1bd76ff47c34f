"""Paper metadata that was fetched elsewhere and landed as JSON lines, one work a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCHEMA = "DOI string, title array<string>, `container-title` array<string>, published struct<`date-parts`: array<array<int>>>, language string, type string"


def _landed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path).withColumn("_file", F.input_file_name())


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    """file, line and reason of what read_works() leaves out: lines that are not JSON, and works without a DOI (line null)."""
    raw = _landed(spark, path)
    reason = F.when(F.col("_bad").isNotNull(), "not JSON").when(F.col("DOI").isNull(), "no DOI")
    return raw.select(F.col("_file").alias("file"), F.col("_bad").alias("line"), reason.alias("reason")).filter("reason IS NOT NULL")


def read_works(spark: SparkSession, path: str) -> DataFrame:
    """doi, title, journal, year, lang of each work; what cannot be read is left to read_rejects(). A DOI that landed twice stays once, its latest year first."""
    works = _landed(spark, path).filter("_bad IS NULL").select(
        F.lower("DOI").alias("doi"),
        F.get("title", F.lit(0)).alias("title"),
        F.get("container-title", F.lit(0)).alias("journal"),
        F.get(F.get("published.date-parts", F.lit(0)), F.lit(0)).alias("year"),
        F.col("language").alias("lang"),
    )
    place = F.row_number().over(W.partitionBy("doi").orderBy(F.col("year").desc_nulls_last(), "title"))
    return works.filter("doi IS NOT NULL").withColumn("_n", place).filter("_n = 1").drop("_n")
