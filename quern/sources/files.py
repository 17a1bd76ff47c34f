"""Files and tables: parquet, orc, json, csv, text, binary files, JDBC; batch and stream."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.session import broadcast_up_to, landed, named

FORMATS = ("parquet", "orc", "json", "csv", "text", "binaryFile", "avro", "jdbc")


def read(spark: SparkSession, kind: str, path: str | None = None, schema: StructType | str | None = None, **options: str) -> DataFrame:
    """A batch source. CSV and JSON want a schema, as guessing one costs a pass over the data; text and binaryFile have their own."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    if kind in ("json", "csv") and schema is None:
        raise ValueError(f"{kind} needs a schema")
    reader = spark.read.format(kind).options(**({"header": "true"} if kind == "csv" else {}) | options)
    reader = reader.schema(schema) if schema is not None else reader
    return reader.load(path) if path is not None else reader.load()


def write(df: DataFrame, kind: str, path: str, mode: str = "errorifexists", by: list[str] | None = None, **options: str) -> None:
    """A batch sink, partitioned into folders by the columns ``by``."""
    if kind not in FORMATS or kind in ("text", "binaryFile"):
        raise ValueError(f"cannot write {kind}")
    df.write.format(kind).mode(mode).options(**({"header": "true"} if kind == "csv" else {}) | options).partitionBy(*(by or [])).save(path)


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> DataFrame:
    """A table whose rows lie bucketed and sorted by a key, so that joins on it need no shuffle. It lies at ``path``, under the folder's name, until clear_shared()."""
    name = "bucketed_" + re.sub(r"\W", "_", path.rstrip("/").rpartition("/")[2])
    named(name)
    df.write.mode("errorifexists").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def upsert(rows: DataFrame, path: str, keys: list[str], by: str, version: str) -> None:
    """Brings a table that lies in folders by a column up to date: of all rows with equal ``keys`` in a folder the one of the latest ``version`` stays, of the new ones if equal.

    ``keys`` have to decide ``by``. Only folders that new rows belong to are read, found when the plan runs, and written, each replaced whole; so a load may be repeated, or
    tried again after an error, with the same table. Rows without a version come first; repeated rows stay once.
    """
    spark = rows.sparkSession
    new = landed(rows, "upsert")
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc_nulls_last(version), F.desc("_new")))
    old = existing(spark, path, rows.schema)
    both = new.withColumn("_new", F.lit(1))
    if old is not None:
        both = both.unionByName(in_folders_of(old, new, by).select(*rows.columns).withColumn("_new", F.lit(0)))
    latest = landed(both.withColumn("_place", place).filter("_place = 1").drop("_place", "_new"), "latest")
    latest.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def in_folders_of(old: DataFrame, new: DataFrame, by: str) -> DataFrame:
    """The rows of a table in folders that lie in the same folders as new rows; no other folder is read. The comparison tells Spark that pruning pays."""
    touched = new.groupBy(by).agg(F.count("*").alias("_n")).filter("_n > 0").select(by)
    return old.join(broadcast_up_to(touched), by, "left_semi")


def existing(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    """The table at a path, if there is one."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    return spark.read.schema(schema).parquet(path) if there else None
