"""Windowed aggregates and deduplication over a stream of events, with watermarks.

Times are ``timestamp_ntz`` in the files; a watermark needs ``timestamp``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import shared_dir

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, path: str, watermark: str = "1 hour", files_per_trigger: int = 1000) -> DataFrame:
    """Events as they arrive in a folder; rows later than the watermark are dropped by what follows."""
    raw = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def continued(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that has arrived since its last run with this folder, into Parquet files there (exactly once, by the checkpoint beside them); all rows."""
    spark = stream.sparkSession
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/rows")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def finished(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a new stream over all that has arrived; the rows."""
    return continued(stream, shared_dir(stream.sparkSession, name), mode)


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which state of one's own with timers needs; other queries' setting stays."""
    key, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _bounds(window: str) -> list:
    return [F.col(f"{window}.start").cast("timestamp_ntz").alias("window_start"), F.col(f"{window}.end").cast("timestamp_ntz").alias("window_end")]


def per_window(events: DataFrame, size: str, slide: str | None = None) -> DataFrame:
    """Events and the sum of values per window and type: tumbling windows, or sliding ones."""
    grouped = events.groupBy(F.window("ts", size, slide or size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return grouped.select(*_bounds("window"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """Events per session of a user."""
    return events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(*_bounds("session_window"), "user_id", "n")


def deduplicated(events: DataFrame, key: str = "event_id") -> DataFrame:
    """Each key once within the watermark."""
    return events.dropDuplicatesWithinWatermark([key])


def enriched(events: DataFrame, static: DataFrame, key: str, column: str) -> DataFrame:
    """A stream joined with a table that does not move, one row a key; events without a match stay."""
    return events.join(static.select(F.col(key).alias("_key"), column), F.col(key) == F.col("_key"), "left").drop("_key")


def followed(first: DataFrame, second: DataFrame, within: str) -> DataFrame:
    """Pairs of an event of one stream and a later one of the other by the same user, no further apart than ``within``: both streams' watermarks bound
    what is kept waiting."""
    a = first.select(F.col("event_id").alias("first_id"), "user_id", F.col("ts").alias("first_ts"))
    b = second.select(F.col("event_id").alias("second_id"), F.col("user_id").alias("_user"), F.col("ts").alias("second_ts"))
    near = (F.col("second_ts") > F.col("first_ts")) & (F.col("second_ts") <= F.col("first_ts") + F.expr(f"INTERVAL {within}"))
    return a.join(b, (F.col("user_id") == F.col("_user")) & near).select("first_id", "second_id", "user_id")


def totals(events: DataFrame) -> DataFrame:
    """A user's events and sum of values so far: a built-in aggregate, kept by Spark as the stream's state and given out whole after each trigger."""
    return events.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def latest(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream's aggregate over all that has arrived; the rows after its last trigger. Each trigger's rows replace those before."""
    spark = stream.sparkSession
    folder = shared_dir(spark, name)

    def save(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows")

    query = stream.writeStream.foreachBatch(save).outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def changes(events: DataFrame) -> DataFrame:
    """event_id, user_id and whether the type is another than that of the user's event before: state of our own, an event at a time in each trigger's order of
    time, which no built-in aggregate has."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterable[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for frame in frames:
            frame = frame.sort_values(["ts", "event_id"])
            before = frame["event_type"].shift(1)
            before.iloc[0] = last
            last = frame["event_type"].iloc[-1]
            yield pd.DataFrame({"event_id": frame["event_id"], "user_id": key[0], "changed": frame["event_type"] != before})
        state.update((last,))

    return events.groupBy("user_id").applyInPandasWithState(step, "event_id long, user_id long, changed boolean", "last string", "append", "NoTimeout")
