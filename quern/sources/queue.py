"""A message log as a stream source: partitions of messages in order, segments of bounded size, offsets, commits and replay.

A topic is a folder of Parquet segments ``partition=<p>/segment=<first offset, 20 digits>``. A message's offset is its place in its partition and never
changes, so whatever range of offsets a trigger asked for can be read again after a stop or a lost executor, with the same messages. Spark keeps the offsets of every trigger in
the query's checkpoint; what a trigger has written whole is committed back to the topic, under the reader's group, so that old segments can be dropped.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from quern.sources import stores

#: Partitions of a new topic; messages to a segment, about.
PARTITIONS, SEGMENT = 8, 50_000
_SCHEMA = "partition int, offset long, key string, value string"
_PLACE = re.compile(r"partition=(\d+)/segment=(\d+)/")


def segments(topic: str) -> dict[int, list[tuple[int, int, str]]]:
    """By partition, the first offset, offset after the last, and path of each segment, in order."""
    found: dict[int, list[tuple[int, int, str]]] = {}
    for name in stores.listed(topic):
        if place := _PLACE.match(name):
            path = f"{topic.rstrip('/')}/{name}"
            first = int(place[2])
            with stores.opened(path) as file:
                found.setdefault(int(place[1]), []).append((first, first + pq.ParquetFile(file).metadata.num_rows, path))
    return {p: sorted(s) for p, s in sorted(found.items())}


def ends(topic: str) -> dict[int, int]:
    """By partition, the offset after its last message."""
    return {p: s[-1][1] for p, s in segments(topic).items()}


def produce(messages: DataFrame, topic: str, order: list[str], partitions: int = PARTITIONS, segment: int = SEGMENT) -> None:
    """Appends messages (key, value, and the columns ``order`` that say which comes first) to a topic's partitions, by key; null keys go together.

    One producer at a time. Messages of a partition are numbered by two steps, places within segments dealt by ranges and then segments' sizes, so no task sorts a
    partition whole and a hot key fills no task. Segments come out under their first offset.
    """
    known = ends(topic)
    part = F.pmod(F.xxhash64("key"), F.lit(partitions)).cast("int")
    rows = messages.select(part.alias("partition"), "key", "value", *[F.col(c).alias(f"_{c}") for c in order])
    by = ["partition", *[f"_{c}" for c in order]]
    dealt = rows.repartitionByRange(max(1, -(-rows.count() // segment)), *by).sortWithinPartitions(*by).withColumn("_range", F.spark_partition_id())
    staged = f"{topic.rstrip('/')}/_staged"  # numbered once, so that both passes below see the same ranges
    dealt.withColumn("_at", F.monotonically_increasing_id()).write.mode("overwrite").parquet(staged)
    back = messages.sparkSession.read.parquet(staged)
    sizes = back.groupBy("partition", "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_least"))
    base = F.coalesce(*[F.when(F.col("partition") == p, F.lit(n)) for p, n in known.items()], F.lit(0)).cast("long")
    before = F.coalesce(F.sum("_n").over(W.partitionBy("partition").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("partition", "_range", "_least", (base + before).alias("_first"))
    placed = back.join(starts, ["partition", "_range"]).withColumn("offset", F.col("_first") + F.col("_at") - F.col("_least"))
    out = placed.select("offset", "key", "value", "partition", F.lpad(F.col("_first").cast("string"), 20, "0").alias("segment"))
    out.repartition("partition", "segment").sortWithinPartitions("partition", "segment", "offset").write.mode("append").partitionBy("partition", "segment").parquet(topic)


@dataclass
class Range(InputPartition):
    """Messages of one segment that one task reads, and the partition they are of."""

    partition: int
    path: str
    first: int
    start: int
    end: int


class LogReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.topic, self.group = options["topic"], options.get("group", "default")
        self.begin = json.loads(options.get("startingOffsets", "{}"))

    def initialOffset(self) -> dict:  # noqa: N802
        """The first messages that are still there, or what ``startingOffsets`` says for a partition."""
        return {str(p): max(s[0][0], int(self.begin.get(str(p), 0))) for p, s in segments(self.topic).items()}

    def latestOffset(self) -> dict:  # noqa: N802
        return {str(p): max(end, int(self.begin.get(str(p), 0))) for p, end in ends(self.topic).items()}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        """A task for each segment that the offsets touch. A partition that ``start`` does not know is new and begins at its first message."""
        out = []
        for p, found in segments(self.topic).items():
            low, high = int(start.get(str(p), self.begin.get(str(p), 0))), int(end.get(str(p), 0))
            if low < high and found[0][0] > low:
                raise ValueError(f"messages {low} to {found[0][0] - 1} of partition {p} are gone")
            out += [Range(p, path, first, max(low, first), min(high, after)) for first, after, path in found if max(low, first) < min(high, after)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        with stores.opened(partition.path) as file:
            at = partition.first
            for batch in pq.ParquetFile(file).iter_batches(columns=["offset", "key", "value"]):
                low, high = max(partition.start, at), min(partition.end, at + batch.num_rows)
                if low < high:
                    part = batch.slice(low - at, high - low)
                    yield pa.RecordBatch.from_arrays([pa.array([partition.partition] * part.num_rows, pa.int32()), *part.columns], names=["partition", "offset", "key", "value"])
                at += batch.num_rows

    def commit(self, end: dict) -> None:
        stores.put(f"{self.topic.rstrip('/')}/_commits", f"{self.group}.json", json.dumps(end).encode())


class LogSource(DataSource):
    """Options: ``topic`` (a shared folder), ``group`` (whose commits these are), ``startingOffsets`` (a JSON map by partition, for a new query)."""

    @classmethod
    def name(cls) -> str:
        return "quern_log"

    def schema(self) -> str:
        return _SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return LogReader(self.options)


def stream(spark: SparkSession, topic: str, **options: str) -> DataFrame:
    """partition, offset, key and value of a topic's messages, as they come."""
    spark.dataSource.register(LogSource)
    return spark.readStream.format("quern_log").option("topic", topic).options(**options).load()


def committed(topic: str, group: str = "default") -> dict[int, int]:
    """By partition, the offset up to which a group has everything; none before its first commit."""
    try:
        with stores.opened(f"{topic.rstrip('/')}/_commits/{group}.json") as file:
            return {int(p): int(n) for p, n in json.loads(file.read()).items()}
    except FileNotFoundError:
        return {}


def trim(topic: str, groups: list[str]) -> list[str]:
    """Drops the segments that all ``groups`` have committed whole; but each partition's last stays, as its end says where the next message goes. Their paths."""
    done = [committed(topic, g) for g in groups]
    old = [path for p, found in segments(topic).items() for _, after, path in found[:-1] if all(after <= d.get(p, 0) for d in done)]
    for path in old:
        stores.drop(path)
    return old
