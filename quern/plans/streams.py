"""Streams run over all that has arrived (Track B). In append mode the windows still open at the watermark are not out yet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans.registry import Registry
from quern.session import shared_dir, table
from quern.sources import queue
from quern.streaming import events, sessions

REGISTRY = Registry()
_CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.read(spark, f"{sf_dir}/events.parque[t]")  # a pattern: a stream takes no single file


@REGISTRY.add(
    "stream_tumbling",
    f"""SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total
    FROM events GROUP BY 1, 2, 3 HAVING time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= {_CLOSED}""",
)
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and sums per day and type."""
    return events.finished(events.per_window(_events(spark, sf_dir), "1 day"), "tumbling")


@REGISTRY.add(
    "stream_sliding",
    f"""SELECT s AS window_start, s + INTERVAL 2 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total
    FROM (SELECT *, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS s FROM events)
    GROUP BY 1, 2, 3 HAVING s + INTERVAL 2 HOUR <= {_CLOSED}""",
)
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and sums per two hours, each hour anew."""
    return events.finished(events.per_window(_events(spark, sf_dir), "2 hours", "1 hour"), "sliding")


@REGISTRY.add(
    "stream_sessions",
    f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh, event_id FROM events),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
    SELECT min(ts) AS window_start, max(ts) + INTERVAL 30 MINUTE AS window_end, user_id, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= {_CLOSED}""",
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users, closed by half an hour of silence."""
    return events.finished(events.sessions(_events(spark, sf_dir), "30 minutes"), "sessions")


@REGISTRY.add("stream_deduplicated", "SELECT DISTINCT event_id, user_id FROM events")
def stream_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event once."""
    return events.finished(events.deduplicated(_events(spark, sf_dir)).select("event_id", "user_id"), "deduplicated")


@REGISTRY.add("stream_running_totals", "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def stream_running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's totals after the last trigger."""
    return events.latest(events.totals(_events(spark, sf_dir)), "totals").select("user_id", "n", F.round("total", 4).alias("total"))


@REGISTRY.add(
    "stream_enriched",
    "SELECT event_id, user_id, c_mktsegment FROM events LEFT JOIN (SELECT c_custkey, c_mktsegment FROM customer) ON user_id = c_custkey",
)
def stream_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with its customer's segment: a stream joined with a table."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    joined = events.enriched(_events(spark, sf_dir), customers, "user_id", "c_mktsegment")
    return events.finished(joined.select("event_id", "user_id", "c_mktsegment"), "enriched")


@REGISTRY.add(
    "stream_followed",
    """SELECT a.event_id AS first_id, b.event_id AS second_id, a.user_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 30 MINUTE
    WHERE a.event_type = 'view' AND b.event_type = 'click'""",
)
def stream_followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks within half an hour after a view of the same user: two streams joined."""
    both = _events(spark, sf_dir), _events(spark, sf_dir)
    return events.finished(events.followed(both[0].filter("event_type = 'view'"), both[1].filter("event_type = 'click'"), "30 MINUTES"), "followed")


@REGISTRY.add(
    "stream_state_sessions",
    f"""WITH g AS (SELECT user_id, ts, event_type, event_id, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT user_id, ts, event_type, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g),
    t AS (SELECT user_id, k, event_type, min(ts) AS lo, max(ts) AS hi, count(*) AS n FROM s GROUP BY ALL),
    w AS (SELECT user_id, min(lo) AS window_start, max(hi) + INTERVAL 30 MINUTE AS window_end, CAST(sum(n) AS BIGINT) AS n, string_agg(event_type || ':' || n, ',' ORDER BY event_type) AS kinds FROM t GROUP BY user_id, k),
    i AS (SELECT *, epoch_us(window_start) - epoch_us(lag(window_end) OVER (PARTITION BY user_id ORDER BY window_start)) AS idle FROM w)
    SELECT user_id, window_start, window_end, n, kinds, CASE WHEN idle <= 259200000000 THEN idle / 1000000 END AS idle_seconds FROM i WHERE window_end <= {_CLOSED}""",
)
def stream_state_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users closed by timers, with their kinds of events and the silence before them, if it was no longer than three days."""
    with events.keyed_state(spark):
        return events.finished(sessions.closed_sessions(_events(spark, sf_dir), 30 * 60, 3 * 24 * 3600), "state-sessions")


@REGISTRY.add("stream_from_log", "SELECT event_id, user_id, event_type, value FROM events")
def stream_from_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event once, from a message log that gets them in three lots; the stream is stopped after each and goes on from its offsets."""
    topic, folder = shared_dir(spark, "topic"), shared_dir(spark, "from-log")
    message = F.to_json(F.struct("event_id", "user_id", "event_type", "value")).alias("value")
    lots = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), message, "ts", "event_id")
    for lot in range(3):
        queue.produce(lots.filter(F.col("event_id") % 3 == lot), topic, ["ts", "event_id"])
        parsed = F.from_json("value", "event_id long, user_id long, event_type string, value double").alias("m")
        rows = events.continued(queue.stream(spark, topic).select(parsed).select("m.*"), folder)
    return rows
