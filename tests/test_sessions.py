"""Sessions in state of our own against a plain walk over each user's events, over several triggers and with rows out of order."""

import random

import pytest
from pyspark.sql import functions as F

from quern.session import shared_dir
from quern.streaming import events, sessions

MINUTE = 60


def slow(rows, gap, memory, watermark):
    """rows: (user, second, id, kind)."""
    out = []
    for user in {r[0] for r in rows}:
        own = sorted((at, i, k) for u, at, i, k in rows if u == user)
        before = None
        for s in sessions.split(own, gap):
            end = s[-1][0] + gap
            kinds = {k: sum(e[2] == k for e in s) for _, _, k in s if k is not None}
            idle = float(s[0][0] - before) if before is not None and s[0][0] - before <= memory else None
            before = end
            if end <= watermark:
                out.append((user, s[0][0], end, len(s), ",".join(f"{k}:{n}" for k, n in sorted(kinds.items())), idle))
    return sorted(out, key=str)


def run(spark, lots, gap, memory, delay):
    folder, path = shared_dir(spark, "sessions"), shared_dir(spark, "lots")
    for k, lot in enumerate(lots):
        df = spark.createDataFrame(lot, "user_id long, at long, event_id long, event_type string")
        df.select("event_id", F.timestamp_seconds("at").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", F.lit(0.0).alias("value"), F.lit("").alias("props")).coalesce(1).write.mode("append").parquet(path)
        stream = events.read(spark, path, watermark=f"{delay} seconds")
        with events.keyed_state(spark):
            found = events.continued(sessions.closed_sessions(stream, gap, memory), folder)
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp")).alias(c)
    return sorted((tuple(r) for r in found.select("user_id", seconds("window_start"), seconds("window_end"), "n", "kinds", "idle_seconds").collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_out_of_order(spark, seed):
    rng, gap, memory, delay = random.Random(seed), 30 * MINUTE, 300 * MINUTE, 120 * MINUTE
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.randrange(3000) * MINUTE, k, rng.choice(["view", "click", None])) for k in range(260)]
    rows.sort(key=lambda r: r[1] + rng.randrange(delay))  # none is later than the delay
    lots = [rows[:90], rows[90:95], rows[95:200], rows[200:] + [(9, 5000 * MINUTE, 999, "last")]]
    want = slow(lots[0] + lots[1] + lots[2] + lots[3], gap, memory, 5000 * MINUTE - delay)
    got = run(spark, lots, gap, memory, delay)
    assert got == want and any(w[5] is None for w in want) and any(w[5] is not None for w in want)


def test_late_rows_lengthen_join_and_precede(spark):
    gap, delay = 10, 1000
    first = [(1, 100, 1, "a"), (1, 115, 2, "a"), (1, 200, 3, "b")]
    late = [(1, 108, 4, "c"), (1, 50, 5, "a"), (1, 205, 6, "b")]
    too_late = [(1, 10, 7, "z")]
    got = run(spark, [first, late, [(2, 3000, 8, "x")], too_late, [(2, 9000, 9, "x")]], gap, 10_000, delay)
    assert got == sorted([(1, 50, 60, 1, "a:1", None), (1, 100, 125, 3, "a:2,c:1", 40.0), (1, 200, 215, 2, "b:2", 75.0), (2, 3000, 3010, 1, "x:1", None)], key=str)


def test_the_setting_comes_back(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    with pytest.raises(RuntimeError), events.keyed_state(spark):
        assert "RocksDB" in spark.conf.get(key)
        raise RuntimeError
    assert spark.conf.get(key) == before


class Handle:
    """State of one user in plain lists; counts the calls."""

    def __init__(self):
        self.calls, self.timers, self.rows, self.value = 0, set(), [], None

    def _call(self, do):
        def run(*args):
            self.calls += 1
            return do(*args)

        return run

    def __getattr__(self, name):  # any state is this one
        if name.startswith("get") and name.endswith("State"):
            return lambda kind, *_: State(self, kind)
        raise AttributeError(name)

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.add(at)


class State:
    def __init__(self, handle, kind):
        self.handle, self.kind, self.held = handle, kind, None

    def __getattr__(self, name):
        do = {
            "exists": lambda: bool(self.held),
            "get": lambda: iter(self.held or []) if self.kind == "open" else self.held,
            "getValue": lambda k: (self.held or {})[k],
            "containsKey": lambda k: k in (self.held or {}),
            "updateValue": lambda k, v: setattr(self, "held", {**(self.held or {}), k: v}),
            "removeKey": lambda k: self.held.pop(k),
            "appendList": lambda rows: setattr(self, "held", [*(self.held or []), *rows]),
            "put": lambda rows: setattr(self, "held", list(rows)),
            "update": lambda row: setattr(self, "held", row),
            "clear": lambda: setattr(self, "held", None),
        }
        if name not in do:
            raise AttributeError(name)
        return self.handle._call(do[name])


def test_calls_do_not_grow_with_sessions():
    """A user's trigger takes a few calls for state, however many sessions it closes."""
    calls = {}
    for n in (5, 500):
        processor, handle, out = sessions.Sessions(10_000_000, 10**12), Handle(), []
        processor.init(handle)
        processor.handleInputRows((1,), iter({"at": 60_000_000 * k, "event_id": k, "kind": "ab"[k % 2]} for k in range(n)), None)
        now, fired = 60_000 * (n + 1), set()
        while due := sorted(t for t in handle.timers - fired if t <= now):
            fired.add(due[0])
            times = type("Times", (), {"getCurrentWatermarkInMs": lambda self: now, "getExpiryTimeInMs": lambda self: due[0]})()
            out += processor.handleExpiredTimer((1,), times, times)
        assert len(out) == n and [r.idle for r in out] == [None] + [50_000_000] * (n - 1)
        calls[n] = handle.calls
    assert calls[5] == calls[500] < 20


def test_session_that_ends_at_the_watermark_is_closed(spark):
    got = run(spark, [[(1, 100, 1, "a"), (2, 101, 2, "a"), (3, 1110, 3, "x")]], 10, 100, 1000)
    assert got == [(1, 100, 110, 1, "a:1", None)]
