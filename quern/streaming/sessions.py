"""Sessions of users in state of our own: a list of what is open, a value that outlives it, and timers that close and forget."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_OUT = "user_id long, first long, last long, n long, kinds string, idle long"


def split(events: list[tuple[int, int, str]], gap: int) -> list[list[tuple[int, int, str]]]:
    """Sessions of events (time, id, kind): a new one begins when the event before lies ``gap`` or more back."""
    out: list[list[tuple[int, int, str]]] = []
    for e in sorted(events):
        if out and e[0] - out[-1][-1][0] < gap:
            out[-1].append(e)
        else:
            out.append([e])
    return out


class Sessions(StatefulProcessor):
    """A user's events wait in a list until the watermark has passed the gap after the last of a session; a timer for the first session's end wakes the user up then.

    So rows may come in any order: one that is late, but not later than the watermark, may lengthen a session, join two, or stand before one, and older timers
    find nothing to close. Calls for state cost far more than rows, so a lot of rows makes two, and one timer closes all sessions that the watermark has passed: what a user costs in a trigger is a few calls, however
    many sessions end. The end of the last closed session is kept as a value, for the silence before the next, and forgotten by a timer ``memory`` later.
    Times are microseconds; timers are milliseconds, rounded up.
    """

    def __init__(self, gap: int, memory: int) -> None:
        self.gap, self.memory = gap, memory

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "at long, event_id long, kind string")
        self.closed = handle.getValueState("closed", "at long")

    def _timer(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        new = [(r["at"], r["event_id"], r["kind"]) for r in rows]
        self.open.appendList(new)
        self._timer(min(new)[0] + self.gap)  # no session with a new row ends before; those without have a timer
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        sessions = split([tuple(e) for e in self.open.get()], self.gap)
        before = self.closed.get()[0] if self.closed.exists() else None
        done = 0
        for session in sessions:
            end = session[-1][0] + self.gap
            if end > now:
                break
            idle = session[0][0] - before if before is not None and session[0][0] - before <= self.memory else None
            found = Counter(e[2] for e in session if e[2] is not None)
            yield Row(user_id=key[0], first=session[0][0], last=end, n=len(session), kinds=",".join(f"{k}:{v}" for k, v in sorted(found.items())), idle=idle)
            before, done = end, done + 1
        left = [e for session in sessions[done:] for e in session]
        if left:
            self._timer(sessions[done][-1][0] + self.gap)
            if done:
                self.open.put(left)
        elif done:
            self.open.clear()
        if before is not None and now > before + self.memory:
            self.closed.clear()
        elif done:
            self.closed.update((before,))
            self._timer(before + self.memory + 1000)

    def close(self) -> None:
        pass


def closed_sessions(events: DataFrame, gap: int, memory: int) -> DataFrame:
    """user_id, window_start, window_end, n, kinds ("kind:count" by kind) and idle_seconds of every session that ended before the watermark.

    ``events``: a stream with a watermark on ts. ``gap`` and ``memory`` in seconds: silence that ends a session; how long its end is remembered, idle_seconds being null
    after longer silence. Rows later than the watermark are dropped; null kinds count in n only; rows without user are sessions of the null user. State is bounded by the events of the
    watermark's delay and the gap, and by one number for each user seen within ``memory``.
    """
    slim = events.select("user_id", "ts", F.unix_micros("ts").alias("at"), "event_id", F.col("event_type").alias("kind"))
    found = slim.groupBy("user_id").transformWithState(Sessions(gap * 1_000_000, memory * 1_000_000), _OUT, "Append", "EventTime")
    time = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return found.select("user_id", time("first").alias("window_start"), time("last").alias("window_end"), "n", "kinds", (F.col("idle") / 1_000_000).alias("idle_seconds"))
