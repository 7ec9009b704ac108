"""State machines on streams: alerts and the engine breaker."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pricelake.operators.serp import breaker_event

ALERT_CHANGES = "alert string, series string, state string, at timestamp"
BREAKER_CHANGES = "engine string, state string, at timestamp"


class _Alert(StatefulProcessor):
    """inactive -> pending -> firing -> resolved for one (alert, series).

    A run of true evaluations is pending; held for ``hold_seconds`` it fires. A false evaluation ends it, and so does an
    event-time pause longer than one step and than the lookback, in which the last evaluation still counts.
    """

    def __init__(self, step_seconds: int, lookback_seconds: int):
        self.step = max(step_seconds, lookback_seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "start timestamp, last timestamp, firing boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("eval_ts")
        held = self.run.get() if self.run.exists() else None
        start, last, firing = (pd.Timestamp(held[0]), pd.Timestamp(held[1]), held[2]) if held else (None, None, False)
        out = []

        def emit(state, at):
            out.append((key[0], key[1], state, at))

        for at, active, hold in zip(frame["eval_ts"], frame["active"], frame["hold_seconds"]):
            broken = last is not None and (at - last).total_seconds() > self.step
            if start is not None and (not active or broken):
                if firing:
                    emit("resolved", last + pd.Timedelta(seconds=self.step) if broken else at)
                start, firing = None, False
            if active:
                if start is None:
                    start = at
                    emit("pending", at)
                if not firing and (at - start).total_seconds() >= hold:
                    firing = True
                    emit("firing", start + pd.Timedelta(seconds=int(hold)))
            last = at
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if start is None:
            self.run.clear()
        else:
            self.run.update((start.to_pydatetime(), last.to_pydatetime(), firing))
            self.handle.registerTimer(_millis(last) + self.step * 1000 + 1)
        if out:
            yield pd.DataFrame(out, columns=["alert", "series", "state", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """No evaluation came in time: the run is over."""
        if self.run.exists():
            _, last, firing = self.run.get()
            self.run.clear()
            if firing:
                at = pd.Timestamp(last) + pd.Timedelta(seconds=self.step)
                yield pd.DataFrame([(key[0], key[1], "resolved", at)], columns=["alert", "series", "state", "at"])

    def close(self) -> None:
        pass


def _millis(at: pd.Timestamp) -> int:
    stamp = at.to_pydatetime()
    if stamp.tzinfo is None:
        stamp = stamp.replace(tzinfo=timezone.utc)
    return int(stamp.timestamp() * 1000)


def alert_changes(conditions: DataFrame, step_seconds: int = 30, delay: str = "2 minutes", lookback_seconds: int = 300) -> DataFrame:
    """State changes of a stream of ``(alert, series, eval_ts, active, hold_seconds)``."""
    return (
        conditions.withWatermark("eval_ts", delay)
        .groupBy("alert", "series")
        .transformWithStateInPandas(
            statefulProcessor=_Alert(step_seconds, lookback_seconds),
            outputStructType=ALERT_CHANGES,
            outputMode="Append",
            timeMode="EventTime",
        )
    )


class _Breaker(StatefulProcessor):
    """Open and closed times of one engine; an open breaker closes after its TTL or on success."""

    def __init__(self, ttl_seconds: int):
        self.ttl = ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.opened = handle.getValueState("opened", "since timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("ts")
        since = pd.Timestamp(self.opened.get()[0]) if self.opened.exists() else None
        out = []
        for at, event in zip(frame["ts"], frame["event"]):
            if since is not None and (at - since).total_seconds() >= self.ttl:
                out.append((key[0], "closed", since + pd.Timedelta(seconds=self.ttl)))
                since = None
            if event == "open":
                if since is None:
                    out.append((key[0], "open", at))
                since = at
            elif event == "close" and since is not None:
                out.append((key[0], "closed", at))
                since = None
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if since is None:
            self.opened.clear()
        else:
            self.opened.update((since.to_pydatetime(),))
            self.handle.registerTimer(_millis(since) + self.ttl * 1000)
        if out:
            yield pd.DataFrame(out, columns=["engine", "state", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.opened.exists():
            (since,) = self.opened.get()
            self.opened.clear()
            at = pd.Timestamp(since) + pd.Timedelta(seconds=self.ttl)
            yield pd.DataFrame([(key[0], "closed", at)], columns=["engine", "state", "at"])

    def close(self) -> None:
        pass


def breaker_changes(fetch_log: DataFrame, ttl_seconds: int = 1800, delay: str = "1 minute", min_chars: int = 0) -> DataFrame:
    """State changes per engine from a stream of fetch log rows."""
    return (
        fetch_log.withColumn("event", breaker_event(min_chars))
        .filter(F.col("event") != "none")
        .select("engine", "ts", "event")
        .withWatermark("ts", delay)
        .groupBy("engine")
        .transformWithStateInPandas(
            statefulProcessor=_Breaker(ttl_seconds),
            outputStructType=BREAKER_CHANGES,
            outputMode="Append",
            timeMode="EventTime",
        )
    )
