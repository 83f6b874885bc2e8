"""Submissions of analysis runs as a stream: one active run for each repository and change, cancellation, runs that were interrupted.

A log has repo, ref, seq, ts (timestamp) and kind. Kinds: submit (a new queued run, or the active one again), start (queued to
running), stage (a sign of life; a cancelled run ends here), finish, fail, cancel. A run without any event for `timeout_ms` is
failed as interrupted at that time. Events may come in any order within the watermark: each key's events wait in state until
the watermark has passed them and are then taken by (ts, seq), so that a stream gives what a sorted table gives.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from riskloom.session import importable

ACTIVE = ("queued", "running")
OUT = "repo string, ref string, run long, seq long, at timestamp, status string"
_EVENT, _RUN = "seq long, ms long, kind string", "run long, status string, stopping boolean, last long"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def typed_state(spark: SparkSession) -> Iterator[None]:
    """The store of states that typed processors need, while a query starts; the session's own setting comes back after it."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def interrupted(state: tuple, now: int, timeout_ms: int) -> tuple[tuple, list[tuple]]:
    """The state (run, status, stopping, last) at a time without an event, and the change (run, seq, ms, status) if the run is given up."""
    run, status, stopping, last = state
    if status in ACTIVE and now - last >= timeout_ms:
        return (run, "failed", stopping, last), [(run, None, last + timeout_ms, "interrupted")]
    return state, []


def step(state: tuple, seq: int, ms: int, kind: str, timeout_ms: int) -> tuple[tuple, list[tuple]]:
    """The state after an event, and the changes that it makes."""
    (run, status, stopping, last), out = interrupted(state, ms, timeout_ms)
    said = None
    if kind == "submit":
        if status in ACTIVE:
            said = "deduplicated"
        else:
            run, status, stopping, said = run + 1, "queued", False, "queued"
    elif kind == "cancel":
        said = "cancel_requested" if status in ACTIVE else "not_cancellable"
        stopping = stopping or status in ACTIVE
    elif kind == "fail" and status in ACTIVE:
        status = said = "failed"
    elif kind == "start" and status == "queued":
        status = said = "cancelled" if stopping else "running"
    elif kind == "stage" and status == "running" and stopping:
        status = said = "cancelled"
    elif kind == "finish" and status == "running":
        status = said = "completed"
    return (run, status, stopping, ms if status in ACTIVE else last), out + ([(run, seq, ms, said)] if said else [])


class Submissions(StatefulProcessor):
    """State of one (repo, ref): the events that the watermark has not passed, the run, and a timer for whichever ends first."""

    def __init__(self, timeout_ms: int) -> None:
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _EVENT)
        self.run = handle.getValueState("run", _RUN)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        self.waiting.appendList([(r.seq, r.ms, r.kind) for r in rows])
        return self._taken(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self._taken(key, timerValues)

    def _taken(self, key, timerValues) -> Iterator[Row]:
        """Takes what lies before the watermark, and sets the timer anew."""
        now = timerValues.getCurrentWatermarkInMs()
        state = tuple(self.run.get()) if self.run.exists() else (0, "none", False, 0)
        events = sorted((ms, seq, kind) for seq, ms, kind in self.waiting.get()) if self.waiting.exists() else []
        past = [e for e in events if e[0] < now]
        rest = events[len(past) :]
        changes: list[tuple] = []
        for ms, seq, kind in past:
            state, more = step(state, seq, ms, kind, self.timeout_ms)
            changes += more
        # at now itself an event may still come, so that a run's time is up only after it
        state, more = interrupted(state, now - 1, self.timeout_ms)
        changes += more
        if past:
            self.waiting.clear()
            if rest:
                self.waiting.put([(seq, ms, kind) for ms, seq, kind in rest])
        self.run.update(state)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        times = [e[0] for e in rest[:1]] + ([state[3] + self.timeout_ms] if state[1] in ACTIVE else [])
        if times:
            self.handle.registerTimer(max(min(times), now) + 1)
        repo, ref = key
        for run, seq, ms, status in changes:
            yield Row(repo=repo, ref=ref, run=run, seq=seq, at=_time(ms), status=status)

    def close(self) -> None:
        pass


def _time(ms: int):
    import datetime

    return datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(milliseconds=ms)


def submissions(log: DataFrame, timeout_ms: int, late: str = "1 hour") -> DataFrame:
    """repo, ref, run, seq, at, status: every change of a run, and the answers to submissions and cancellations, from a stream `log`.

    run counts the runs of a (repo, ref) from 1; seq is the event that made the change, null for an interruption. What is
    younger than the watermark is still to come. The stream has to be started under typed_state().
    """
    importable(log.sparkSession)
    events = log.withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    return events.groupBy("repo", "ref").transformWithState(statefulProcessor=Submissions(timeout_ms), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
