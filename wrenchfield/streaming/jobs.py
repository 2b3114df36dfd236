"""The life of processing jobs as keyed state: a document's events go through one state machine, in a stream or in a batch.

Events (document_id, event_id, event, at, error): `enqueue` asks for a job, `retry` does so and revives a failed one, `start`
claims the waiting one, `complete` and `fail` end it. An active job is reused; a failed one comes back only when that is
asked; else a new one is made. A job that was started and not ended within `stuck` waits again, or has failed after `most`
attempts. An event that doesn't fit the state changes nothing.

In a stream a document's events wait in its state until the watermark has passed them and are taken in the order of their
times, so that late, doubled and replayed ones (within the watermark) give the same rows as the whole history in a batch.
Rows whose document, event or time is null are left out."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ACTIVE = ("queued", "processing", "retry")
ROW = "document_id long, job long, status string, attempts int, at timestamp, error string"
_STATE = "job long, status string, attempts int, since long, error string"
_EVENT = "event_id string, event string, at long, error string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ARROW = pa.schema([("document_id", pa.int64()), ("job", pa.int64()), ("status", pa.string()), ("attempts", pa.int32()), ("at", pa.timestamp("us", "UTC")), ("error", pa.string())])  # ROW
NOTHING = (0, None, 0, 0, None)  # job, status, attempts, since (microseconds), error


def stuck_at(state: tuple, stuck: int) -> int | None:
    """When a job that is being processed counts as stuck."""
    return state[3] + stuck if state[1] == "processing" else None


def freed(state: tuple, stuck: int, most: int) -> tuple:
    """The state after its job got stuck."""
    job, _, attempts, since, _ = state
    return (job, "failed" if attempts >= most else "retry", attempts, since + stuck, "stuck")


def advanced(state: tuple, event: str, at: int, error: str | None) -> tuple:
    """The state after an event; the same one, if it doesn't fit."""
    job, status, attempts, _, _ = state
    if event in ("enqueue", "retry"):
        if status in ACTIVE:
            return state
        return (job, "retry", attempts, at, None) if status == "failed" and event == "retry" else (job + 1, "queued", 0, at, None)
    if event == "start" and status in ("queued", "retry"):
        return (job, "processing", attempts + 1, at, None)
    if event in ("complete", "fail") and status == "processing":
        return (job, "completed" if event == "complete" else "failed", attempts, at, error if event == "fail" else None)
    return state


def through(state: tuple, events: list[tuple], stuck: int, most: int, until: int | None) -> tuple[tuple, list[tuple]]:
    """The state after events (event_id, event, at, error) in order of time, and each state on the way; jobs that are stuck by
    the time of an event, or by `until`, are freed there."""
    out = []
    for _, event, at, error in sorted({e[0]: e for e in sorted(events, key=lambda e: (e[2], e[1]), reverse=True)}.values(), key=lambda e: (e[2], e[0])):
        while (late := stuck_at(state, stuck)) is not None and late <= at:
            state = freed(state, stuck, most)
            out.append(state)
        new = advanced(state, event, at, error)
        if new != state:
            out.append(new)
        state = new
    if until is not None and (late := stuck_at(state, stuck)) is not None and late <= until:
        state = freed(state, stuck, most)
        out.append(state)
    return state, out


def _rows(document: int, states: list[tuple]) -> pd.DataFrame:
    made = pd.DataFrame([(document, *s) for s in states], columns=["document_id", "job", "status", "attempts", "at", "error"])
    return made.assign(at=pd.to_datetime(made["at"], unit="us", utc=True), attempts=made["attempts"].astype("int32"))


def _clean(events: DataFrame) -> DataFrame:
    return events.where("document_id is not null and event_id is not null and event is not null and at is not null").select(F.col("document_id").cast("long").alias("document_id"), "event_id", "event", "at", "error")


def history(events: DataFrame, stuck: dt.timedelta = dt.timedelta(hours=1), most: int = 3, until: dt.datetime | None = None) -> DataFrame:
    """Every state of every job (ROW), from the whole history of events; stuck jobs are freed up to `until`. A task goes through
    its documents one after the other, in batches of rows: no document is a group with a frame of its own."""
    gap, end = int(stuck.total_seconds() * 1e6), None if until is None else int(until.timestamp() * 1e6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        document, waiting, out = None, [], []

        def ended() -> None:
            out.extend((document, *state) for state in through(NOTHING, waiting, gap, most, end)[1])
            waiting.clear()

        def sent() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*out, strict=True) if out else [[]] * len(_ARROW), _ARROW.types, strict=True)], schema=_ARROW)
            out.clear()
            return made

        for batch in batches:
            for of, *event in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if of != document:
                    ended()
                    document = of
                waiting.append(tuple(event))
            yield sent()
        ended()
        yield sent()

    rows = _clean(events).select("document_id", "event_id", "event", F.unix_micros("at").alias("us"), "error")
    return rows.repartition("document_id").sortWithinPartitions("document_id").mapInArrow(run, ROW)


def current(states: DataFrame) -> DataFrame:
    """The last state of each document's last job."""
    order = F.struct("job", "at", F.when(F.col("status").isin("completed", "failed"), 2).when(F.col("status") == "processing", 1).otherwise(0))
    return states.groupBy("document_id").agg(F.max_by(F.struct("job", "status", "attempts", "at", "error"), order).alias("x")).select("document_id", "x.*")


class _Jobs(StatefulProcessor):
    def __init__(self, stuck: int, most: int):
        self.stuck, self.most = stuck, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state, self.waiting = handle, handle.getValueState("state", _STATE), handle.getListState("waiting", _EVENT)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            events = [(e, kind, int(pd.Timestamp(at).value // 1000), None if pd.isna(error) else error) for e, kind, at, error in part[["event_id", "event", "at", "error"]].itertuples(index=False, name=None)]
            self.waiting.appendList(events)
            for at in {e[2] for e in events}:
                self.handle.registerTimer(at // 1000 + 1)  # milliseconds
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000  # nothing from before it can still come
        waiting = [tuple(e) for e in self.waiting.get()] if self.waiting.exists() else []
        ready, rest = [e for e in waiting if e[2] < now], [e for e in waiting if e[2] >= now]
        before = tuple(self.state.get()) if self.state.exists() else NOTHING
        after, states = through(before, ready, self.stuck, self.most, now)
        if ready:
            self.waiting.put(rest) if rest else self.waiting.clear()
        if after != before:
            self.state.update(after)
            late = stuck_at(after, self.stuck)
            if late is not None:
                self.handle.registerTimer(late // 1000 + 1)
        if states:
            yield _rows(key[0], states)

    def close(self) -> None:
        pass


def stream(events: DataFrame, late: str = "10 minutes", stuck: dt.timedelta = dt.timedelta(hours=1), most: int = 3) -> DataFrame:
    """The states (ROW) of a stream of events, as the watermark passes them. Needs the RocksDB state store (ROCKSDB)."""
    once = _clean(events).withWatermark("at", late).dropDuplicatesWithinWatermark(["document_id", "event_id"])
    return once.groupBy("document_id").transformWithStateInPandas(_Jobs(int(stuck.total_seconds() * 1e6), most), outputStructType=ROW, outputMode="Append", timeMode="EventTime")
