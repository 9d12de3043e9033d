"""The event operators on streams of frames.

Stateless rules run as they are; latest-per-key uses update mode; rules that carry state along a connection use
``applyInPandasWithState`` with a timeout, so that a closed connection's state goes.  A connection's frames of one
micro-batch are put in order of ``seq`` before they are taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from readlake.operators.events import parse_frames

#: State of a connection without frames for so long is dropped, unless given.
IDLE_MS = 24 * 3600 * 1000


def read_frames(spark, path: str, schema: str = "conn long, seq long, json string", files_per_batch: int = 64) -> DataFrame:
    """Typed frames from JSON files; files per micro-batch bound what one batch holds."""
    lines = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)
    return parse_frames(lines)


def with_event_time(frames: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Event time as an instant, with a watermark."""
    return frames.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def page_state(frames: DataFrame) -> DataFrame:
    """Latest page of each connection; for update mode."""
    return frames.where(F.col("type").isin("rendered", "nav")).groupBy("conn").agg(F.max_by(F.struct("page", "seq"), "seq").alias("s")).select("conn", "s.page", "s.seq")


def replay_latest(frames: DataFrame, topics: tuple[str, ...] = ("hello", "content.begin")) -> DataFrame:
    """Last frame of each replayed topic; for update mode."""
    return frames.where(F.col("type").isin(*topics)).groupBy("type").agg(F.max_by(F.struct("conn", "seq"), "seq").alias("s")).select("type", "s.*")


def unique_frames(frames: DataFrame, ts: str = "ts") -> DataFrame:
    """Frames that a reconnect sent again, once; needs a watermark."""
    return frames.dropDuplicatesWithinWatermark(["conn", "seq"])


def activity(frames: DataFrame, gap: str = "30 minutes", ts: str = "ts") -> DataFrame:
    """Sessions of a connection without a pause of ``gap``; needs a watermark."""
    return frames.groupBy("conn", F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("frames")).select("conn", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "frames")


class ConnectionRule:
    """A fold over a connection's frames: ``step`` takes the state and a frame and gives the new state and, maybe,
    what to put out."""

    STATE = SCHEMA = ""
    COLUMNS: list[str] = []

    def start(self) -> tuple:
        raise NotImplementedError

    def step(self, state: tuple, row: Any) -> tuple[tuple, tuple | None]:
        raise NotImplementedError


class HandshakeGate(ConnectionRule):
    """Frames of a connection from its first hello on."""

    STATE, COLUMNS, SCHEMA = "said boolean", ["conn", "seq", "type"], "conn long, seq long, type string"

    def start(self):
        return (False,)

    def step(self, state, row):
        said = bool(state[0]) or row.type == "hello"
        return (said,), ((int(row.seq), row.type) if said else None)


class PairPageBinary(ConnectionRule):
    """Each binary frame with the page frame right before it."""

    STATE, COLUMNS, SCHEMA = "meta long", ["conn", "seq", "meta_seq"], "conn long, seq long, meta_seq long"

    def start(self):
        return (-1,)

    def step(self, state, row):
        if row.type == "page":
            return (int(row.seq),), None
        if row.type == "binary":
            return (-1,), ((int(row.seq), int(state[0])) if state[0] >= 0 else None)
        return state, None


class CurrentContent(ConnectionRule):
    """Receipts whose content id is the one begun last."""

    STATE, COLUMNS, SCHEMA = "begun long", ["conn", "seq", "content_id"], "conn long, seq long, content_id long"

    def start(self):
        return (-2,)

    def step(self, state, row):
        if row.type == "content.begin":
            return (int(row.content_id),), None
        good = row.type == "rendered" and not pd.isna(row.content_id) and int(row.content_id) == state[0]
        return state, ((int(row.seq), int(row.content_id)) if good else None)


class InFlightGate(ConnectionRule):
    """Asks that are taken while none is unanswered; ``seq`` is the turn, ``type`` the role."""

    STATE, COLUMNS, SCHEMA = "busy boolean", ["conn", "seq"], "conn long, seq long"

    def start(self):
        return (False,)

    def step(self, state, row):
        if row.type == "user":
            return (True,), (None if state[0] else (int(row.seq),))
        return ((False,) if row.type == "assistant" else state), None


class AckThrottle(ConnectionRule):
    """One live frame in flight until its receipt or 1,200 ms, 500 ms apart at least; rows carry ``ms``."""

    STATE, COLUMNS, SCHEMA = "last long, busy boolean", ["conn", "seq", "sent"], "conn long, seq long, sent boolean"
    GAP_MS, WAIT_MS = 500, 1200

    def start(self):
        return (-1, False)

    def step(self, state, row):
        last, busy = int(state[0]), bool(state[1])
        if row.type == "rendered":
            return (last, False), None
        if busy and row.ms - last > self.WAIT_MS:
            busy = False
        send = not busy and (last < 0 or row.ms - last >= self.GAP_MS)
        return ((int(row.ms), True) if send else (last, busy)), (int(row.seq), send)


def by_connection(frames: DataFrame, rule: ConnectionRule, idle_ms: int = IDLE_MS) -> DataFrame:
    """A rule over a stream of frames; for append mode.

    A connection without frames for ``idle_ms`` of processing time counts as closed: what it sends later starts anew.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        if kept.hasTimedOut:
            kept.remove()
            return
        state = tuple(kept.get) if kept.exists else rule.start()
        out = []
        for row in pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
            state, made = rule.step(state, row)
            if made is not None:
                out.append((key[0], *made))
        kept.update(state)
        kept.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=rule.COLUMNS)

    return frames.groupBy("conn").applyInPandasWithState(run, rule.SCHEMA, rule.STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


class JobDeadline(StatefulProcessor):
    """The state of a job whenever it changes, and ``timeout`` once the watermark passes ``limit_ms`` after its first
    poll without an end: a timer brings that out, no further poll of the job is needed."""

    SCHEMA = "job string, state string"

    def __init__(self, limit_ms: int):
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "first long, ms long, seq long, state string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first, ms, seq, state = self.seen.get() if self.seen.exists() else (None, None, None, None)
        before = state
        for batch in rows:
            for row in batch.sort_values(["ms", "seq"]).itertuples(index=False):
                first = int(row.ms) if first is None else min(first, int(row.ms))
                if ms is None or (int(row.ms), int(row.seq)) >= (ms, seq):
                    ms, seq, state = int(row.ms), int(row.seq), str(row.state)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.seen.update((first, ms, seq, state))
        if state not in ("done", "failed"):
            # a poll at the limit or after it is too late already
            if ms - first >= self.limit_ms:
                state = "timeout"
                self.seen.update((first, ms, seq, state))
            else:
                self.handle.registerTimer(first + self.limit_ms)
        yield pd.DataFrame({"job": [key[0]], "state": [state]} if state != before else {"job": [], "state": []})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        first, ms, seq, _ = self.seen.get()
        self.seen.update((first, ms, seq, "timeout"))
        yield pd.DataFrame({"job": [key[0]], "state": ["timeout"]})

    def close(self) -> None:
        pass


def job_status(polls: DataFrame, limit_s: int, late: str = "0 seconds") -> DataFrame:
    """job, state of a stream of polls (job, ts, seq, state), as ``JobDeadline`` puts them out; for update mode.

    Needs the RocksDB state store: ``spark.sql.streaming.stateStore.providerClass``.
    """
    timed = with_event_time(polls, "ts", late).select(F.col("job").cast("string"), "ts", F.unix_millis("ts").alias("ms"), F.col("seq").cast("long"), F.col("state").cast("string"))
    return timed.groupBy("job").transformWithStateInPandas(JobDeadline(limit_s * 1000), JobDeadline.SCHEMA, "Update", "EventTime")
