"""Sessions of events that name none, in a stream.

An event without a session belongs to the last one that its source named before it, else to 'default'. Events may come late, up to a watermark's delay:
they wait in the source's state until the watermark has passed them, and are then given out in order, each with its session. ``engine.with_session`` does
the same in batch. The state store must be RocksDB (``turns.ROCKSDB``).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENT = "source string, session_id string, timestamp_ms long, seq long, event_type string, utterance_id string, text string"
_NAMES = [x.split()[0] for x in EVENT.split(", ")]


def _place(event: tuple) -> tuple:
    """By time and number, those without a session first, as the batch form has it."""
    return event[2], event[3], event[1] is not None, event[1] or ""


class LastSession(StatefulProcessor):
    """State of a source: the session named last, and the events that the watermark hasn't passed, at most those of the delay."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "session_id string")
        self.waiting = handle.getListState("waiting", EVENT)

    def _wake(self, at: int) -> None:
        """One timer a source, at its earliest waiting event."""
        timers = list(self.handle.listTimers())
        if not timers or at < min(timers):
            for old in timers:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(at)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            events = [tuple(None if pd.isna(v) else v for v in r) for r in pdf[_NAMES].astype(object).itertuples(index=False)]
            events = [(*e[:2], int(e[2]), int(e[3] or 0), *e[4:]) for e in events]
            self.waiting.appendList(events)
            self._wake(min(e[2] for e in events))
        yield framed([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        events = [tuple(e) for e in self.waiting.get()]
        ready, rest = sorted((e for e in events if e[2] <= passed), key=_place), [e for e in events if e[2] > passed]
        name = self.last.get()[0] if self.last.exists() else None
        out = []
        for event in ready:
            name = event[1] if event[1] is not None else name
            out.append((event[0], name if name is not None else "default", *event[2:]))
        if name is not None:
            self.last.update((name,))
        if rest:
            self.waiting.put(rest)
            self._wake(min(e[2] for e in rest))
        else:
            self.waiting.clear()
        yield framed(out)

    def close(self) -> None:
        """Nothing is held outside the state."""


def framed(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_NAMES).astype({"timestamp_ms": "int64", "seq": "int64"})


def with_session(events: DataFrame, late: str = "10 seconds") -> DataFrame:
    """A stream of EVENT with sessions. Events without a time are left out; those later than the delay are dropped, as by any watermark. Rows are
    given out when the watermark has passed them, so they carry none on:
    stateful steps read them from a table or topic between, in a query of their own."""
    timed = events.filter("timestamp_ms IS NOT NULL").select(*_NAMES, F.timestamp_millis("timestamp_ms").alias("at")).withWatermark("at", late)
    return timed.groupBy("source").transformWithStateInPandas(LastSession(), EVENT, "append", "eventTime")
