"""The engine over a stream with a timer for each turn.

A session's state is its controller state and a map from each open utterance to the time at which it is given up, with a timer for each such time. A turn
that is open for ``turn_ms`` ends as degraded while other turns of its session go on; what was held of it goes. A session without events for
``session_ms`` loses its state, and its open turns end as degraded. Fragments that come after a turn was given up open a new turn.

Spark calls the processor once a session and micro-batch; timers run in processing time. The state store must be RocksDB
(``ROCKSDB`` for ``spark.sql.streaming.stateStore.providerClass``), which keeps states on disk and their changes in the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from json import dumps, loads
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from evidora.config import Controller
from evidora.operators.controller import Session, Vocabulary, degraded, step
from evidora.streaming.engine import _NAMES, ROWS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WHOLE = ""  # the map's entry for the session itself


class Turns(StatefulProcessor):
    def __init__(self, turn_ms: int = 15_000, session_ms: int = 15 * 60 * 1000, mode: str = "streaming", known: Vocabulary = Vocabulary(), own: Controller = Controller()):
        self.turn_ms, self.session_ms, self.mode, self.known, self.own = turn_ms, session_ms, mode, known, own

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("session", "state string, n long")
        self.due = handle.getMapState("due", "utterance_id string", "at long")

    def _load(self) -> tuple[Session, int]:
        if not self.kept.exists():
            return Session(), 0
        saved, n = self.kept.get()
        return Session.of_json(loads(saved)), n

    def _deadlines(self) -> dict[str, int]:
        return {key[0]: value[0] for key, value in self.due.iterator()}

    def _set(self, due: dict[str, int], name: str, at: int | None) -> None:
        """Give ``name`` the deadline ``at``, or none; a timer stays as long as some entry needs it."""
        was = due.pop(name, None)
        if at is None:
            if was is not None:
                self.due.removeKey((name,))
        else:
            self.due.updateValue((name,), (at,))
            due[name] = at
            if at not in self.handle.listTimers():
                self.handle.registerTimer(at)
        if was is not None and was != at and was not in due.values() and was in self.handle.listTimers():
            self.handle.deleteTimer(was)

    def _save(self, session: Session, n: int, due: dict[str, int]) -> None:
        """Sessions that hold nothing have no state."""
        if session.open or session.answered:
            self.kept.update((dumps(session.to_json()), n))
            return
        self.kept.clear()
        for name in list(due):
            self._set(due, name, None)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        session, n = self._load()
        pdf = pd.concat(list(rows)).sort_values(["timestamp_ms", "seq"], kind="stable")
        out: list[dict] = []
        for event in pdf.astype(object).where(pdf.notna(), None).to_dict("records"):
            for row in step(session, event, self.mode, self.known, self.own):
                out.append(row | {"session_id": key[0], "seq": n})
                n += 1
        now, due = timerValues.getCurrentProcessingTimeInMs(), self._deadlines()
        for name in set(due) - set(session.open) - {WHOLE}:
            self._set(due, name, None)
        for name in set(session.open) - set(due):
            self._set(due, name, now + self.turn_ms)
        self._set(due, WHOLE, now + self.session_ms)
        self._save(session, n, due)
        yield framed(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        session, n = self._load()
        due = self._deadlines()
        over = {name for name, then in due.items() if then <= at}
        gone = set(session.open) if WHOLE in over else over
        rows = [row | {"session_id": key[0], "seq": n + k} for k, row in enumerate(degraded(session, gone))]
        for name in gone:
            session.open.pop(name, None)
        for name in over | (gone & set(due)):
            self._set(due, name, None)
        if WHOLE in over:
            session.answered, session.topic = [], ""
        self._save(session, n + len(rows), due)
        yield framed(rows)

    def close(self) -> None:
        """Nothing is held outside the state."""


def framed(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame([{c: r.get(c) for c in _NAMES} for r in rows], columns=_NAMES).astype({"seq": "int64", "ts_ms": "Int64"})


def stream(events: DataFrame, turn_ms: int = 15_000, session_ms: int = 15 * 60 * 1000, mode: str = "streaming", known: Vocabulary = Vocabulary(), own: Controller = Controller()) -> DataFrame:
    """Rows of ROWS, as ``engine.stream``, over a streaming DataFrame."""
    return events.groupBy("session_id").transformWithStateInPandas(Turns(turn_ms, session_ms, mode, known, own), ROWS, "append", "processingTime")
