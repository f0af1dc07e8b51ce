"""One timer a turn, with a clock of the test's own and in a stream; evidence that is taken back across micro-batches."""

import time
from collections import Counter

import pandas as pd
import pytest

from evidora.session import scratch
from evidora.streaming import engine, evidence, turns


class Value:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class Map(dict):
    def iterator(self):
        return iter(list(self.items()))

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        del self[key]


class Handle:
    """The state of one session, and a clock."""

    def __init__(self):
        self.now, self.timers, self.value, self.map = 0, set(), Value(), Map()

    def getValueState(self, *_):
        return self.value

    def getMapState(self, *_):
        return self.map

    def listTimers(self):
        return iter(sorted(self.timers))

    def registerTimer(self, at):
        assert at not in self.timers
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def getCurrentProcessingTimeInMs(self):
        return self.now


class Expired:
    def __init__(self, at):
        self.at = at

    def getExpiryTimeInMs(self):
        return self.at


class Clock:
    """Runs a processor: events come at a time, and timers go off in order before them."""

    def __init__(self, **settings):
        self.handle, self.processor, self.rows = Handle(), turns.Turns(**settings), []
        self.processor.init(self.handle)

    def until(self, now):
        while due := [t for t in self.handle.timers if t <= now]:
            at = min(due)
            self.handle.timers.remove(at)  # as Spark does before it calls
            self.handle.now = at
            self._take(self.processor.handleExpiredTimer(("s",), self.handle, Expired(at)))
        self.handle.now = now

    def events(self, now, *rows):
        self.until(now)
        frame = pd.DataFrame([("s", uid, k, now, kind, text) for k, (uid, kind, text) in enumerate(rows)], columns="session_id utterance_id seq timestamp_ms event_type text".split())
        self._take(self.processor.handleInputRows(("s",), iter([frame]), self.handle))

    def _take(self, frames):
        for f in frames:
            self.rows += [r for r in f.to_dict("records")]

    def ended(self):
        return [(r["utterance_id"], r["reason"] == "degraded") for r in self.rows if r["row"] == "turn"]


ASK = "What is the warranty period of the blue pump model in Berlin?"


def test_a_turn_is_given_up_while_another_goes_on():
    c = Clock(turn_ms=15_000, session_ms=60_000)
    c.events(0, ("u1", "transcript_chunk", ASK))
    c.events(9_000, ("u2", "transcript_chunk", "How do I reset the red valve controller?"))
    c.until(14_999)
    assert c.ended() == []
    c.until(15_000)
    assert c.ended() == [("u1", True)] and set(c.handle.map) == {("u2",), ("",)} and "u1" not in c.handle.value.value[0].split('"answered"')[0]
    c.events(20_000, ("u2", "transcript_chunk", " And what does it cost?"), ("u2", "utterance_end", None))
    c.until(40_000)
    assert c.ended() == [("u1", True), ("u2", False)] and [r["seq"] for r in c.rows] == list(range(len(c.rows)))


def test_a_degraded_turn_takes_its_searches_back():
    c = Clock(turn_ms=1000)
    c.events(0, ("u1", "transcript_chunk", ASK + " "), ("u1", "transcript_chunk", "It failed yesterday in the main hall of the factory."))
    asked = {r["query_id"] for r in c.rows if r["row"] == "query"}
    c.until(1000)
    (turn,) = [r for r in c.rows if r["row"] == "turn"]
    assert asked and asked <= set(turn["cancelled"]) and len(turn["live"]) == 0


def test_later_fragments_do_not_put_off_the_deadline_and_the_session_goes_at_last():
    c = Clock(turn_ms=5_000, session_ms=20_000)
    for at in (0, 2_000, 4_000):
        c.events(at, ("u1", "transcript_chunk", f"part {at} "))
    c.until(5_000)
    assert c.ended() == [("u1", True)]
    c.events(6_000, ("u1", "transcript_chunk", "again"))  # opens a new turn
    c.until(11_000)
    assert c.ended() == [("u1", True), ("u1", True)]
    c.events(12_000, ("u3", "transcript_chunk", ASK), ("u3", "utterance_end", None))
    c.until(31_999)
    assert c.handle.value.exists()
    c.until(32_000)
    assert not c.handle.value.exists() and not c.handle.map and not c.handle.timers


def test_many_turns_with_one_deadline_share_a_timer():
    c = Clock(turn_ms=100, session_ms=10_000)
    c.events(0, *((f"u{k}", "transcript_chunk", "hello there pump") for k in range(20)))
    assert len(c.handle.timers) == 2
    c.events(50, *((f"u{k}", "utterance_end", None) for k in range(19)))
    c.until(100)
    assert Counter(lost for _, lost in c.ended()) == {False: 19, True: 1} and set(c.handle.map) <= {("",)}


def test_timers_in_a_stream(spark, tmp_path):
    """Both turns of the first files outlive their time before the last file comes; without timeouts the rows are the engine's."""
    schema = "session_id string, utterance_id string, seq long, timestamp_ms long, event_type string, text string"
    parts = [[("a", "u1", 0, 0, "transcript_chunk", ASK), ("b", "u1", 0, 0, "transcript_chunk", ASK)], [("a", "u2", 1, 10, "transcript_chunk", ASK), ("a", "u2", 2, 11, "utterance_end", None)], [("c", "u9", 0, 20, "transcript_chunk", ASK)]]
    files = str(tmp_path / "in")
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(files)
    batch = engine.replay(spark.createDataFrame(sum(parts, []), schema)).collect()
    given_up = lambda rows: {(r.session_id, r.utterance_id) for r in rows if r.row == "turn" and r.reason == "degraded"}
    done = {"short": lambda rows: {("a", "u1"), ("b", "u1"), ("c", "u9")} <= given_up(rows), "long": lambda rows: len(rows) >= len(batch)}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", turns.ROCKSDB)
    try:
        got = {}
        for name, turn_ms in (("short", 1), ("long", 10**9)):
            source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(files)
            q = turns.stream(source, turn_ms=turn_ms).writeStream.format("memory").queryName(f"timed_{name}").outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
            until = time.time() + 90
            # processing-time timers always ask for another batch, so that the stream doesn't end by itself
            while time.time() < until and q.exception() is None and not done[name](got.setdefault(name, spark.table(f"timed_{name}").collect())):
                time.sleep(1)
                del got[name]
            q.stop()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert given_up(got["short"]) == {("a", "u1"), ("b", "u1"), ("c", "u9")}
    own = lambda rows: sorted((r.session_id, r.seq, r.row, r.query_id or "", r.text or "") for r in rows)
    assert own(got["long"]) == own(batch)


SCHEMA = "session_id string, asked_id string, ord long, score double"
GONE = "session_id string, query_id string"


@pytest.fixture
def table(spark):
    return evidence.EvidenceTable(spark, scratch(spark, "t-evidence"), SCHEMA)


def told(table, **k):
    return sorted((r.session_id, r.asked_id or "", r.ord, r.batch) for r in table.current(**k).collect())


def put(spark, table, number, rows, gone=()):
    table.sink(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(list(gone), GONE), number)


def test_evidence_is_taken_back_later(spark, table):
    assert told(table) == []
    put(spark, table, 1, [("s", "q1", 5, 1.0), ("s", "q1", 6, 0.5), ("t", "q1", 5, 1.0)])
    put(spark, table, 2, [("s", "q2", 7, 1.0), (None, None, 1, 1.0)])
    put(spark, table, 3, [("s", "q3", 8, 1.0)], [("s", "q1"), ("s", "q9")])
    expect = [("s", "q2", 7, 2), ("s", "q3", 8, 3), ("t", "q1", 5, 1)]
    assert [r for r in sorted((r.session_id or "", r.asked_id or "", r.ord, r.batch) for r in table.current().collect()) if r[1]] == expect
    assert ("s", "q1", 5, 1) in [(r.session_id, r.asked_id, r.ord, r.batch) for r in table.current(through=2).collect()]


def test_a_batch_run_again_changes_nothing(spark, table):
    put(spark, table, 0, [("s", "q1", 1, 1.0)])
    put(spark, table, 1, [("s", "q2", 2, 1.0)], [("s", "q1")])
    before = told(table)
    for _ in range(2):
        put(spark, table, 0, [("s", "q1", 1, 1.0)])
        put(spark, table, 1, [("s", "q2", 2, 1.0)], [("s", "q1")])
    assert told(table) == before == [("s", "q2", 2, 1)]
    assert table.compact() == 1
    put(spark, table, 0, [("s", "q1", 1, 1.0)])
    assert told(table) == before


def test_compaction_keeps_what_counts_and_later_batches_work_on_it(spark, table):
    put(spark, table, 0, [("s", "q1", 1, 1.0), ("s", "q2", 2, 1.0)])
    put(spark, table, 1, [("s", "q2", 3, 1.0)])  # a later version of the same query's evidence
    assert told(table) == [("s", "q1", 1, 0), ("s", "q2", 3, 1)]
    assert table.compact() == 1 and table.compact() == 1
    assert told(table) == [("s", "q1", 1, 0), ("s", "q2", 3, 1)]
    put(spark, table, 2, [("s", "q4", 4, 1.0)], [("s", "q2")])
    put(spark, table, 3, [("s", "q1", 9, 1.0)], [])
    assert told(table) == [("s", "q1", 9, 3), ("s", "q4", 4, 2)]
    assert table.compact() == 3 and told(table) == [("s", "q1", 9, 3), ("s", "q4", 4, 2)]
    with pytest.raises(ValueError):
        table.current(through=1)


def test_a_half_written_batch_does_not_count(spark, table):
    put(spark, table, 0, [("s", "q1", 1, 1.0)])
    spark.createDataFrame([("s", "q1", 2, 1.0)], SCHEMA).write.parquet(f"{table.folder}/evidence/batch-1")
    assert told(table) == [("s", "q1", 1, 0)]
    put(spark, table, 1, [("s", "q1", 2, 1.0)])
    assert told(table) == [("s", "q1", 2, 1)]
