"""Scans over blocks, sessions made again and inferred, spans, and the replay source."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from evidora.operators import scans, spoken
from evidora.session import scratch
from evidora.sources import replay
from evidora.streaming import engine, sessions, turns


def some_rows(n=400, seed=3):
    rng = random.Random(seed)
    return [(rng.choice(["hot", "hot", "hot", "a", None]), rng.choice([None, *range(-40, 300)]), i, rng.choice([None, None, None, f"s{i:03}"])) for i in range(n)]


PLACE = {None: -(10**9)}


@pytest.mark.parametrize("width", [1, 7, 10_000])
def test_last_known_carries_over_blocks_and_groups_of_null(spark, width):
    rows = some_rows()
    got = scans.last_known(spark.createDataFrame(rows, "source string, t long, i long, v string"), ["source"], "t", ["t", "i"], "v", "known", width)
    want, last = {}, {}
    for source, t, i, v in sorted(rows, key=lambda r: (PLACE.get(r[1], r[1]), r[2])):
        last[source] = v if v is not None else last.get(source)
        want[i] = last[source]
    assert {r.i: r.known for r in got.collect()} == want and got.columns == ["source", "t", "i", "v", "known"]


@pytest.mark.parametrize("width", [1, 9, 10_000])
def test_serial_ends_equal_a_loop(spark, width):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "a"]), i, rng.choice([None, *range(0, 2000)]), rng.choice([None, *range(12)])) for i in range(300)]
    got = scans.serial_ends(spark.createDataFrame(rows, "g string, i long, a long, d long"), ["g"], "i", "a", "d", "ended", width)
    clock, want = {}, {}
    for g, i, a, d in rows:
        clock[g] = max(clock.get(g, 0), a or 0) + (d or 0)
        want[i] = clock[g]
    assert {r.i: r.ended for r in got.collect()} == want


def test_numbered_and_as_of(spark):
    rows = some_rows(seed=8)
    df = spark.createDataFrame(rows, "source string, t long, i long, v string")
    got = {r.i: r.n for r in scans.numbered(df, ["source"], "t", ["t", "i"], "n", 11).collect()}
    for source in ("hot", "a", None):
        mine = sorted((r for r in rows if r[0] == source), key=lambda r: (PLACE.get(r[1], r[1]), r[2]))
        assert [got[r[2]] for r in mine] == list(range(len(mine)))
    right = [("hot", 10, "x"), ("hot", 10, "y"), ("hot", 50, None), ("a", -5, "z"), (None, 0, "n")]
    told = {r.i: r.found for r in scans.as_of(df, spark.createDataFrame(right, "source string, t long, w string"), ["source"], "t", "w", "found", 13).collect()}
    assert len(told) == len(rows)
    for source, t, i, _ in rows:
        before = [(at, w or "") for s, at, w in right if s == source and t is not None and at <= t]
        assert (told[i] or "") == (max(before)[1] if before else ""), (source, t)
    assert scans.numbered(df.limit(0), [], "t", ["t"], "n").count() == 0


def test_with_session_of_one_hot_source(spark):
    rows = [("x", "s1" if i == 0 else "s2" if i == 700 else None, i * 10, i) for i in range(1000)] + [("y", None, 5, 0)]
    events = spark.createDataFrame(rows, "source string, session_id string, timestamp_ms long, seq long")
    got = {(r.source, r.seq): r.session_id for r in engine.with_session(events, 500).collect()}
    assert got[("y", 0)] == "default" and all(got[("x", i)] == ("s1" if i < 700 else "s2") for i in range(1000))


def test_restream_puts_a_chunk_before_a_hypothesis(spark):
    kinds = "session_id string, timestamp_ms long, seq long, text string"
    chunks = spark.createDataFrame([("a", 100, 0, "one"), ("a", 200, 1, " two"), ("b", 50, 0, "x")], kinds)
    guesses = spark.createDataFrame([("a", 100, 0, "one or"), ("a", 40, 1, "on"), ("a", 150, 2, ""), ("a", 200, 3, "late"), ("c", 1, 0, "nobody"), ("a", 120, 4, None)], kinds)
    got = [tuple(r) for r in spoken.restreamed(chunks, guesses, 60).orderBy("session_id", "seq").collect()]
    assert got == [
        ("a", 0, 0, "session_start", None, None), ("a", 1, 40, "transcript_hypothesis", "on", None), ("a", 2, 100, "transcript_chunk", "one", None),
        ("a", 3, 100, "transcript_hypothesis", "one or", 100), ("a", 4, 200, "transcript_chunk", " two", None), ("a", 5, 201, "utterance_end", None, None),
        ("a", 6, 2200, "session_end", None, None), ("b", 0, 0, "session_start", None, None), ("b", 1, 50, "transcript_chunk", "x", None),
        ("b", 2, 51, "utterance_end", None, None), ("b", 3, 2050, "session_end", None, None),
    ]
    assert spoken.restreamed(chunks.limit(0), guesses).count() == 0


def test_best_spans_equal_all_pairs(spark):
    rng = random.Random(2)
    rows = [(q, 10 * q + p, [float(rng.randint(-9, 9)) for _ in range(n)], [float(rng.randint(-9, 9)) for _ in range(n)]) for q, n in enumerate([1, 2, 30, 60, 60]) for p in range(3)]
    rows += [(9, 90, [1.0, None, float("nan"), 2.0], [0.0, 5.0, 5.0, None]), (8, 80, None, None), (7, 70, [], [])]
    got = {r.query_id: tuple(r) for r in spoken.best_spans(spark.createDataFrame(rows, "query_id long, passage long, starts array<double>, ends array<double>"), 5, 8).collect()}
    want = {}
    for q in range(5):
        found = []
        for _, p, s, e in (r for r in rows if r[0] == q):
            starts, ends = (sorted(range(1, len(x)), key=lambda i: (-x[i], i))[:8] for x in (s, e))  # noqa: B023
            found += [(-(s[i] + e[j]), p, i, j) for i in starts for j in ends if i <= j < i + 5]
        if found:
            low, p, i, j = min(found)
            want[q] = (q, -low - min(r[2][0] + r[3][0] for r in rows if r[0] == q), -low, p, i, j)
    assert got == want and 4 in got and 0 not in got


def test_longest_prefix_equals_brute_force_with_a_hot_stem(spark):
    rng = random.Random(6)
    titles = [(k, "the " + "".join(rng.choice("ab ") for _ in range(rng.randint(0, 6)))) for k in range(60)] + [(100, "ze"), (101, "ze"), (102, ""), (103, None), (104, "été 😀")]
    texts = [(k, "the " + "".join(rng.choice("ab ") for _ in range(rng.randint(0, 12)))) for k in range(300)]
    texts += [(900, None), (901, ""), (902, "z"), (903, "zebra"), (904, "été 😀!"), (905, "zebra"), (905, "zebra")]
    got = spoken.longest_prefix(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(titles, "title_id long, title string"))
    want = []
    for i, text in texts:
        fit = [(-len(t), k, t) for k, t in titles if t and (text or "").startswith(t)]
        want.append((i, text, *(min(fit)[1:] if fit else (None, None))))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert [r.title for r in spoken.longest_prefix(got.select("id", "text").limit(3), spark.createDataFrame([], "title_id long, title string")).collect()] == [None] * 3


@pytest.fixture
def staged(spark):
    spark.dataSource.register(replay.ReplaySource)
    rows = [(f"s{i % 13}", i // 3, i, "transcript_chunk", f"t{i}") for i in range(1000)] + [(None, 5, -1, "utterance_end", None)]
    folder = scratch(spark, "replay-test")
    replay.stage(spark.createDataFrame(rows, "session_id string, timestamp_ms long, seq long, event_type string, text string"), folder, rows=100, shares=4, width=50)
    return folder, rows


def test_replay_source_loses_and_repeats_nothing_over_a_restart(spark, staged):
    folder, rows = staged
    offsets, batches = scratch(spark, "replay-offsets"), []

    def run(fail_at=None):
        def take(df, number):
            got = [tuple(r) for r in df.collect()]
            if fail_at == len(batches):
                raise ValueError("lost")
            if got:
                batches.append(got)

        source = spark.readStream.format("evidora_replay").option("path", folder).option("steps", 2).option("shares", 4).load()
        query = source.writeStream.foreachBatch(take).option("checkpointLocation", offsets).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    with pytest.raises(Exception, match="lost"):
        run(fail_at=2)
    assert len(batches) == 2
    run()
    assert [len(b) for b in batches] == [200] * 5 + [1]  # admission: two steps of 100 rows each
    assert sorted((r for b in batches for r in b), key=lambda r: r[2]) == sorted(rows, key=lambda r: r[2])
    flat = [r[1] for b in batches for r in sorted(b, key=lambda r: r[1])]
    assert flat == sorted(flat)
    run()  # nothing new after a clean stop
    assert len(batches) == 6


def test_replay_reader_reads_its_share_only(spark, staged):
    folder, rows = staged
    reader = replay.ReplaySource({"path": folder, "steps": "100", "shares": "4"})
    parts = reader.streamReader(reader.schema())
    assert parts.latestOffset() == {"step": 11}
    plan = parts.partitions({"step": 0}, {"step": 11})
    by_share = [[x for b in parts.read(p) for x in b.to_pylist()] for p in plan]
    assert sum(map(len, by_share)) == len(rows)
    names = [{x["session_id"] for x in s} for s in by_share]
    assert sum(map(len, names)) == len(set.union(*names)) == 14
    assert parts.latestOffset() == {"step": 11} and parts.partitions({"step": 11}, {"step": 11}) == []


def test_sessions_inferred_in_a_stream_of_late_events(spark):
    """Batch by batch, some events late within the delay: the rows are those of the batch form."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", turns.ROCKSDB)
    rng = random.Random(4)
    rows = [("ab"[i % 2], rng.choice([None, None, None, f"s{i}"]), 1000 + i * 400, i, "transcript_chunk", f"u{i}", f"word{i}") for i in range(120)]
    heard = sorted(rows, key=lambda r: r[2] + rng.randint(0, 4000))
    last, after = ([("ab"[k], None, at + k, 1000 + k, "utterance_end", "u", None) for k in (0, 1)] for at in (10_000_000, 20_000_000))
    files = scratch(spark, "late")
    spark.createDataFrame([], sessions.EVENT).write.parquet(files)
    try:
        source = spark.readStream.schema(sessions.EVENT).parquet(files)
        query = sessions.with_session(source, "5 seconds").writeStream.format("memory").queryName("inferred").option("checkpointLocation", scratch(spark, "late-offsets")).start()
        for part in (heard[:40], heard[40:90], heard[90:], last, after):
            spark.createDataFrame(part, sessions.EVENT).coalesce(1).write.mode("append").parquet(files)
            query.processAllAvailable()
        query.stop()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {r.seq: r.session_id for r in spark.table("inferred").filter("seq < 1000").collect()}
    want = {r.seq: r.session_id for r in engine.with_session(spark.createDataFrame(rows, sessions.EVENT), 3000).collect()}
    assert got == want


class Held:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def put(self, rows):
        self.value = list(rows)

    def appendList(self, rows):
        self.value = [*(self.value or []), *rows]

    def clear(self):
        self.value = None


class Clock:
    """State and timers of one source."""

    def __init__(self):
        self.value, self.rows, self.timers, self.at = Held(), Held(), set(), 0

    def getValueState(self, *_):
        return self.value

    def getListState(self, *_):
        return self.rows

    def listTimers(self):
        return iter(sorted(self.timers))

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)

    def getCurrentWatermarkInMs(self):
        return self.at

    def getExpiryTimeInMs(self):
        return self.at


def test_events_wait_for_the_watermark(spark):
    clock, source = Clock(), sessions.LastSession()
    source.init(clock)
    names = [x.split()[0] for x in sessions.EVENT.split(", ")]

    def put(*rows):
        list(source.handleInputRows(("x",), iter([pd.DataFrame(rows, columns=names)]), clock))

    def pass_(at):
        clock.at = at
        due = [t for t in clock.timers if t <= at]
        clock.timers -= set(due)
        return [tuple(r) for t in due for pdf in source.handleExpiredTimer(("x",), clock, clock) for r in pdf[["seq", "session_id"]].itertuples(index=False)]

    put(("x", None, 30, 3, "e", None, None), ("x", "s1", 10, 1, "e", None, None))
    put(("x", None, 20, 2, "e", None, None))
    assert clock.timers == {10}
    assert pass_(9) == [] and pass_(20) == [(1, "s1"), (2, "s1")]
    assert clock.timers == {30} and len(clock.rows.value) == 1
    put(("x", "s2", 25, 9, "e", None, None))
    assert pass_(40) == [(9, "s2"), (3, "s2")]
    assert clock.rows.value is None and not clock.timers
    assert pass_(50) == []
