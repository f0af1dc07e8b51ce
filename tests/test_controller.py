"""The controller and the engine: batch, stream and mode give the same answers; spoken numbers; agreement."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from evidora.config import DEGRADED_ANSWER, DEGRADED_DOUBT, RECORD_FIELDS, Config, Controller
from evidora.functions.numbers import spoken_numbers, word_errors
from evidora.operators.controller import Session, Vocabulary, decide, decompose, hypothesis_rest, preview, split_unpunctuated, step
from evidora.plans import conversation_queries as Q
from evidora.streaming import engine, sinks
from tests.conftest import SMALL


def say(text, words=3):
    parts = text.split()
    out = [{"event_type": "transcript_chunk", "utterance_id": "u1", "timestamp_ms": 100 * i, "text": ("" if i == 0 else " ") + " ".join(parts[i : i + words])} for i in range(0, len(parts), words)]
    return [*out, {"event_type": "utterance_end", "utterance_id": "u1", "timestamp_ms": 10_000}]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("I need the refund policy, the catering options, and parking", ["refund policy", "catering options refund policy"]),
        ("What is the capacity of Venue B, and when was it built?", ["capacity of Venue B", "when was it built? capacity venue"]),
        ("Along with diesel engines, what engines have overtaken steam?", ["Along with diesel engines, what engines have overtaken steam?"]),
        ("", []),
    ],
)
def test_decompose(text, expected):
    assert [q.text for q in decompose(text, set(), "u1", "final", 0)] == expected


def test_covered_clauses_are_not_asked_again():
    assert decompose("the refund policy", {"refund", "policy"}, "u1", "final", 0) == []


def test_growing_clause_supersedes():
    s = Session()
    rows = [r for e in say("Before which 1227 event did Chagatai publicly dispute the paternity of Jochi?") for r in step(s, e)]
    turn = rows[-1]
    assert turn["row"] == "turn" and len(turn["live"]) == 1 and turn["cancelled"]


def test_kinds():
    assert decide(Session(), "a", "thanks a lot", False).kind == "chit_chat"
    assert decide(Session(), "a", "repeat that in two bullets", False).reason == "presentation_without_answer"
    assert decide(Session(), "a", "Summarize the travel reimbursement rule", True).decision == "retrieve"


def test_refinement_has_a_parent():
    s = Session()
    for e in say("What is the refund policy for group bookings?"):
        step(s, e)
    rows = [r for e in say("Actually, what about refund deadlines for group bookings abroad?") for r in step(s, e | {"utterance_id": "u2"})]
    queries = [r for r in rows if r["row"] == "query"]
    assert queries and all(q["trigger"] == "refinement" for q in queries) and any(q["parent"] for q in queries)


def test_preview_changes_nothing():
    s = Session()
    decide(s, "u1", "the 2024 refund policy", False)
    before = json.dumps(s.to_json())
    assert preview(s, "u1", " and the parking fees") and json.dumps(s.to_json()) == before
    assert hypothesis_rest("a b", "a b c d") == "c d" and hypothesis_rest("a b", "a x c") is None


def test_bad_events_never_stop():
    s = Session()
    assert step(s, {"event_type": None})[0]["row"] == "error"
    assert step(s, {"event_type": "dance", "utterance_id": "u", "timestamp_ms": 1})[0]["reason"] == "unknown event type"
    assert step(s, {"event_type": "utterance_end", "utterance_id": "u", "timestamp_ms": 1})[-1]["row"] == "turn"


def test_sessions_are_apart(spark):
    e = [(s, 1, k, t, "u1", x) for s in ("a", "b") for k, (t, x) in enumerate([("transcript_chunk", "the 1999 storage limits" if s == "a" else "the 2001 travel rules"), ("utterance_end", None)])]
    rows = engine.replay(spark.createDataFrame(e, "session_id string, timestamp_ms long, seq int, event_type string, utterance_id string, text string")).filter("row = 'query'").collect()
    assert {(r.session_id, r.text) for r in rows} >= {("a", "1999 storage limits"), ("b", "2001 travel rules")}


def test_deferred_does_not_depend_on_chunks():
    text = "I need the refund policy, the catering options for 40 people, and the parking fees"
    seen = []
    for words in (1, 3, 50):
        s = Session()
        seen.append([r["text"] for e in say(text, words) for r in step(s, e, mode="deferred") if r["row"] == "query"])
    assert seen[0] == seen[1] == seen[2] != []


def test_stream_equals_batch(spark, tmp_path):
    events = Q.events(spark, SMALL).withColumnRenamed("e", "e").select("session_id", "utterance_id", "seq", "timestamp_ms", "event_type", "text")
    batch = engine.replay(events)
    files = tmp_path / "in"
    events.repartition("session_id").write.parquet(str(files))
    live = engine.stream(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(files)))
    q = live.writeStream.format("memory").queryName("turns").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    pick = "session_id, utterance_id, row, query_id, text, parent"
    a = sorted(map(tuple, batch.selectExpr(*pick.split(", ")).collect()), key=repr)
    b = sorted(map(tuple, spark.sql(f"SELECT {pick} FROM turns").collect()), key=repr)
    assert a == b


def test_spoken_numbers():
    assert spoken_numbers("an eighteen thirty sonnet, twelve million viewers") == "an 1830 sonnet, 12 million viewers"
    assert spoken_numbers("nineteen oh five, or nineteen hundred") == "1905, or 1900"
    assert spoken_numbers("which one of them") == "which one of them"
    assert spoken_numbers("one hundred and five, or two of") == "105, or two of"


def test_unpunctuated_questions():
    assert split_unpunctuated("who wrote the famous old novel what year was it printed").count(",") == 1
    assert split_unpunctuated("the forest makes up what amount of land") == "the forest makes up what amount of land"


def test_word_errors():
    assert word_errors("a b c".split(), "a x c".split()) == (1, {1})
    assert word_errors([], ["a"]) == (1, set())
    assert word_errors("a b".split(), ["b"]) == (1, {0})


def test_agreement(spark):
    said = ["the cat", "the cat sat", "the dog sat down", "the cow sat"]
    rows = [("s", k, x.split()) for k, x in enumerate(said)] + [("t", 0, ["one", "word"]), ("u", 0, [])]
    heard = spark.createDataFrame(rows, "session_id string, seq long, words array<string>")
    assert [r.new for r in engine.agreed(heard).filter("session_id = 's'").orderBy("seq").collect()] == [[], ["the", "cat"], [], []]
    assert {r.session_id: (r.committed, r.tail) for r in engine.flushed(heard).collect()} == {"s": (["the", "cat"], ["cow", "sat"]), "t": ([], ["one", "word"]), "u": ([], [])}


def test_decode_clock(spark):
    rows = spark.createDataFrame([([0.0, 5.0, 6.0], [2.0, 4.0, 1.0]), ([], [])], "a array<double>, d array<double>")
    assert [r[0] for r in rows.select(engine.decode_clock(F.col("a"), F.col("d"))).collect()] == [[2.0, 9.0, 10.0], []]


def test_settings():
    assert Config().override("retrieval.k", "3").retrieval.k == 3
    assert Config().override("controller.strip_markers", "true").controller.strip_markers
    assert decide(Session(), "u", "the new museum opens in 2026", False, Vocabulary(), Controller(mode="model")).stability < 1


CUT = [("transcript_chunk", "What is the cancellation"), ("transcript_hypothesis", None), ("transcript_chunk", " policy for the city workshop?"), ("utterance_end", None)]


def rows_with(heard, own):
    s, rows = Session(), []
    for k, (kind, text) in enumerate(CUT):
        if kind == "transcript_hypothesis" and heard is None:
            continue
        rows += step(s, {"event_type": kind, "utterance_id": "u1", "timestamp_ms": k, "text": heard if kind == "transcript_hypothesis" else text}, own=own)
        s = Session.of_json(json.loads(json.dumps(s.to_json())))
    return rows


def test_searching_ahead_changes_no_answer():
    plain = [{k: v for k, v in r.items() if k != "adopted"} for r in rows_with(None, Controller())]
    whole = "What is the cancellation policy for the city workshop?"
    for heard, adopted in ((whole, True), ("What is the cancellation fee for catering?", None), ("What was the fee", None), (None, None)):
        rows = rows_with(heard, Controller(speculate=True))
        assert [{k: v for k, v in r.items() if k != "adopted"} for r in rows if not r["row"].startswith("prefetch")] == plain
        ahead = [r["text"] for r in rows if r["row"] == "prefetch"]
        assert len(ahead) == len(set(ahead))
        if adopted:
            asked = [r for r in rows if r["row"] == "query"]
            assert any(r["adopted"] for r in asked) and all(r["text"] in ahead for r in asked if r["adopted"])
    assert not [r for r in rows_with(whole, Controller()) if r["row"].startswith("prefetch")]
    wrong = rows_with("What is the cancellation fee for catering?", Controller(speculate=True))
    assert {r["text"] for r in wrong if r["row"] == "prefetch_cancelled"} <= {r["text"] for r in wrong if r["row"] == "prefetch"} != set()


class Kept:
    """A state as the streaming operator gives it."""

    def __init__(self, timed_out=False, value=None):
        self.hasTimedOut, self.value = timed_out, value
        self.exists, self.get = value is not None, value

    def remove(self):
        self.value = None

    def update(self, value):
        self.value = value

    def setTimeoutDuration(self, ms):
        self.ms = ms


def test_a_timeout_gives_degraded_turns():
    events = pd.DataFrame([("u1", 1, 0, "transcript_chunk", "the 2024 refund policy and the parking fees"), ("u2", 2, 1, "transcript_chunk", "the")], columns="utterance_id timestamp_ms seq event_type text".split())
    first = Kept()
    rows = engine.advance(("s",), iter([events]), first, 9, "streaming", Vocabulary(), Controller())
    assert first.ms == 9 and list(rows["seq"]) == list(range(len(rows)))
    late = Kept(True, first.value)
    ended = engine.advance(("s",), iter([]), late, 9, "streaming", Vocabulary(), Controller())
    assert late.value is None and list(ended["reason"]) == ["degraded"] * 2 and ended["seq"].min() == len(rows)
    asked = list(rows[rows["row"] == "query"]["query_id"])
    assert asked and set(ended["cancelled"].iloc[0]) >= set(asked) and list(ended["live"]) == [[], []]
    assert len(engine.advance(("s",), iter([]), Kept(True, ('{"open": {}, "answered": [], "topic": "", "requests": 0}', 3)), 9, "streaming", Vocabulary(), Controller())) == 0


def test_search_takes_back_what_was_superseded(spark, tmp_path):
    text = "string"
    rows = [("s", "query", "u1", "u1.q1", "refund", None, None, None), ("s", "query", "u1", "u1.q2", "refund policy", "u1.q1", None, None), ("s", "prefetch", "u1", None, "parking", None, None, None), ("s", "query", "u2", "u2.q1", "parking", "u1.q2", None, None), ("s", "decision", "u2", None, None, None, ["u9.q9"], None)]
    columns = f"session_id {text}, row {text}, utterance_id {text}, query_id {text}, text {text}, parent {text}, superseded array<string>, cancelled array<string>"
    spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / "in"))
    seen, searched = [], []

    def search(texts):
        searched.extend(r.query for r in texts.collect())
        return texts.withColumn("citation", F.concat(F.col("query"), F.lit(" §1")))

    def sink(found, gone, number):
        seen.append(({(r.row, r.asked_id, r.citation) for r in found.collect()}, {r.query_id for r in gone.collect()}))

    live = spark.readStream.schema(columns).parquet(str(tmp_path / "in"))
    q = engine.search_stream(live, search, sink).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    found, gone = seen[0]
    assert gone == {"u1.q1", "u9.q9"} and sorted(searched) == ["parking", "refund policy"]
    assert found == {("query", "u1.q2", "refund policy §1"), ("prefetch", None, "parking §1"), ("query", "u2.q1", "parking §1")}


def test_logs_and_records(spark, tmp_path):
    rows = spark.createDataFrame([(f"s{k}", k) for k in range(5)], "session_id string, n long")
    rows.write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run adds nothing
        sinks.json_log(live, str(tmp_path / "out"), str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert spark.read.json(str(tmp_path / "out")).count() == 5
    sinks.memory_log(live, "log_rows").option("checkpointLocation", str(tmp_path / "m")).trigger(availableNow=True).start().awaitTermination(120)
    assert spark.table("log_rows").count() == 5
    turns = spark.createDataFrame([("s", "u", "degraded", "half"), ("s", "v", "final", "whole")], "session_id string, utterance_id string, reason string, answer string")
    got = sinks.records(turns).collect()
    assert got[0].__fields__ == RECORD_FIELDS and [r.answer for r in got] == [DEGRADED_ANSWER, "whole"] and [r.uncertainty for r in got] == [DEGRADED_DOUBT, None]
    two = spark.createDataFrame([("s", 0, "query", "u", 1500, "u.q1", "a", "provisional", None, None, None), ("s", 1, "query", "u", 2500, "u.q2", "b", "final", None, None, None), ("s", 2, "turn", "u", 2500, None, None, None, ["u.q2"], "final", True), ("s", 3, "turn", "v", 1, None, None, None, [], "chit_chat", False)], "session_id string, seq long, row string, utterance_id string, ts_ms long, query_id string, text string, trigger string, live array<string>, reason string, retrieval_required boolean")
    made = {r.utterance_id: r for r in sinks.turn_results(two).collect()}
    assert [tuple(e) for e in made["u"].retrieval_events] == [(1.5, "a", "provisional"), (2.5, "b", "final")] and made["u"].sub_queries == ["b"] and made["v"].retrieval_events == []
