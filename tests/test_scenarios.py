"""Scenarios: each question once, own documents first, the same at any number of partitions, known to the engine's patterns."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from evidora.functions import text as T
from evidora.operators import scenarios as S


def questions(spark, hot=40, docs=60):
    """A hot document, documents of one to four questions, a null document, a repeated row, blank and null texts."""
    rows = [("hot", f"hot:{i}", f"What is item {i} of the long list here?") for i in range(hot)]
    rows += [(f"d{k}", f"d{k}:{i}", f"How does part {i} of {k} work?") for k in range(docs) for i in range(k % 4 + 1)]
    rows += [(None, f"n:{i}", f"Who wrote note {i}?") for i in range(5)]
    rows += [rows[0], ("d1", "d1:blank", "  "), ("d2", "d2:null", None)]
    return spark.createDataFrame(rows, "doc string, key string, text string")


@pytest.mark.parametrize("size", [1, 2, 3])
def test_matched_uses_each_question_once_and_own_documents_first(spark, size):
    clean = questions(spark).filter(F.trim("text") != "").distinct().withColumn("size", F.lit(size))
    got = S.matched(clean, "doc", "key", "size").collect()
    assert len(got) == len({r.key for r in got})
    held = Counter(r.doc for r in clean.collect())
    own = Counter(r.doc for r in got if r.group_doc is not None)
    for doc, n in held.items():
        if doc is not None:
            assert own[doc] == n - n % size
    assert sum(held.values()) - len(got) < size
    for (_, _), members in Counter((r.group_doc, r.group_no) for r in got if r.group_doc is not None).items():
        assert members == size


def test_scenarios_are_the_same_at_any_number_of_partitions(spark):
    rows = questions(spark)
    made = lambda df: sorted(map(str, S.turns(df, "doc", "key", "text", seed=3).collect()))
    assert made(rows) == made(rows.repartition(7)) == made(rows.orderBy(F.desc("key")).coalesce(1))
    assert made(rows) != sorted(map(str, S.turns(rows, "doc", "key", "text", seed=4).collect()))


def test_turns_are_what_they_say(spark):
    rows = S.turns(questions(spark, docs=200), "doc", "key", "text").withColumns(
        {"chat": T.is_chit_chat(F.col("text")), "look": T.is_presentation(F.col("text")), "refines": T.is_refinement_cue(F.col("text"))}
    ).collect()
    assert {r.template for r in rows} == set(S.TEMPLATES)
    assert {r.kind for r in rows} == {"new_request", "refinement", "presentation_only", "chit_chat"}
    for r in rows:
        assert r.chat == (r.kind == "chit_chat") and r.look == (r.kind == "presentation_only")
        assert r.refines or r.kind != "refinement"
        assert len(r.gold) == len(r.docs) and all(g in r.text for g in r.gold) and bool(r.gold) == r.retrieval_required
        assert not r.early or len(r.text.split()) > S.EARLY_WORDS
    asked = Counter(g for r in rows for g in r.gold)
    assert max(asked.values()) == 1
    assert S.turns(questions(spark).limit(0), "doc", "key", "text").collect() == []


def test_events_follow_each_other(spark):
    turns = spark.createDataFrame([("a", "u1", "one two three four five six seven"), ("a", "u2", "eight"), ("b", "u1", "  ")], "scenario_id string, utterance_id string, text string")
    got = [(r.session_id, r.timestamp_ms, r.event_type, r.text) for r in S.events(turns).collect()]
    assert len(got) == 10 and set(got) == {
        ("a", 0, "session_start", None), ("a", 0, "transcript_chunk", "one two three four five six"), ("a", 2400, "transcript_chunk", " seven"), ("a", 3100, "utterance_end", None),
        ("a", 4600, "transcript_chunk", "eight"), ("a", 5300, "utterance_end", None), ("a", 7300, "session_end", None),
        ("b", 0, "session_start", None), ("b", 0, "utterance_end", None), ("b", 2000, "session_end", None),
    }


def test_bottom_takes_the_least_hashes_of_each_stratum(spark):
    rows = spark.createDataFrame([(g, i) for g in ("x", "y", None) for i in range(50)] + [("z", 1)], "g string, id long")
    got = S.bottom(rows, ["g"], ["id"], 7).collect()
    assert Counter(r.g for r in got) == {"x": 7, "y": 7, None: 7, "z": 1}
    low = {r.g: r.ids for r in rows.withColumn("h", S.draw(0, "id")).groupBy("g").agg(F.slice(F.array_sort(F.collect_list(F.struct("h", "id"))), 1, 7)["id"].alias("ids")).collect()}
    assert all({r.id for r in got if r.g == g} == set(ids) for g, ids in low.items())
