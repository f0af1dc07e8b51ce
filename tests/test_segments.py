"""The stored index: updates, tombstones, merges, what is read and written, and equality with the index over all texts."""

import random

import pytest
from pyspark.sql import functions as F

from evidora.operators import index, retrieve, segments
from evidora.session import scratch

WORDS = [f"word{k}" for k in range(300)] + ["common"] * 40


def texts(draw, ords):
    return [(i, " ".join(draw.choice(WORDS) for _ in range(draw.randrange(30)))) for i in ords]


def best(found):
    return sorted(map(tuple, found.select("query_id", "ord", "score", "rank").collect()))


@pytest.fixture(scope="module")
def queries(spark):
    draw = random.Random(3)
    return spark.createDataFrame([(k, " ".join(draw.choice(WORDS) for _ in range(4))) for k in range(12)] + [(90, "nowhere"), (91, None)], "query_id long, query string")


def frame(spark, rows):
    return spark.createDataFrame(list(rows.items()) if isinstance(rows, dict) else rows, "ord long, text string")


def test_updates_equal_an_index_over_all_texts(spark, queries):
    """Added, changed, deleted and brought-back documents, nulls, negative ords, a reopened index and merges of tiers."""
    draw = random.Random(4)
    folder = scratch(spark, "t-segments")
    now = dict(texts(draw, range(-5, 400))) | {1000: None, 1001: "", 2**40: "common word1"}
    for turn in range(4):
        stored = segments.SegmentedIndex(spark, folder, fanout=3)
        added, gone = stored.update(frame(spark, now))
        assert (added, gone) == ((len(now), 0) if turn == 0 else (added, gone))
        assert stored.update(frame(spark, now)) == (0, 0)
        assert best(stored.search(queries, 10)) == best(retrieve.sparse(frame(spark, now), queries, 10))
        for i in draw.sample(sorted(now), 20):
            del now[i]
        now |= dict(texts(draw, draw.sample(range(500), 25)))
    assert stored.add(frame(spark, [(3, "common common word7"), (777, "word7")]))[0] == 2
    assert stored.delete(spark.createDataFrame([(777,), (778,)], "ord long")) == 1
    live = {r.ord for r in stored.documents().collect()}
    assert 3 in live and 777 not in live


def test_tiers_are_merged_and_the_dead_left_out(spark, queries):
    draw = random.Random(5)
    stored = segments.SegmentedIndex(spark, scratch(spark, "t-tiers"), fanout=3)
    now = {}
    for turn in range(7):
        more = dict(texts(draw, range(4 * turn, 4 * turn + 5)))  # the first replaces the last of before
        now |= more
        stored.add(frame(spark, more))
    assert len(stored.segments) <= 5 and sum(s.docs for s in stored.segments) < 35
    stored.vacuum()
    again = segments.SegmentedIndex(spark, stored.folder, fanout=3)
    assert best(again.search(queries, 5)) == best(retrieve.sparse(frame(spark, now), queries, 5))


def test_blocks_hold_the_postings_in_order(spark):
    draw = random.Random(6)
    rows = frame(spark, texts(draw, draw.sample(range(10**6), 1500)))
    stored = segments.SegmentedIndex(spark, scratch(spark, "t-blocks"))
    stored.update(rows)
    expect = sorted(map(tuple, index.postings(index.doc_tokens(rows)).select("term", "ord", "tf", "doc_len").collect()))
    assert sorted(map(tuple, stored.postings().select("term", "ord", "tf", "doc_len").collect())) == expect
    blocks = stored.blocks().collect()
    assert all(b.n == len(b.gaps) == len(b.tfs) <= segments.BLOCK and b.first + sum(b.gaps) == b.last for b in blocks)
    common = sorted((b.first, b.last) for b in blocks if b.term == "common")
    assert len(common) > 5 and all(a[1] < b[0] for a, b in zip(common, common[1:], strict=False))


def test_one_in_a_hundred_rewrites_one_in_a_hundred(spark):
    """A small update leaves the large segment's files as they are and writes the new postings alone."""
    draw = random.Random(7)
    rows = texts(draw, range(2000))
    stored = segments.SegmentedIndex(spark, scratch(spark, "t-small"))
    stored.update(frame(spark, rows))
    large = stored.segments[0]
    changed = rows[20:] + texts(draw, range(20))
    assert stored.update(frame(spark, changed)) == (20, 20)
    assert stored.segments[0] == large and stored.segments[1].postings < 0.02 * large.postings


def test_a_query_reads_its_terms_row_groups_alone(spark, monkeypatch):
    monkeypatch.setattr(segments, "FILE_POSTINGS", 2000)
    rows = [(i, " ".join(f"t{(i * 7 + k) % 997:03d}" for k in range(20))) for i in range(3000)]
    stored = segments.SegmentedIndex(spark, scratch(spark, "t-reads"))
    stored.update(frame(spark, rows))
    assert stored.blocks().select(F.input_file_name()).distinct().count() > 10
    found = stored.blocks().filter(F.col("term").isin(["t500"]))
    total = stored.blocks().count()
    rows = found.collect()
    read = 0
    plans = [found._jdf.queryExecution().executedPlan()]
    while plans:
        plan = plans.pop()
        if "Scan" in plan.nodeName():
            read += plan.metrics().apply("numOutputRows").value()
        plans += [plan.children().apply(k) for k in range(plan.children().size())]
    assert rows and 0 < read <= 0.3 * total


def test_an_update_that_fails_leaves_the_state_before(spark, queries, monkeypatch):
    draw = random.Random(8)
    rows = texts(draw, range(50))
    stored = segments.SegmentedIndex(spark, scratch(spark, "t-fail"))
    stored.update(frame(spark, rows))
    before = best(stored.search(queries, 5))
    broken = segments.SegmentedIndex(spark, stored.folder)
    monkeypatch.setattr(broken, "_commit", lambda: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        broken.update(frame(spark, texts(draw, range(30))))
    again = segments.SegmentedIndex(spark, stored.folder)
    assert best(again.search(queries, 5)) == before
    again.vacuum()
    assert best(segments.SegmentedIndex(spark, stored.folder).search(queries, 5)) == before


def test_empty_index(spark, queries):
    stored = segments.SegmentedIndex(spark, scratch(spark, "t-none"))
    assert stored.update(frame(spark, {})) == (0, 0) and best(stored.search(queries, 5)) == []


def shuffled(spark):
    """Rows that all stages up to now have written for a shuffle."""
    sc, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_building_shuffles_no_single_postings(spark):
    """2,000 postings a document were shuffled twice."""
    rows = [(i, " ".join(f"t{(i + k) % 3000}" for k in range(2000))) for i in range(60)]
    stored = segments.SegmentedIndex(spark, scratch(spark, "t-shuffle"))
    before = shuffled(spark)
    assert stored.update(frame(spark, rows)) == (60, 0)
    assert stored.segments[0].postings == 120_000 and shuffled(spark) - before < 3000


def test_searching_shuffles_postings_and_the_best_alone(spark):
    """A row for each query and document that share a term was shuffled."""
    stored = segments.SegmentedIndex(spark, scratch(spark, "t-pairs"))
    stored.update(frame(spark, [(i, f"common word{i % 7}") for i in range(1000)]))
    asked = spark.createDataFrame([(f"q{k}", f"common word{k % 9}") for k in range(80)], "query_id string, query string")
    expect = best(retrieve.sparse(stored.documents().select("ord", F.concat(F.lit("common word"), F.col("ord") % 7).alias("text")), asked, 3))
    before = shuffled(spark)
    assert best(stored.search(asked, 3)) == expect and len(expect) == 240
    assert shuffled(spark) - before < 10_000


def test_ranges_portions_and_blocks_of_queries(spark, queries, monkeypatch):
    """A common term over several files, documents in small portions and batches, in any order of ords; queries in small blocks."""
    monkeypatch.setattr(segments, "FILE_POSTINGS", 1500)
    monkeypatch.setattr(segments, "PORTION", 100)
    draw = random.Random(9)
    rows = frame(spark, texts(draw, draw.sample(range(-(10**6), 10**6), 1500)) + [(10**7, None), (10**8, ""), (10**9, "lonely " * 5000)]).repartition(5)
    stored = segments.SegmentedIndex(spark, scratch(spark, "t-ranges"))
    stored.update(rows)
    expect = sorted(map(tuple, index.postings(index.doc_tokens(rows)).select("term", "ord", "tf", "doc_len").collect()))
    assert sorted(map(tuple, stored.postings().select("term", "ord", "tf", "doc_len").collect())) == expect
    files = {}
    for r in stored.blocks().select("term", "first", "last", F.input_file_name().alias("file")).collect():
        files.setdefault(r.file, []).append(((r.term, r.first), (r.term, r.last)))
    assert all(own == sorted(own) for own in files.values())
    ends = sorted((min(own)[0], max(own)[1]) for own in files.values())
    assert len(ends) > 10 and all(a[1] < b[0] for a, b in zip(ends, ends[1:], strict=False))
    assert sum(a[0] <= "common" <= b[0] for a, b in ends) > 1
    whole = retrieve.best
    monkeypatch.setattr(retrieve, "best", lambda *own: whole(*own, block=5))
    assert best(stored.search(queries, 10)) == best(retrieve.sparse(rows, queries, 10))
