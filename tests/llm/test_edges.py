"""Every operator and pipeline stage with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import gzip
import hashlib
import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evidora.llm import chat, classifier, decontaminate, line_dedup, packing, pii, quality_rules, shared, simhash, token_counts, warc
from evidora.llm.shared import scratch_path

LONG = ("word " * 9 + "end.\n") * 4000
WORDS = " ".join(f"w{i}x" for i in range(80))
ROWS = [
    (1, "", "en", "a", 0), (2, None, None, None, None), (None, WORDS, "en", "a", 5), (3, WORDS, "en", "a", 5), (3, WORDS, "en", "a", 5), (4, LONG, "de", "b", 9),
    (5, "a\n\n b \nA\r", "fr", "c", 3), (6, "ünï ça 日本語 🎉 <|endoftext|> x", "xx", "c", 1), (7, " \t\n ", "en", "c", 1), (8, "x" * 50_000, "en", "c", 2),
]
#: names that operators might use themselves
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = "id string, fp0 long, key string, row1 long, batch int, component_id string, _gone string, island int, label int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, "i", 1, "k", 2, 3, "c", "g", 4, 5) for r in ROWS]
    return spark.createDataFrame(rows, f"{SCHEMA}, {EXTRA}")


OPERATORS = {
    "pii": lambda d: pii.find(d),
    "simhash": lambda d: simhash.near_duplicates(d),
    "similar": lambda d: simhash.similar_groups(d),
    "tokenise": lambda d: packing.pack_documents(d).filter("piece = 0"),
    "quality": lambda d: quality_rules.measure(d),
    "lines": lambda d: line_dedup.drop_common_lines(d),
    "tokens": lambda d: token_counts.attribute(d, token_counts.vocabulary_path()),
    "hits": lambda d: decontaminate.find_hits(d, d.sparkSession.createDataFrame([(1, None), (None, "w1x w2x w3x"), (2, "")], "item_id long, text string")),
    "score": lambda d: classifier.score(d, classifier.train(d, d.sparkSession.createDataFrame([(3, 1), (None, 0), (4, None), (5, 0)], "doc_id long, quality int"))),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_for_each(docs, name):
    assert OPERATORS[name](docs).count() == len(ROWS)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(docs, name):
    assert OPERATORS[name](docs.limit(0)).count() == 0


def test_stages(spark, docs, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(1, "w1x w2x w3x w4x w5x w6x w7x w8x w9x w10x"), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    for source in (docs, docs.limit(0), spark.createDataFrame(ROWS, SCHEMA)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, source, d)
            assert out.columns == source.columns, name
            out.count()
        corpus_pipeline.STAGES[-1][1](spark, source, d).count()
    kept = corpus_pipeline.near_duplicates(spark, docs, d)
    assert sorted(r.doc_id for r in kept.filter("doc_id IS NOT NULL").collect()) == [1, 3, 4, 5, 6, 8]
    assert corpus_pipeline.decontamination(spark, docs, d).filter(f"text = '{WORDS}'").count() == 0


def test_pages(spark):
    pages = [(1, None, None), (None, "http://x/", "a" * 2000), (2, "http://www.x/b?q=1", "a" * 2000), (3, "http://x/b", "a" * 2000), (3, "bad\r\nurl [", "a" * 2000), (4, "u", "WARC/1.1\r\n\r\n"), (5, "u", "ü" * 999)]
    for rows, names in ((pages, "page_id long, url string, html string"), ([(*p, "z") for p in pages], "page_id long, url string, html string, digest string"), ([], "page_id long, url string, html string")):
        path = scratch_path(spark, "t-warc")
        warc.write_archives(spark.createDataFrame(rows, names), path)
        got = warc.read_index(spark, path).collect()
        assert len(got) == len(rows)
        if rows:
            by = {(r.page_id, r.record_type): r for r in got}
            assert by[2, "revisit"].refers_to == 3 and by[2, "revisit"].payload_bytes == 2000 and by[3, "response"].refers_to is None
            assert by[1, "response"].payload_digest == hashlib.sha1(b"").hexdigest() and by[5, "response"].payload_bytes == 1998
            keys = [warc.order((None, r.urlkey, r.captured, None)) for r in got]
            assert keys == sorted(keys)
            small = warc.read_index(spark, path, run_rows=2, range_rows=1, block=1).collect()  # many runs, ranges and blocks
            assert [warc.order((None, r.urlkey, r.captured, None)) for r in small] == keys and sorted(map(str, small)) == sorted(map(str, got))
            unpacked = {f.path.rpartition("/")[2]: gzip.decompress(f.content) for f in spark.read.format("binaryFile").load(path).collect()}
            for r in got:
                ((headers, *_),) = warc.parse(unpacked[r.run][r.record_offset : r.record_offset + r.record_length])
                assert warc.page_of(headers["WARC-Record-ID"]) == r.page_id and headers["WARC-Payload-Digest"] == f"sha1:{r.payload_digest}"


def test_merge_holds_one_block_a_run():
    """Blocks in the order of their first keys, ties included, give all rows in order; a run has one open block at most."""
    draw = random.Random(7)
    for runs in (1, 3, 8):
        made = [sorted(((draw.randrange(40),) for _ in range(200))) for _ in range(runs)]
        opened, most = set(), 0

        def rows(name, block, opened=opened):
            opened.add(name)
            yield from block
            opened.discard(name)

        blocks = sorted(((run[lo], k, run[lo : lo + 7]) for k, run in enumerate(made) for lo in range(0, 200, 7)), key=lambda b: b[0])
        tree, got = warc.LoserTree([], key=lambda r: r), []
        for n, (first, k, block) in enumerate(blocks):
            got += tree.upto(first)
            tree.add(rows((k, n), block))
            most = max(most, len(opened))
        got += tree
        assert got == sorted(itertools.chain(*made)) and most <= runs


def test_conversations(spark):
    rows = [(1, 1, None, None), (1, 1, None, None), (1, None, "user", "x"), (None, 1, "assistant", "y"), (2, 5, "system", ""), (2, 6, "robot", "z")]
    got = chat.repair(spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, part int")).collect()
    assert sum(r.action != "insert" for r in got) == len(rows)
    assert chat.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_similar_sets_of_shingles(spark):
    """Repeats inside a text and a shared phrase do not count; every link at 0.8 does, none below."""
    import random

    draw = random.Random(3)
    words = [f"q{k}" for k in range(604)]
    phrase = [f"p{k}" for k in range(24)]
    repeated = words + [w for _ in range(20) for w in words[:9]]
    texts = [words, repeated, phrase * 10 + [f"l{k}" for k in range(254)], phrase * 10 + [f"r{k}" for k in range(254)]]
    for n in (40, 300):
        for g in range(12):
            base = [f"g{n}_{g}_{k}" for k in range(n)]
            for _ in range(6):
                at = draw.sample(range(n), draw.randrange(1 + n // 40))
                texts.append([f"x{draw.random()}" if k in at else w for k, w in enumerate(base)])
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    least = list(range(len(texts)))
    links = [(a, b) for a in least for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for _ in least:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    assert got == dict(enumerate(least))
    assert got[0] == got[1] and got[2] != got[3]


def test_mixed_texts_fail_in_any_order(spark):
    """Encoded data is found wherever it stands: after prose, in a tail, in a third of a long text or in a short one."""
    import base64
    import random

    draw = random.Random(7)
    syllables = "ta ren lo mi sor an ke du pel in ga tor es vi".split()

    def prose(n):
        made = ""
        while len(made) < n:
            made += "".join(draw.choices(syllables, k=draw.randrange(1, 4))) + " "
        return made[:n]

    def junk(n):
        return base64.b64encode(draw.randbytes(n)).decode()[:n] + " "

    clean = [prose(n) for n in (600, 1500, 3000, 7000, 24000)]
    mixed = [prose(4096) + junk(3500), junk(3500) + prose(4096), prose(1600) + junk(1400), "".join(x for _ in range(2) for x in (prose(8192), junk(4096)))]
    rows = [(k, x) for k, x in enumerate(clean + mixed)]
    got = {r.id: (r.base_failed, r.kept) for r in quality_rules.measure(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k] for k, _ in rows] == [(False, True)] * len(clean) + [(False, False)] * len(mixed)


def test_islands_of_one_id(spark, monkeypatch):
    """Pieces of one id or none are dealt over islands of the stated size, and each is packed once."""
    rows = spark.range(9000).select(F.when(F.col("id") < 6000, F.lit(7)).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), (F.col("id") % 90 + 5).alias("length"), F.col("id").alias("ids_crc32"))
    folder = scratch_path(spark, "islands")
    packer = packing.island_packer

    def noting(*args):
        run = packer(*args)

        def noted(key, pdf):
            import os
            import uuid

            os.makedirs(folder, exist_ok=True)
            open(f"{folder}/{len(pdf)}-{uuid.uuid4().hex}", "w").close()
            return run(key, pdf)

        return noted

    monkeypatch.setattr(packing, "island_packer", noting)
    out = packing.pack(rows, capacity=100, island=1000).toPandas()
    assert sorted(out.ids_crc32) == list(range(9000)) and out.groupby("sequence_id").length.sum().max() <= 100
    assert max(int(x.split("-")[0]) for x in os.listdir(folder)) < 1500


def test_pii_grouped_and_short_identifiers(spark):
    """An accepted slot marks digit groups and short tokens whole."""
    rows = [(i, f"please call me: +49 30 5550{i:03d} today") for i in range(12)]
    more = {50: "017 555 7713", 51: "(017) 555-7713", 52: "x7", 53: "4111 1111 1111 1112", 54: "112"}
    rows += [(k, f"please call me: {v} today") for k, v in more.items()]
    got = {r.id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    assert {k: [texts[k][s.start : s.end] for s in got[k]] for k in more} == {k: [v] for k, v in more.items()}


def test_pii_copies_are_one_seed(spark):
    """Copies of one text do not make its context a pattern; different seeds do."""
    for seeds, found in ((1, 0), (12, 1)):
        rows = [(i, f"please call me: +49 30 5550{i % seeds:03d} today") for i in range(12)] + [(50, "please call me: x7 today")]
        got = {r.id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert len(got[50]) == found


def test_one_of_each_group_with_repeated_ids(spark):
    """Rows of one id with texts of two groups stay both; repeated rows, copies and near copies give one row;
    rows without an id stay, and all columns do, whatever their names."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (1, b), (2, a), (3, a + " more"), (4, c), (4, c), (None, c), (None, c), (5, None), (6, "")]
    docs = spark.createDataFrame([(*r, 1, True) for r in rows], "doc_id long, text string, bucket int, perhaps boolean")
    got = simhash.one_of_each_group(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in got.collect() if r.text) == sorted([(1, a), (1, b), (4, c), (0, c), (0, c)])
    assert [r.doc_id for r in got.collect() if not r.text] == [5]


def test_line_store(spark):
    """Runs are joined and merged without a shuffle, a later session's batch builds on them, and counts add up over batches."""
    import random
    from collections import Counter

    draw = random.Random(8)
    folder = scratch_path(spark, "t-lines")
    store = line_dedup.LineStore(spark, folder, min_docs=6, buckets=3)
    total, settled = Counter(), set()
    for turn in range(7):
        counts = Counter(draw.randrange(60) for _ in range(40))
        batch = spark.createDataFrame([(k, -k, n) for k, n in counts.items()], "h1 long, h2 long, n long")
        table = line_dedup.bucketed(batch.repartition(3, "h1", "h2"), scratch_path(spark, "t-batch"), 3, ["h1", "h2"])
        if store.runs:
            plan = store.joined(table)._jdf.queryExecution().executedPlan().toString()
            assert "Join" in plan and "Exchange hashpartitioning" not in plan
        store.add(table)
        if turn == 3:
            store = line_dedup.LineStore.open(spark, folder)
        total += counts
        settled = {k for k, n in total.items() if n >= 6}
        found = [r.h1 for r in store.settled().collect()]
        assert len(found) == len(set(found)) and set(found) == settled
        assert Counter({level for level, _, _ in store.runs}) == Counter(level for level, _, _ in store.runs)  # one run a level
    assert {level for level, _, _ in store.runs} == {0, 1, 2}


def test_lines_in_batches(spark, docs):
    """The number of batches does not change the result."""
    rows = [(i, "\n".join([f"own {i}", "shared line", f"third {i % 3}", " SHARED line"])) for i in range(24)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    one, many = ({r.doc_id: r.text for r in line_dedup.drop_common_lines(table, min_docs=9, batch_rows=n).collect()} for n in (1000, 3))
    assert one == many == {i: f"own {i}\nthird {i % 3}" for i in range(24)}


def test_bitmap_misses_no_key(spark):
    """A place that is not set belongs to no marked key; an empty bitmap lets nothing through."""
    keys = spark.range(0, 3000, 3).select(F.xxhash64("id").alias("k"))
    rows = spark.range(3000).select("id", F.xxhash64("id").alias("k"))
    for bits in (6, 12, 26):
        found = {r.id for r in shared.perhaps(rows, shared.bitmap(keys, "k", bits), "k", bits).filter("perhaps").collect()}
        assert set(range(0, 3000, 3)) <= found and (bits < 26 or len(found) < 1100)
    assert shared.perhaps(rows, shared.bitmap(keys.limit(0), "k"), "k").filter("perhaps").count() == 0


def test_spans_and_blocks_of_windows(spark, docs):
    """Spans lie on the words of their item in the original text; blocks of windows change nothing."""
    small = "/root/testdata/sf0.001"
    texts, items = (spark.read.parquet(f"{small}/{x}.parquet") for x in ("documents", "benchmark"))
    texts = texts.select("doc_id", "text").union(spark.createDataFrame([(-1, "Ünï--W1X, w2x\nW3X."), (-1, "Ünï--W1X, w2x\nW3X."), (None, "w1x w2x w3x w2x w3x w4x")], "doc_id long, text string"))
    items = items.union(spark.createDataFrame([(-5, "w1x w2x w3x"), (None, "w2x w3x"), (-6, None), (-7, " ?! ")], items.schema))
    one = decontaminate.find_hits(texts, items).collect()
    many = decontaminate.find_hits(texts, items, block_windows=300).collect()
    plain = sorted(((r.id, r.n_words, r.n_hit, r.items, sorted(map(tuple, r.spans), key=repr)) for r in one), key=repr)
    assert plain == sorted(((r.id, r.n_words, r.n_hit, r.items, sorted(map(tuple, r.spans), key=repr)) for r in many), key=repr)
    words = {r.item_id: decontaminate.normalise(r.text) for r in items.collect()}
    whole = {r.doc_id: r.text for r in texts.collect()}
    assert sum(bool(r.spans) for r in one) > 4
    for r in one:
        for s in r.spans:
            own, said = words[s.item_id], decontaminate.normalise(whole[r.id][s.start : s.end])
            assert any(said[:k] == own[i : i + k] for k in [min(10, len(own))] for i in range(len(own) - k + 1))
    found = {r.id: r for r in one}
    assert [tuple(s) for s in found[-1].spans if s.item_id == -5] == [(-5, 5, 17)] and found[-1].n_hit == 3 and found[-1].n_words == 4
    assert found[None].n_hit == 5 and found[None].items == [-5]
    kept = decontaminate.remove_contaminated(texts, items).collect()
    assert sorted(map(repr, kept)) == sorted(map(repr, decontaminate.remove_contaminated(texts, items, block_windows=300).collect()))
    assert len(kept) == sum(not r.n_hit for r in one)


def test_common_lines_of_long_texts_take_linear_time(spark):
    """Texts of many lines that occur often: twice the lines take about twice the time, not four times."""
    import time

    took = {}
    for n in (500, 8000, 16000):
        text = "\n".join(f"shared line {i}" if i % 2 else f"own %d {i}" for i in range(n))
        table = spark.createDataFrame([(k, text.replace("%d", str(k))) for k in range(12)], "doc_id long, text string")
        began = time.perf_counter()
        rows = line_dedup.deduplicated(table).collect()
        took[n] = time.perf_counter() - began
        assert all((r.n_lines, r.n_dropped) == (n, n // 2) and r.kept == "\n".join(f"own {r.row.doc_id} {i}" for i in range(0, n, 2)) for r in rows)
    assert took[16000] < 3 * took[8000] + 5


def test_archives_of_any_long_id(spark):
    rows = [(i, "http://h/a", "x" * 1200) for i in (2**62, -(2**62), 2**63 - 1, -(2**63), 10**13 + 5)]
    path = scratch_path(spark, "t-ids")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = warc.read_index(spark, path).collect()
    assert {r.page_id for r in got} == {r[0] for r in rows} and all(len(r.captured) == 20 for r in got)
    assert [r.page_id for r in got if r.record_type == "response"] == [2**63 - 1] and [r.captured for r in got] == sorted(r.captured for r in got)


@pytest.mark.parametrize("kind", ["chain", "hub", "random", "empty"])
def test_components_deal_out_few_tasks(spark, kind):
    """The driver keeps something of each task and exchange, so a round has two exchanges, and stars need one round alone."""
    rng = random.Random(5)
    links = {
        "chain": [(i, i + 1) for i in range(-200, 200)],
        "hub": [(i, -7) for i in range(5000)] * 2 + [(9, 9)],
        "random": [(rng.randrange(-900, 900), rng.randrange(-900, 900)) for _ in range(900)],
        "empty": [],
    }[kind]
    least = {x: x for e in links for x in e}
    while any(least[a] != least[b] for a, b in links):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    table = spark.createDataFrame(links, "a long, b long").repartition(3)
    table = shared.written(table, "links")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)  # nodes go on from one batch to the next
    try:
        spark.sparkContext.setJobGroup(f"components {kind}", "")
        got = simhash.components(table)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(f"components {kind}")
        rows = [tuple(r) for r in got.collect()]
    finally:
        spark.sparkContext._jsc.clearJobGroup()
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(rows) == sorted((x, m) for x, m in least.items() if x != m)
    if kind == "hub":
        assert len(jobs) <= 5  # two exchanges, the write, and a look at what is open
