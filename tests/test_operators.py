"""Operators that SQL can't check: sources, claims, statistics, model answers."""

from pyspark.sql import functions as F

from evidora.config import Retrieval
from evidora.functions import text as T
from evidora.operators import claims, evaluate, generative, retrieve
from evidora.sources import corpus


def test_corpus_folder(spark, tmp_path):
    (tmp_path / "b.md").write_text("---\ndoc_id: Doc_2\ntitle: Two: parts\n---\nlost\n## §1 First\nOne. Two.\n## Second\nThree.\n")
    (tmp_path / "a.txt").write_text("Plain text. No heading.")
    (tmp_path / "README.md").write_text("skipped")
    (tmp_path / "Doc_9_more.md").write_text("## Only\n" + " ".join(f"Sentence {i} is here." for i in range(60)))
    got = corpus.load_corpus(spark, str(tmp_path)).orderBy("chunk_ord").collect()
    assert [c.doc_id for c in got if c.n == 1] == ["Doc_9", "Doc_2", "Doc_2", "a"]
    assert [c.citation for c in got if c.doc_id == "Doc_2"] == ["Doc_2 §1", "Doc_2 §2"]
    long = [c.text for c in got if c.doc_id == "Doc_9"]
    assert len(long) > 1 and long[1].startswith(T_last(long[0]))


def T_last(text):
    return text.rsplit(". ", 1)[-1]


def test_gold_is_never_read(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"scenario_id": "x", "events": [{"timestamp_ms": 1, "event_type": "transcript_chunk", "payload": {"text": "hi", "_gold": 1}}], "ground_truth": {"turns": {"u1": {"kind": "chit_chat"}}}}')
    rows = corpus.read_events(spark, str(tmp_path / "s.json"))
    assert "ground_truth" not in str(rows.schema) and rows.count() == 1
    assert corpus.read_gold(spark, str(tmp_path / "s.json")).first().kind == "chit_chat"


def test_merge_is_greedy(spark):
    c = "array<struct<text:string,citations:array<string>>>"
    prior = [("the red house stands", ["a"]), ("the red house stands tall", ["b"]), ("blue sky", ["c"])]
    delta = [("red house stands", ["d"]), ("red house stands again", ["e"])]
    row = spark.createDataFrame([(prior, delta)], f"p {c}, d {c}").select(claims.merged(F.col("p"), F.col("d")).alias("m")).first().m
    assert [x.text for x in row] == ["blue sky", "red house stands", "red house stands again"]


def test_dedup_of_ties(spark):
    rows = [(1, "b", 1.0, "same words here"), (1, "a", 1.0, "same words here"), (1, "c", 0.5, "other things there")]
    got = retrieve.drop_near(spark.createDataFrame(rows, "query_id long, chunk_id string, score double, text string"), 5).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["a", "c"]


def test_search_with_a_scorer_and_nothing(spark):
    d = spark.createDataFrame([(1, "1", "refund policy for groups"), (2, "2", "parking fees"), (3, "3", "")], "ord long, chunk_id string, text string")
    q = spark.createDataFrame([(1, "refund policy"), (2, "the of")], "query_id long, query string")
    got = retrieve.search(d, q, Retrieval(reranker="scorer", mode="sparse"), scorer=lambda a, b: F.length(b).cast("double")).collect()
    assert {(r.query_id, r.chunk_id) for r in got} == {(1, "1")}
    assert retrieve.search(d, q.limit(0), Retrieval(mode="sparse")).count() == 0


def test_sentences_keep_digits_and_ascii_bounds(spark):
    rows = [(1, "Zero. 1 one 1. Two 22 is 2. 33 three 3"), (2, "\u00a0 A. \u3000B!\u2003 "), (3, " "), (4, None), (5, "Vertical.\x0btab")]
    got = {r.id: r.s for r in spark.createDataFrame(rows, "id long, text string").select("id", T.sentences(F.col("text")).alias("s")).collect()}
    assert got == {1: ["Zero.", "1 one 1.", "Two 22 is 2.", "33 three 3"], 2: ["A.", "B!"], 3: [], 4: None, 5: ["Vertical.\x0btab"]}
    text = F.col("text")
    told = spark.createDataFrame([("Do\u00f1ez goes",), ("Dozens go",), ("It\u00e9 alone is 5\u00f1",)], "text string")
    got = [tuple(r) for r in told.select(T.opens_question(text), T.needs_context(text), T.continues(text), T.strong_anchor(text)).collect()]
    assert got == [(True, False, False, False), (False, False, False, False), (False, True, True, True)]


def test_bootstrap(spark):
    same = spark.createDataFrame([(k % 5, 1.0, 1.0) for k in range(50)], "cluster long, a double, b double")
    r = evaluate.bootstrap(same, 200).first()
    assert (r.observed, r.low, r.high) == (0.0, 0.0, 0.0)
    some = spark.createDataFrame([(k % 10, float(k % 2), 0.0) for k in range(100)], "cluster long, a double, b double")
    r = evaluate.bootstrap(some, 400).first()
    assert r.low <= r.observed <= r.high and r.low < r.high
    assert evaluate.bootstrap(same.limit(0)).first().observed == 0.0


def test_model_answers(spark):
    rows = spark.createDataFrame([("ok",), ("bad",)], "prompt string")

    def model(p):
        if p == "bad":
            raise ValueError
        return '{"claims": [{"text": "x", "citations": ["c"]}, {"text": " "}]}'

    got = {r.prompt: r.c for r in generative.complete(rows, model).select("prompt", generative.parsed_claims(F.coalesce("reply", F.lit("?"))).alias("c")).collect()}
    assert [c.text for c in got["ok"]] == ["x"] and got["bad"] == []
    prior = spark.createDataFrame([("1", "limit is 40 people"), ("2", "doors open early")], "claim_id string, text string")
    new = spark.createDataFrame([("limit is 60 people",)], "text string")
    made = {r.claim_id: r.text for r in generative.planned(prior, generative.fallback_plan(prior, new)).collect()}
    assert made == {"1": "limit is 60 people", "2": "doors open early"}
    chain = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", None)], "query_id string, parent string")
    got = {r.query_id: r.covered for r in generative.covered_by_chain(chain, spark.createDataFrame([("a",)], "query_id string")).collect()}
    assert got == {"a": True, "b": True, "c": True, "d": False}


def test_text_edges(spark):
    r = spark.createDataFrame([("", "1,200.50 and 3.0")], "e string, n string").select(
        T.jaccard(T.content_set(F.col("e")), T.content_set(F.col("n"))).alias("j"), F.size(T.sentences(F.col("e"))).alias("s"), T.ends_mid_thought(F.col("e")).alias("m"), T.numbers_in(F.col("n")).alias("n")
    ).first()
    assert (r.j, r.s, r.m, r.n) == (0.0, 0, True, ["1200.5", "3"])


def test_plans_stay_in_the_jvm(spark):
    from evidora.plans import catalog
    from tests.conftest import SMALL

    plan = catalog.QUERIES["bm25_topk"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "WindowGroupLimit" in plan


def test_char_channel_equals_brute_force(spark):
    """Nulls, blanks, repeated and short texts; a document that spans batches; blocks of one query."""
    import math

    from evidora.operators import index, retrieve

    texts = {1: "the cat sat", 2: None, 3: "  ", 4: "the cat sat", 5: "a", 6: "İx ß the " * 40, 7: " ".join(f"w{i}q" for i in range(3000))}
    asked = {1: "cat", 2: "", 3: "a w12q", 4: None}

    def weights(text):
        counts = {}
        for word in (text or "").lower().split():
            padded = f" {word} "
            found = [padded] if len(padded) <= 3 else [padded[i : i + n] for n in (3, 4, 5) for i in range(len(padded) - n + 1)]
            for g in found:
                counts[g] = counts.get(g, 0) + 1
        return {g: 1 + math.log(n) for g, n in counts.items()}

    own = {k: weights(t) for k, t in texts.items()}
    df = {}
    for w in own.values():
        for g in w:
            df[g] = df.get(g, 0) + 1
    idf = {g: math.log((1 + len(texts)) / (1 + n)) + 1 for g, n in df.items()}
    norm = lambda w: math.sqrt(sum((x * idf[g]) ** 2 for g, x in w.items() if g in idf))
    expected = set()
    for q, text in asked.items():
        wq = weights(text)
        scores = [(round(sum(x * idf[g] * w[g] * idf[g] for g, x in wq.items() if g in w) / (norm(w) * norm(wq)), 6), o) for o, w in own.items() if w and norm(wq)]
        best = sorted(((s, o) for s, o in scores if s > 0), key=lambda x: (-x[0], x[1]))[:2]
        expected |= {(q, o, s, r) for r, (s, o) in enumerate(best, 1)}
    docs = spark.createDataFrame(list(texts.items()), "ord long, text string")
    queries = spark.createDataFrame(list(asked.items()), "query_id long, query string")
    for block in (1, 1024):
        got = {(r.query_id, r.ord, r.score, r["rank"]) for r in retrieve.char_channel(docs, queries, 2, block).collect()}
        assert got == expected
    assert retrieve.char_channel(docs.limit(0), queries, 2).count() == 0
    assert retrieve.char_channel(docs, queries.limit(0), 2).count() == 0
    assert index.char_grams("a") == [" a "]


def test_quality_edges(spark):
    """Empty tables, one class only, ties, nulls and repeated rows."""
    import pytest

    from evidora.operators import quality as Q

    scored = spark.createDataFrame([(0.5, True), (0.5, False), (0.9, True), (0.1, False), (0.1, False)], "score double, label boolean")
    assert Q.auc(scored).first() == (2, 3, round((3 + 2.5) / 6, 6))
    assert Q.auc(scored.filter("label")).first() == (2, 0, None)
    assert Q.auc(scored.limit(0)).first() == (0, 0, None)
    grid = {r.threshold: r for r in Q.f1_grid(scored, [0.0, 0.5, 1.0]).collect()}
    assert (grid[1.0].precision, grid[1.0].recall, grid[1.0].f1, grid[1.0].missed) == (0.0, 0.0, 0.0, 2)
    assert grid[0.5].recall == 1.0 and grid[0.5].premature == 1
    chunks = spark.createDataFrame([(1, 1, "alpha"), (1, 2, None), (1, 3, "beta gamma"), (2, 1, "alpha"), (3, 1, "x")], "session_id long, seq int, text string")
    intents = spark.createDataFrame([(1, "alpha beta gamma"), (1, "alpha beta gamma"), (2, "delta"), (3, "the"), (3, None)], "session_id long, intent string")
    assert {(r.session_id, r.seq, r.ready) for r in Q.ready_rows(chunks, intents).collect()} == {(1, 1, False), (1, 2, False), (1, 3, True), (2, 1, False)}
    assert Q.ready_rows(chunks, intents.limit(0)).count() == 0
    trace = spark.createDataFrame([(None, None, None, None), ("a", 1.0, "s", None), ("z", 1.0, "s", "u")], "event string, ts_ms double, session_id string, utterance_id string")
    assert {(r.event, r.problem, r.n) for r in Q.log_problems(trace, ("a",), ("a",)).collect()} == {(None, "no event", 1), (None, "no time", 1), (None, "no session", 1), ("a", "no utterance", 1), ("z", "unknown event", 1)}
    rows = spark.createDataFrame([(float(i), i % 2, i > 10 or i == 3) for i in range(20)], "x double, y int, label boolean")
    bias, weights, probability = Q.fit_gate(rows, ["x", "y"], "label")
    assert weights[0] > 0 and Q.auc(rows.select(probability().alias("score"), "label")).first().auc > 0.85
    with pytest.raises(ValueError):
        Q.fit_gate(rows.filter("label"), ["x", "y"], "label")


def test_bootstrap_of_known_difference(spark):
    rows = spark.createDataFrame([(f"c{i}", 1, 0) for i in range(50)], "cluster string, a int, b int")
    assert evaluate.bootstrap(rows, 200).first() == (1.0, 1.0, 1.0)
    assert evaluate.bootstrap(rows.limit(0)).first() == (0.0, 0.0, 0.0)


def test_lsa_has_every_term_and_equals_a_full_svd(spark):
    import random

    import numpy as np

    from evidora.operators import index

    draw = random.Random(2)
    names = ["".join(draw.choices("bdfgklmnprstvz", k=7)) for _ in range(2600)]
    texts = [" ".join([*draw.choices(names[40 * (k % 5) : 40 * (k % 5) + 40], k=30), *names[200 + 30 * k : 230 + 30 * k]]) for k in range(80)]
    docs = spark.createDataFrame([(k, str(k), t) for k, t in enumerate(texts)], "ord long, chunk_id string, text string")
    lsa = index.Lsa(rank=12).fit(docs)
    rare = spark.createDataFrame([(k, names[200 + 30 * k + 7]) for k in range(80)], "ord long, text string")
    assert lsa.terms.count() > 2048 and lsa.transform(rare).count() == 80
    dense = np.zeros((80, lsa.terms.count()))
    for r in lsa._weights(docs).collect():
        dense[r.ord, list(r.m)] = list(r.m.values())
    best = (np.linalg.svd(dense, compute_uv=False)[:12] ** 2).sum()
    assert ((dense @ lsa.components) ** 2).sum() > 0.999 * best


def test_rare_grams_are_joined_exactly(spark):
    """Whatever share of the n-grams is sent to the workers, scores are the same."""
    from evidora.operators import retrieve

    texts = [(i, f"common words and copy{i % 5} x{i}y{i * 7 % 11}z" if i % 9 else "common words and a copy") for i in range(300)]
    docs = spark.createDataFrame(texts, "ord long, text string").repartition(4)
    queries = spark.createDataFrame([(1, "copy3 words"), (2, "x17y9z"), (3, "common")], "query_id long, query string")
    want, *others = [{tuple(r) for r in retrieve.char_channel(docs, queries, 4, common=n).collect()} for n in (1 << 17, 40, 1)]
    assert len(want) == 12 and others == [want, want]


def test_bm25_reads_texts_once(spark):
    from evidora.plans import catalog
    from tests.conftest import SMALL

    rows = catalog.QUERIES["bm25_topk"](spark, SMALL)
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan and plan.split("Initial Plan")[0].count("SortMergeJoin") == 0


def test_cosine_products_are_bounded(spark, monkeypatch):
    """As many queries as there are never make a product of over a million scores; the results are those of brute force."""
    import numpy as np

    from evidora.operators import retrieve

    v = np.round(np.random.default_rng(3).standard_normal((3000, 4)), 1)
    rows = spark.createDataFrame([(i, x.tolist(), int(i % 3)) for i, x in enumerate(v)], "ord long, vector array<double>, label int").repartition(2)
    asked = rows.filter("ord < 900").withColumnRenamed("ord", "query_id")
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    scores = np.round(unit[:900] @ unit.T, 6)
    for group in (None, "label"):
        got = {(r.query_id, r["rank"]): r.ord for r in retrieve.cosine(rows, asked, 3, group=group).collect()}
        held = scores if group is None else np.where(np.arange(900)[:, None] % 3 == np.arange(3000)[None] % 3, scores, -1)
        order = np.argsort(-held, axis=1, kind="stable")[:, :3]
        assert got == {(q, r + 1): order[q, r] for q in range(900) for r in range(3) if held[q, order[q, r]] > 0}
    seen = []
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, run, schema: seen.append(run) or self.limit(0).selectExpr("0L query_id", "0L ord", "0D score"))
    retrieve.cosine(rows, asked, 3)
    assert dict(zip(seen[0].__code__.co_freevars, (c.cell_contents for c in seen[0].__closure__), strict=True))["step"] * 900 <= 1 << 20


def test_bigrams_are_dealt_by_size(spark, monkeypatch):
    from evidora.plans import retrieval_queries as R
    from tests.conftest import SMALL

    want = sorted(map(tuple, R.bigram_low_df(spark, SMALL).collect()))
    monkeypatch.setattr(R, "BIGRAM_CHARS", 10_000)
    rows = R.bigram_low_df(spark, SMALL)
    size = R.docs(spark, SMALL).agg(F.sum(F.length("text"))).first()[0]
    assert "hashpartitioning(bigram#" in rows._jdf.queryExecution().executedPlan().toString() and f", {size // 10_000 + 1})" in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, rows.collect())) == want
