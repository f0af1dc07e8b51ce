"""Queries on runs against gold: items, evidence and labelled documents stand in for questions, and user events for traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidora import config as C
from evidora.functions import text as T
from evidora.operators import evaluate as E
from evidora.operators import generative
from evidora.operators import runs as R
from evidora.plans import answer_queries as A
from evidora.plans import conversation_queries as V
from evidora.plans import evaluation_queries as base
from evidora.plans import retrieval_queries
from evidora.plans import sql as S
from evidora.plans import text_queries as Q
from evidora.session import table
from evidora.streaming import engine, sinks


def _numbered(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(prefix), value.cast("string"))


def _word(k: int) -> Column:
    return F.coalesce(F.get("w", F.lit(k)), F.lit(""))


def _start(words: Column | str, n: Column | int) -> Column:
    return F.array_join(F.slice(words, 1, n), " ")


def question_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item is a turn's only question, its first words the answer given."""
    i = F.col("item_id")
    b = table(spark, sf_dir, "benchmark").select("item_id", T.tokens(F.coalesce("text", F.lit(""))).alias("w"), _numbered("s", i % 7).alias("session_id"), _numbered("u", i).alias("utterance_id"))
    kind = F.when(i % 5 == 0, "chit_chat").when(i % 5 == 1, "refinement").otherwise("new_request")
    gold = b.select(*E.TURN, F.lit(0).alias("at"), kind.alias("kind"), F.array(_word(1), _word(8)).alias("answers"), F.array(_numbered("d", i % 3)).alias("relevant"), F.when(i % 2 == 0, _word(1)).otherwise("").alias("title"))
    results = b.filter(i % 11 != 0).select(*E.TURN, _start("w", 5).alias("answer"), F.array(_numbered("d", i % 2)).alias("citations"))
    return R.question_outcomes(gold, results)


def split_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches started as queries emitted, every fourth completed one as a cancelled query."""
    e = F.col("event")
    event = F.when(e == "retrieval_started", "sub_queries_emitted").when((e == "retrieval_completed") & (F.col("event_id") % 4 == 0), "retrieval_cancelled").otherwise("other")
    rows = base.trace(spark, sf_dir).select(*E.TURN, event.alias("event"), F.array("request_id").alias("query_ids"))
    return R.split_outcomes(base.gold(spark, sf_dir).withColumn("kind", F.lit("new_request")), R.live_counts(rows))


def _cited_at(spark: SparkSession, sf_dir: str, own: DataFrame, rank: Column) -> DataFrame:
    """(query_id, relevant): the citation of each item's evidence at a rank, or none."""
    found = own.filter(F.col("rank") == rank).select("query_id", F.array("citation").alias("relevant"))
    return retrieval_queries.items(spark, sf_dir).join(found, "query_id", "left").withColumn("relevant", F.coalesce("relevant", F.array().cast("array<string>")))


def retrieval_ceilings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An item is the question, its first words the sub-query."""
    i = F.col("query_id")
    own = A.stored_evidence(spark, sf_dir)
    rows = _cited_at(spark, sf_dir, own, 1 + i % 7).withColumn("w", T.tokens(F.col("query")))
    questions = rows.select(i.alias("question_id"), i.alias("turn_id"), F.col("query").alias("question"), "relevant", T.informative(F.array(_word(3)), F.lit("")).alias("answers"))
    asked = rows.select(i.alias("turn_id"), "query_id", _start("w", (1 + i % 9).cast("int")).alias("text"))
    return R.stage_ceilings(questions, asked, own.select("query_id", "rank", "citation", "text"))


def wrong_claim_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first words of each piece of evidence as a claim."""
    i = F.col("query_id")
    own = A.stored_evidence(spark, sf_dir)
    source = F.when(F.col("rank") != 4, _start(T.tokens(F.col("query")), (F.col("rank") * 3).cast("int")))
    claims = own.select(i.alias("turn_id"), (i * 10 + F.col("rank")).alias("claim_id"), _start(T.tokens(F.col("text")), 8).alias("text"), F.array("citation").alias("citations"), source.alias("source"))
    rows = _cited_at(spark, sf_dir, own, F.lit(2)).withColumn("w", T.tokens(F.col("query")))
    gold = rows.select(i.alias("turn_id"), F.col("query").alias("question"), "relevant", F.array(_word(4)).alias("answers"), (i % 4 == 0).alias("unanswerable"))
    return R.claim_causes(claims, gold).select("claim_id", "cause")


def failure_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items without a claim from their gold document, and turns that searched late."""
    own = A.stored_evidence(spark, sf_dir)
    rows = _cited_at(spark, sf_dir, own, 1 + F.col("query_id") % 7)
    pairs = rows.select("query_id", F.coalesce(T.citation_doc(F.get("relevant", F.lit(0))), F.lit("none")).alias("gold_doc"))
    found = R.retrieval_failures(pairs, own)
    late = R.late_turns(E.turns(base.trace(spark, sf_dir)), base.gold(spark, sf_dir))
    return found.select(F.col("query_id").cast("string").alias("item"), "bucket").union(late.select(F.concat_ws("/", *E.TURN), "bucket"))


def median_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as scenarios, event types as repeats."""
    return R.median_runs(table(spark, sf_dir, "events"), "user_id", "event_type")


def pooled_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages as sets, sources as scenarios, documents as items."""
    rows = base.labelled(spark, sf_dir).select(F.col("lang").alias("set"), F.col("source").alias("scenario"), F.col("doc_id").alias("item"), _numbered("m", F.col("doc_id") % 3).alias("metric"), "answerable", "correct", "score")
    a, b = rows.withColumn("value", F.col("answerable").cast("double")), rows.filter("score < 0.9").withColumn("value", F.col("correct").cast("double"))
    return R.pooled_means(R.pooled(a, b))


MARK = dict(zip(("chunk_received", "controller_decision", "retrieval_completed", "answer_version_created", "retrieval_started", "output_emitted"), C.TURN_MARKS, strict=True))


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.element_at(F.create_map(*(F.lit(x) for pair in MARK.items() for x in pair)), F.col("event"))
    return base.trace(spark, sf_dir).select(*E.TURN, mark.alias("mark"), F.col("ts_ms").alias("ms"))


def stage_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.stage_timings(_marks(spark, sf_dir))


def stage_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.stage_summary(R.stage_timings(_marks(spark, sf_dir)).select("stage", "ms"))


def slow_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.slow_outputs(R.stage_timings(_marks(spark, sf_dir)))


def sink_overhead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as sinks."""
    return R.sink_overhead(table(spark, sf_dir, "events").select(F.col("event_type").alias("sink"), F.col("value").alias("ms")), "view")


def gate_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four documents as the sub-queries of an item."""
    d = F.col("doc_id")
    rows = base.labelled(spark, sf_dir).select(
        F.floor(d / 4).alias("item_id"), d.alias("at"), F.col("score").alias("top"), F.when(d % 3 != 0, F.col("score") * 2).alias("sentence"), F.when(d % 5 != 0, F.col("score") * 4).alias("reader_margin"),
        *(F.lit(None).cast("double").alias(c) for c in C.FEATURES[3:-1]), F.when(F.col("answerable"), F.col("source")).alias("rd_claim"), F.when(F.col("correct"), F.concat_ws(" ", "lang", "source")).alias("ce_claim"),
        F.when(d % 2 == 0, F.upper("source")).otherwise(F.lit("")).alias("reader_span"),
    )
    return R.gate_features(rows)


def edge_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("item", F.col("event_id").cast("string"))
    checks = e.select("item", F.when(F.col("event_id") % 97 == 0, F.array(F.lit("x"), _numbered("y", F.col("user_id")))).otherwise(F.array().cast("array<string>")).alias("fabricated"))
    errors = e.filter("event_type = 'error'").select("item", F.lit("timeout").alias("error_type"), F.col("props").alias("message"))
    turns = e.select("item", F.when(F.col("event_type") == "signup", "not certain").otherwise("").alias("uncertainty"), F.when(F.col("event_id") % 3 == 0, "degraded").when(F.col("event_id") % 3 == 1, "final").alias("reason"))
    return R.edge_cases(checks, errors, turns)


def turn_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of turns that ask one query of the whole utterance; the answer is left to later stages."""
    made = sinks.turn_results(engine.replay(V.events(spark, sf_dir), mode="baseline"))
    own = sinks.records(made.drop("reason")).select(F.transform("retrieval_events", lambda x: F.concat_ws("|", x.timestamp_s.cast("decimal(20,3)").cast("string"), x.query, x.trigger)).alias("e"), "sub_queries", "answer", "citations", "uncertainty")
    return own.select(F.array_join("e", ";").alias("retrieval_events"), F.array_join("sub_queries", ";").alias("sub_queries"), *(F.coalesce(c, F.lit("-")).alias(c) for c in ("answer", "citations", "uncertainty"))).groupBy(*C.RECORD_FIELDS).agg(F.count("*").alias("n"))


def sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", T.pieces(F.coalesce("text", F.lit(""))).alias("p"))
    return rows.select("doc_id", F.size("p").alias("n"), F.md5(F.array_join("p", "|").cast("binary")).alias("pieces"))


def claim_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.array_sort(T.claim_words(F.coalesce("text", F.lit("")))).alias("w"))
    return rows.select("doc_id", F.size("w").alias("n"), F.md5(F.array_join("w", " ").cast("binary")).alias("words"))


def claim_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with one last digit as a session."""
    own = A.stored_evidence(spark, sf_dir)
    claims = A.claimed(own).select((F.col("claim_id") % 10).alias("session_id"), "claim_id", F.reverse("citations").alias("citations"))
    found = own.select((F.col("query_id") % 10).alias("session_id"), "query_id", "citation", (F.col("rank") * 100_000 + F.col("query_id")).alias("at"))
    return generative.claim_queries(claims, found)


QUERIES = {f.__name__: f for f in (
    question_outcomes, split_outcomes, retrieval_ceilings, wrong_claim_causes, failure_buckets, median_runs, pooled_runs, stage_timings, stage_latency, slow_outputs, sink_overhead, gate_features, edge_cases, turn_records,
    sentence_pieces, claim_words, claim_queries,
)}

_L, _TRACE, _GOLD = base._L, base._TRACE, base._GOLD
_Q = f"q0 AS (SELECT item_id, text AS query, {S.tokens('text')} AS w FROM benchmark)"
_HOLDS = lambda text, answer: f"contains(' ' || {text} || ' ', ' ' || {answer} || ' ')"
_TIMES = f"""{_TRACE}, m0 AS (SELECT session_id, utterance_id, ts_ms, coalesce(list_position({list(MARK)}, event), 0) AS place FROM t WHERE utterance_id IS NOT NULL),
m AS (SELECT session_id, utterance_id, place, max(ts_ms) AS ms FROM m0 WHERE place > 0 GROUP BY ALL),
tm AS (SELECT session_id, utterance_id, CASE WHEN place = 6 THEN 'post_speech' ELSE ({C.TURN_MARKS})[place] END AS stage, round(ms - CASE WHEN place = 6 THEN e0 ELSE b END, 3) AS ms
  FROM (SELECT *, max(ms) FILTER (place = 1) OVER (PARTITION BY session_id, utterance_id) AS e0, lag(ms) OVER (PARTITION BY session_id, utterance_id ORDER BY place) AS b FROM m) WHERE e0 IS NOT NULL AND (place = 6 OR b IS NOT NULL))"""
_NEAR = lambda a, b: S.jaccard(f"list_distinct({S.content(a)})", f"list_distinct({S.content(b)})")
_OWN = S.values("own", "id, text", Q.UTTERANCES)

ORACLES = {
    "question_outcomes": f"""WITH b AS (SELECT item_id AS i, {S.tokens("coalesce(text, '')")} AS w FROM benchmark), g AS (SELECT *, coalesce(w[2], '') AS a1, coalesce(w[9], '') AS a2, CASE WHEN i % 2 = 0 THEN coalesce(w[2], '') ELSE '' END AS title, array_to_string(w[1:5], ' ') AS answer FROM b WHERE i % 5 <> 0),
n AS (SELECT i, {S.normal_answer('a1')} AS n1, {S.normal_answer('a2')} AS n2, {S.normal_answer('title')} AS nt, {S.normal_answer('answer')} AS na FROM g), k AS (SELECT *, list_filter([n1, n2], lambda x: x <> '' AND NOT {_HOLDS('nt', 'x')}) AS good, i % 11 <> 0 AND i % 3 = i % 2 AS cited FROM n)
SELECT 's' || (i % 7) AS session_id, 'u' || i AS utterance_id, 0 AS at, CASE WHEN len(good) = 0 THEN cited ELSE i % 11 <> 0 AND len(list_filter(good, lambda x: {_HOLDS('na', 'x')})) > 0 END AS answered, cited FROM k""",
    "split_outcomes": f"""WITH {_TRACE}, {_GOLD}, x AS (SELECT session_id, utterance_id, request_id, bool_or(event = 'retrieval_started') AS e, bool_or(event = 'retrieval_completed' AND CAST(wall_ms AS BIGINT) % 4 = 0) AS c FROM t WHERE utterance_id IS NOT NULL GROUP BY ALL),
l AS (SELECT session_id, utterance_id, count(*) FILTER (e AND NOT c) AS n_live FROM x GROUP BY ALL),
k AS (SELECT count(*) FILTER (n_gold >= 2) AS n_compound, count(*) FILTER (n_gold >= 2 AND n_live = n_gold) AS n_exact, count(*) FILTER (n_gold = 1) AS n_single, count(*) FILTER (n_gold = 1 AND n_live > 1) AS n_over FROM gd JOIN l USING (session_id, utterance_id))
SELECT *, round(coalesce(n_exact / nullif(n_compound, 0), 1.0), 6) AS exact_rate, round(coalesce(n_over / nullif(n_single, 0), 0.0), 6) AS over_rate FROM k""",
    "retrieval_ceilings": f"""WITH {A._BASE}, {_Q}, k AS (SELECT item_id, query, array_to_string(w[1:1 + item_id % 9], ' ') AS sub, {S.normal_answer("coalesce(w[4], '')")} AS a, (SELECT max(citation) FROM e WHERE e.item_id = q0.item_id AND rank = 1 + q0.item_id % 7) AS g FROM q0),
x AS (SELECT k.item_id, {_NEAR('k.query', 'k.sub')} >= 0.5 AS iso, e.rank, coalesce(e.citation = g, false) AS hit, CASE WHEN a <> '' THEN len(list_filter({S.sentences('e.text')}, lambda s: {_HOLDS(S.normal_answer('s'), 'a')})) > 0 ELSE e.citation = g END AS top FROM k LEFT JOIN e ON e.item_id = k.item_id)
SELECT item_id AS question_id, bool_or(iso) AS isolated, bool_or(iso AND hit) AS gold_in_evidence, bool_or(iso AND coalesce(rank <= 3 AND top, false)) AS answer_in_top3 FROM x GROUP BY item_id""",
    "wrong_claim_causes": f"""WITH {A._BASE}, {_Q}, k AS (SELECT q0.item_id, query, w, {S.normal_answer("coalesce(w[5], '')")} AS a, e2.citation AS g FROM q0 LEFT JOIN (SELECT item_id, citation FROM e WHERE rank = 2) e2 USING (item_id)),
x0 AS (SELECT e.item_id * 10 + e.rank AS claim_id, k.item_id, a, g, k.query, e.citation, array_to_string(({S.tokens('e.text')})[1:8], ' ') AS said, CASE WHEN e.rank <> 4 THEN array_to_string(w[1:e.rank * 3], ' ') END AS source FROM e JOIN k USING (item_id)),
x AS (SELECT claim_id, item_id, coalesce(citation = g, false) OR (a <> '' AND {_HOLDS(S.normal_answer('said'), 'a')}) AS ok, CASE WHEN source IS NULL THEN 0.0 ELSE {_NEAR('query', 'source')} END AS near FROM x0)
SELECT claim_id, CASE WHEN item_id % 4 = 0 THEN 'answered_unanswerable' WHEN near < 0.5 THEN 'spurious_subquery' ELSE 'wrong_passage' END AS cause FROM x WHERE NOT ok""",
    "failure_buckets": f"""SELECT item, bucket FROM (WITH {A._BEST} SELECT CAST(b0.item_id AS VARCHAR) AS item, CASE WHEN s6.rank IS NULL THEN 'A' ELSE 'B' END AS bucket FROM benchmark b0 LEFT JOIN s6 ON s6.item_id = b0.item_id AND s6.rank = 1 + b0.item_id % 7 WHERE s6.rank IS NULL OR NOT s6.relevant)
UNION ALL SELECT item, bucket FROM (WITH {_TRACE}, {_GOLD} SELECT session_id || '/' || utterance_id AS item, 'C' AS bucket FROM gt WHERE eligible AND end_ms IS NOT NULL AND (retrieval_ms IS NULL OR retrieval_ms >= end_ms))""",
    "median_runs": "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n, event_type) AS k, count(*) OVER (PARTITION BY user_id) AS m FROM c) SELECT user_id, event_type, n FROM r WHERE k = m // 2 + 1",
    "pooled_runs": f"WITH {_L} SELECT 'm' || (doc_id % 3) AS metric, count(*) AS n_paired, count(DISTINCT lang || ':' || source) AS n_clusters, round(avg(CAST(answerable AS INT)), 6) AS baseline, round(avg(CAST(correct AS INT)), 6) AS candidate, round(avg(CAST(correct AS INT) - CAST(answerable AS INT)), 6) AS diff FROM l WHERE score < 0.9 GROUP BY 1",
    "stage_timings": f"WITH {_TIMES} SELECT session_id, utterance_id, stage, ms FROM tm",
    "stage_latency": f"WITH {_TIMES} SELECT stage, count(*) AS n, round(quantile_cont(ms, 0.5), 3) AS p50, round(quantile_cont(ms, 0.95), 3) AS p95, round(quantile_cont(ms, 0.99), 3) AS p99, round(max(ms), 3) AS max, round(avg(ms), 3) AS mean FROM tm GROUP BY stage",
    "slow_outputs": f"""WITH {_TIMES}, w AS (SELECT session_id, utterance_id, stage, ms FROM tm WHERE stage <> 'post_speech' QUALIFY row_number() OVER (PARTITION BY session_id, utterance_id ORDER BY ms DESC, stage DESC) = 1)
SELECT tm.session_id, tm.utterance_id, tm.ms AS post_speech, w.stage, w.ms FROM tm LEFT JOIN w USING (session_id, utterance_id) WHERE tm.stage = 'post_speech' AND tm.ms > 5""",
    "sink_overhead": """WITH s AS (SELECT event_type AS sink, list_sort(list(value)) AS v FROM events GROUP BY ALL), p AS (SELECT sink, v[1 + CAST(floor(CAST(0.5 AS DOUBLE) * (len(v) - 1)) AS BIGINT)] AS p50, v[1 + CAST(floor(CAST(0.95 AS DOUBLE) * (len(v) - 1)) AS BIGINT)] AS p95 FROM s), b AS (SELECT p50 AS b50, p95 AS b95 FROM p WHERE sink = 'view')
SELECT sink, p50, p95, round(100 * (p50 - b50) / nullif(b50, 0), 1) AS p50_pct, round(100 * (p95 - b95) / nullif(b95, 0), 1) AS p95_pct FROM p, b""",
    "gate_features": f"""WITH {_L}, k AS (SELECT * FROM l WHERE (answerable AND source <> '') OR (correct AND lang || ' ' || source <> '') QUALIFY row_number() OVER (PARTITION BY doc_id // 4 ORDER BY answerable DESC, score DESC, doc_id) = 1)
SELECT doc_id // 4 AS item_id, score AS top, CASE WHEN doc_id % 3 <> 0 THEN score * 2 ELSE -10.0 END AS sentence, CASE WHEN doc_id % 5 <> 0 THEN score * 4 ELSE -10.0 END AS reader_margin, 0.0 AS overlap_ce, 0.0 AS overlap_section, 0.0 AS margin, 0.5 AS nli_contra_rd, 0.5 AS nli_entail_rd, CASE WHEN doc_id % 2 = 0 AND correct THEN 1.0 ELSE 0.0 END AS agree FROM k""",
    "edge_cases": """SELECT CAST(event_id AS VARCHAR) AS item, 'grounding' AS gate, 'fabricated citations' AS issue, 'x|y' || user_id AS detail FROM events WHERE event_id % 97 = 0 UNION ALL SELECT CAST(event_id AS VARCHAR), 'robustness', 'timeout', props FROM events WHERE event_type = 'error'
UNION ALL SELECT CAST(event_id AS VARCHAR), 'grounding', 'uncertainty flagged', 'not certain' FROM events WHERE event_type = 'signup' AND event_id % 3 <> 0""",
    "sentence_pieces": f"WITH p AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {S.quoted(T.PIECE)}) AS p FROM documents) SELECT doc_id, len(p) AS n, md5(array_to_string(p, '|')) AS pieces FROM p",
    "claim_words": f"WITH p AS (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), {S.quoted(C.CLAIM_WORD)}), lambda w: length(w) > 2 AND NOT list_contains({S.words(C.CLAIM_STOPWORDS)}, w)))) AS w FROM documents) SELECT doc_id, len(w) AS n, md5(array_to_string(w, ' ')) AS words FROM p",
    "claim_queries": f"""WITH {A._CLAIMS}, fq AS (SELECT item_id % 10 AS session_id, citation, arg_min(item_id, rank * 100000 + item_id) AS query_id FROM e GROUP BY ALL), r AS (SELECT claim_id, unnest(list_reverse(cs)) AS citation, unnest(range(1, len(cs) + 1)) AS place FROM cl)
SELECT session_id, claim_id, arg_min(query_id, place) AS query_id FROM r JOIN fq ON fq.session_id = r.claim_id % 10 AND fq.citation = r.citation GROUP BY ALL""",
    "turn_records": f"""WITH {Q.EVENTS_SQL}, {_OWN}, x AS (SELECT trim(string_agg(CASE WHEN event_type = 'transcript_chunk' THEN text ELSE '' END, '' ORDER BY seq)) AS text, max(timestamp_ms) FILTER (event_type = 'utterance_end') AS ms FROM e GROUP BY session_id, utterance_id),
o AS (SELECT id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS w FROM own), y AS (SELECT text, ms FROM x WHERE ms IS NOT NULL UNION ALL SELECT array_to_string(w, ' '), id * 100000 + CASE WHEN len(w) > 0 THEN len(w) * 400 + 300 ELSE 0 END FROM o),
z AS (SELECT CASE WHEN text = '' THEN '' ELSE printf('%.3f', ms / 1000) || '|' || text || '|final' END AS retrieval_events, text AS sub_queries FROM y) SELECT retrieval_events, sub_queries, '-' AS answer, '-' AS citations, '-' AS uncertainty, count(*) AS n FROM z GROUP BY ALL""",
}
