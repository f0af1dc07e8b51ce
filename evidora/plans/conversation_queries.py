"""Queries on conversations as event streams: turns of the engine, sub-queries, agreement, model answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidora.operators import generative
from evidora.plans import answer_queries as A
from evidora.plans import sql as S
from evidora.plans import text_queries as Q
from evidora.session import table
from evidora.sources import corpus
from evidora.streaming import engine


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelope events of the conversations' user turns and of one authored session."""
    own = spark.createDataFrame([("own", f"u{i}", i * 100_000, x) for i, x in Q.UTTERANCES], "session_id string, utterance_id string, start_ms long, text string")
    return Q.chunk_events(spark, sf_dir).unionByName(corpus.utterance_events(own))


def engine_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turn results. A state machine over events, which SQL can't express: checked in the tests."""
    rows = engine.replay(events(spark, sf_dir)).filter("row = 'turn'")
    return rows.select("session_id", "utterance_id", "turn_kind", "reason", F.array_join("live", "|").alias("live"), F.array_join("cancelled", "|").alias("cancelled"), "retrieval_required")


def engine_deferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = engine.replay(events(spark, sf_dir), mode="deferred").filter("row = 'query'")
    return rows.select("session_id", "utterance_id", "query_id", "text", "label", "trigger", "parent")


def engine_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query of each whole utterance."""
    rows = engine.replay(events(spark, sf_dir), mode="baseline").filter("row = 'query'")
    return rows.select("session_id", "utterance_id", "query_id", "text")


def decompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sub-queries as they are issued while the text arrives."""
    rows = engine.replay(events(spark, sf_dir)).filter("row = 'query'")
    return rows.select("session_id", "utterance_id", "query_id", "text", "trigger", "parent")


def supersession(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-queries that are still live at the end of their turn."""
    return engine.live_queries(engine.replay(events(spark, sf_dir))).select("session_id", "utterance_id", "query_id", "text")


def local_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant lines of a conversation as decodings in a row."""
    a = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    h = a.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.transform(F.split(F.coalesce("text", F.lit("")), " "), lambda w, i: F.when(i % 9 < 4 + F.col("turn") % 3, F.lit("w")).otherwise(w)).alias("words"))
    return engine.agreed(h).select("session_id", "seq", "agreed", "committed", F.array_join("new", " ").alias("new"))


def stream_session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = engine.session_counts(table(spark, sf_dir, "events"))
    return rows.select("user_id", F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"), "n")


def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that can't be routed, with the reason."""
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 50 == 0, None).otherwise(F.col("event_id")).alias("timestamp_ms"), F.when(F.col("event_type") == "view", "transcript_chunk").when(F.col("event_type") == "error", None).otherwise(F.col("event_type")).alias("event_type"))
    return corpus.routed(e)[1].select("event_id", "reason")


def model_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of a stated form parsed and verified against the evidence."""
    rows = A.evidence(spark, sf_dir).filter("rank <= 2").select(F.col("query_id").alias("turn_id"), "query", "rank", "citation", "text")
    cited = rows.filter("rank = 1").select("turn_id", "query", "citation")
    reply = F.concat(F.lit('Sure: ```json {"claims": [{"text": "'), F.regexp_replace("query", '["\\\\\n]', " "), F.lit('", "citations": ["'), F.col("citation"), F.lit('", "none §1"]}, {"text": "In 1999 it was 77", "citations": ["'), F.col("citation"), F.lit('"]}, {"text": "Nothing", "citations": ["x"]}]} ```'))
    claims = cited.select("turn_id", F.posexplode(generative.parsed_claims(reply)).alias("at", "c")).select("turn_id", F.concat_ws("/", F.col("turn_id").cast("string"), F.col("at").cast("string")).alias("claim_id"), "c.text", "c.citations")
    found = generative.verified(claims, rows.select("turn_id", "citation", "text"))
    return found.select("claim_id", F.array_join("citations", "|").alias("citations"), F.round("support", 6).alias("support"), "verdict")


QUERIES = {f.__name__: f for f in (engine_turns, engine_deferred, engine_baseline, decompose, supersession, local_agreement, stream_session_counts, dead_letters, model_claims)}

_OWN = S.values("own", "id, text", Q.UTTERANCES)

ORACLES = {
    "engine_baseline": f"""WITH {Q.EVENTS_SQL}, {_OWN}, x AS (SELECT session_id, utterance_id, trim(string_agg(text, '' ORDER BY seq)) AS text FROM e WHERE event_type = 'transcript_chunk' GROUP BY ALL
UNION ALL SELECT 'own', 'u' || id, array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''), ' ') FROM own)
SELECT session_id, utterance_id, utterance_id || '.q1' AS query_id, text FROM x WHERE text <> ''""",
    "local_agreement": """WITH h AS (SELECT conv_id, turn, list_transform(string_split(coalesce(min(text), ''), ' '), lambda w, i: CASE WHEN (i - 1) % 9 < 4 + turn % 3 THEN 'w' ELSE w END) AS w FROM conversations GROUP BY conv_id, turn),
p AS (SELECT *, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS v FROM h),
a AS (SELECT *, CAST(CASE WHEN v IS NULL THEN 0 ELSE coalesce(list_position(list_transform(range(1, least(len(v), len(w)) + 1), lambda i: v[i] = w[i]), false) - 1, least(len(v), len(w))) END AS INTEGER) AS agreed FROM p),
c AS (SELECT *, max(agreed) OVER (PARTITION BY conv_id ORDER BY turn) AS committed FROM a),
n AS (SELECT *, coalesce(lag(committed) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS b FROM c)
SELECT conv_id AS session_id, turn AS seq, agreed, committed, CASE WHEN committed > b THEN array_to_string(w[b + 1:committed], ' ') ELSE '' END AS "new" FROM n""",
    "stream_session_counts": """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
k AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS started, epoch_us(max(ts) + INTERVAL 30 MINUTE) AS ended, count(*) AS n FROM k GROUP BY user_id, k""",
    "dead_letters": "SELECT event_id, CASE WHEN event_id % 50 = 0 OR event_type = 'error' THEN 'malformed' ELSE 'unknown event type' END AS reason FROM events WHERE event_id % 50 = 0 OR event_type <> 'view'",
    "model_claims": f"""WITH {A._BASE}, z AS (SELECT item_id, query, citation, list_distinct(c) AS c, text FROM e WHERE rank = 1),
nm AS (SELECT *, list_distinct(list_transform(regexp_extract_all(text, '\\d+(?:\\.\\d+)?'), lambda x: x)) AS nums FROM z)
SELECT item_id || '/0' AS claim_id, citation AS citations, round({A._SUPPORT.replace('claim', 'query').replace('found', 'c')}, 6) AS support, CASE WHEN {A._SUPPORT.replace('claim', 'query').replace('found', 'c')} < 0.55 THEN 'unsupported' ELSE 'kept' END AS verdict FROM nm
UNION ALL SELECT item_id || '/1', citation, round({A._SUPPORT.replace('claim', "'In 1999 it was 77'").replace('found', 'c')}, 6), CASE WHEN NOT list_contains(nums, '1999') AND NOT list_contains(nums, '77') THEN 'number_conflict' ELSE 'unsupported' END FROM nm
UNION ALL SELECT item_id || '/2', '', NULL, 'fabricated' FROM nm""",
}
