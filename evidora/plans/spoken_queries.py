"""Queries on recorded speech: sessions inferred and made again, a recogniser's clock, answer spans, and events replayed as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidora.operators import scans, spoken
from evidora.session import scratch, table
from evidora.sources import replay
from evidora.streaming import engine

DAY = 24 * scans.HOUR


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as envelope events: clicks name a session, all others don't."""
    named = F.when(F.col("event_type") == "click", F.concat(F.lit("s"), F.col("event_id").cast("string")))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("source"), named.alias("session_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"), F.col("event_id").alias("seq"),
        "event_type", F.lit(None).cast("string").alias("utterance_id"), F.col("props").alias("text"), "value",
    )


def session_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.with_session(timed(spark, sf_dir), DAY).select("source", "seq", "session_id")


def serial_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When a recogniser that takes a user's events one after another has done each: an event lasts 20 minutes for each unit of its value."""
    rows = timed(spark, sf_dir).withColumn("lasts", F.floor(F.coalesce("value", F.lit(0.0))) * 1_200_000)
    return scans.serial_ends(rows, ["source"], "timestamp_ms", "timestamp_ms", "lasts", "ended_ms", DAY).groupBy("source", "timestamp_ms").agg(F.max("ended_ms").alias("ended_ms"))


def restream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as chunks, a second apart; replies as hypotheses at the time of the turn before."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"), F.min("text").alias("text"))
    told = turns.select(F.col("conv_id").alias("session_id"), (F.col("turn") * 1000 - F.when(F.col("role") == "assistant", 1000).otherwise(0)).alias("timestamp_ms"), F.col("turn").alias("seq"), "text", "role")
    made = spoken.restreamed(told.filter("role = 'user'"), told.filter("role = 'assistant'"))
    return made.select("session_id", "seq", "timestamp_ms", "event_type", F.sha2("text", 256).alias("text_sha256"), "committed_ms")


def best_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors stand in for a reader's scores: their components for starts, those in turned order for ends; five vectors a query."""
    rows = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 5").alias("query_id"), F.col("vec_id").alias("passage"), F.col("embedding").alias("starts"), F.reverse("embedding").alias("ends"))
    return spoken.best_spans(rows)


def spoken_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and benchmark items by the longest title that they begin with: the first one, two and three words of labelled documents."""
    docs = table(spark, sf_dir, "documents")
    good = docs.join(table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    titles = good.select(F.col("doc_id").alias("title_id"), F.explode(F.array(*[F.substring_index("text", " ", k) for k in (1, 2, 3)])).alias("title"))
    texts = docs.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text").union(table(spark, sf_dir, "benchmark").select(F.lit("item"), F.col("item_id"), "text"))
    return spoken.longest_prefix(texts, titles).select("kind", "id", "title_id", "title")


def replayed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events staged, streamed from the replay source and stored, each row with the number of the step that it came in."""
    folder, out = scratch(spark, "replay"), scratch(spark, "replayed")
    rows = timed(spark, sf_dir).withColumn("session_id", F.col("source"))
    replay.stage(rows.drop("source"), folder, rows=20_000, width=DAY)
    spark.dataSource.register(replay.ReplaySource)
    source = spark.readStream.format("evidora_replay").option("path", folder).option("steps", 4).load()
    query = source.writeStream.format("parquet").option("checkpointLocation", scratch(spark, "replay-offsets")).start(out)
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.schema(source.schema).parquet(out).select("seq", "session_id", "timestamp_ms", "event_type")


QUERIES = {f.__name__: f for f in (session_inference, serial_decode, restream, best_span, spoken_titles, replayed_events)}

_TIMED = "t AS (SELECT CAST(user_id AS VARCHAR) AS source, CASE WHEN event_type = 'click' THEN 's' || event_id END AS session_id, epoch_us(ts) // 1000 AS timestamp_ms, event_id AS seq, event_type, value FROM events)"

ORACLES = {
    "session_inference": f"""WITH {_TIMED} SELECT source, seq, coalesce(last_value(session_id IGNORE NULLS) OVER (PARTITION BY source ORDER BY timestamp_ms, session_id IS NOT NULL, seq ROWS UNBOUNDED PRECEDING), 'default') AS session_id FROM t""",
    "serial_decode": f"""WITH {_TIMED}, d AS (SELECT source, timestamp_ms, seq, CAST(floor(coalesce(value, 0)) AS BIGINT) * 1200000 AS lasts FROM t),
s AS (SELECT *, sum(lasts) OVER (PARTITION BY source ORDER BY timestamp_ms, lasts, seq ROWS UNBOUNDED PRECEDING) AS upto FROM d),
m AS (SELECT *, upto + greatest(0, max(timestamp_ms - upto + lasts) OVER (PARTITION BY source ORDER BY timestamp_ms, lasts, seq ROWS UNBOUNDED PRECEDING)) AS ended FROM s)
SELECT source, timestamp_ms, CAST(max(ended) AS BIGINT) AS ended_ms FROM m GROUP BY ALL""",
    "restream": """WITH a AS (SELECT conv_id AS session_id, turn, min(role) AS role, min(text) AS text FROM conversations GROUP BY ALL),
c AS (SELECT session_id, turn * 1000 AS timestamp_ms, turn AS own, text FROM a WHERE role = 'user' AND turn IS NOT NULL),
l AS (SELECT session_id, min(timestamp_ms) AS f, max(timestamp_ms) AS last FROM c GROUP BY ALL),
h AS (SELECT a.session_id, turn * 1000 - 1000 AS timestamp_ms, turn AS own, text FROM a JOIN l USING (session_id) WHERE role = 'assistant' AND text <> '' AND turn * 1000 - 1000 < last),
k AS (SELECT h.*, c.timestamp_ms AS committed_ms FROM h ASOF LEFT JOIN c ON h.session_id = c.session_id AND h.timestamp_ms >= c.timestamp_ms),
e AS (SELECT session_id, timestamp_ms, 'transcript_chunk' AS event_type, 1 AS r, own, text, NULL AS committed_ms FROM c
UNION ALL SELECT session_id, timestamp_ms, 'transcript_hypothesis', 2, own, text, committed_ms FROM k
UNION ALL SELECT session_id, least(0, f), 'session_start', 0, NULL, NULL, NULL FROM l
UNION ALL SELECT session_id, last + 1, 'utterance_end', 3, NULL, NULL, NULL FROM l
UNION ALL SELECT session_id, last + 2000, 'session_end', 4, NULL, NULL, NULL FROM l)
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY timestamp_ms, r, own, text) - 1 AS seq, timestamp_ms, event_type, sha256(text) AS text_sha256, committed_ms FROM e""",
    "best_span": """WITH v AS (SELECT vec_id // 5 AS query_id, vec_id AS passage, embedding AS s, list_reverse(embedding) AS e FROM embeddings),
p AS (SELECT query_id, passage, unnest(range(1, len(s))) AS i, s, e FROM v),
x AS (SELECT query_id, passage, i, CAST(s[i + 1] AS DOUBLE) AS s, CAST(e[i + 1] AS DOUBLE) AS e FROM p),
f AS (SELECT * FROM x WHERE s IS NOT NULL AND NOT isnan(s) QUALIFY row_number() OVER (PARTITION BY passage ORDER BY s DESC, i) <= 20),
t AS (SELECT * FROM x WHERE e IS NOT NULL AND NOT isnan(e) QUALIFY row_number() OVER (PARTITION BY passage ORDER BY e DESC, i) <= 20),
b AS (SELECT f.query_id, f.passage, f.i AS first, t.i AS last, f.s + t.e AS score FROM f JOIN t ON f.passage = t.passage AND t.i BETWEEN f.i AND f.i + 29),
n AS (SELECT query_id, min(CAST(s[1] AS DOUBLE) + CAST(e[1] AS DOUBLE)) AS least FROM v GROUP BY ALL)
SELECT b.query_id, score - least AS margin, score, passage, CAST(first AS INTEGER) AS first, CAST(last AS INTEGER) AS last FROM b JOIN n USING (query_id)
QUALIFY row_number() OVER (PARTITION BY b.query_id ORDER BY score DESC, passage, first, last) = 1""",
    "spoken_titles": """WITH g AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
t AS (SELECT title, min(doc_id) AS title_id FROM (SELECT doc_id, unnest([array_to_string(w[1:1], ' '), array_to_string(w[1:2], ' '), array_to_string(w[1:3], ' ')]) AS title FROM g) WHERE title <> '' GROUP BY title),
x AS (SELECT 'document' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'item', item_id, text FROM benchmark)
SELECT kind, id, title_id, title FROM x LEFT JOIN t ON starts_with(text, title) QUALIFY row_number() OVER (PARTITION BY kind, id ORDER BY length(title) DESC NULLS LAST) = 1""",
    "replayed_events": "SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS session_id, epoch_us(ts) // 1000 AS timestamp_ms, event_type FROM events",
}
