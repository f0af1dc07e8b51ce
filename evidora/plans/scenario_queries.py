"""Scenarios made from recorded questions, and samples by hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidora.operators import scenarios
from evidora.plans import sql as S
from evidora.session import table

PER_SOURCE = 20


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn of a conversation as a question, the conversation as its document."""
    rows = table(spark, sf_dir, "conversations").filter("role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL")
    return rows.select("conv_id", F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("key"), "text")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenarios.turns(asked(spark, sf_dir), "conv_id", "key", "text")


def scenario_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("scenario_id", "template", "utterance_id", "kind", "text", F.size("gold").alias("n_gold"), F.array_join("docs", ",").alias("docs"), "retrieval_required", "early")


def scenario_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events of each type a scenario's turns give, and when they begin and end."""
    made = scenarios.events(_turns(spark, sf_dir))
    return made.groupBy("session_id", "event_type").agg(F.count("*").alias("n"), F.min("timestamp_ms").alias("first_ms"), F.max("timestamp_ms").alias("last_ms"))


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty documents of each source and language, by hash: a sampling operator, over all rows."""
    return scenarios.bottom(table(spark, sf_dir, "documents").select("source", "lang", "doc_id"), ["source", "lang"], ["doc_id"], PER_SOURCE)


QUERIES = {f.__name__: f for f in (scenario_turns, scenario_timing, stratified_sample)}


def _draw(seed: int, key: str) -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || coalesce(CAST({key} AS VARCHAR), '')), 1, 12) AS BIGINT)"


def _line(lines: list[str], number: str) -> str:
    return f"([{', '.join(map(S.quoted, lines))}])[CAST({number} % {len(lines)} AS INT) + 1]"


def _words(text: str) -> str:
    return f"len(list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> ''))"


_TURNS = rf"""
    q AS (SELECT conv_id, conv_id || ':' || turn AS key, min(text) AS text FROM conversations
          WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL AND trim(text) <> '' GROUP BY 1, 2),
    d AS (SELECT *, {_draw(1, 'conv_id')} AS d, {_draw(0, 'key')} AS pos FROM q),
    t AS (SELECT *, {_line(scenarios.TEMPLATES, 'd')} AS template FROM d),
    s AS (SELECT *, CASE template WHEN 'multi_intent' THEN 2 + (d // 4) % 2 WHEN 'late_detail' THEN 2 ELSE 1 END AS size,
          row_number() OVER (PARTITION BY conv_id ORDER BY pos, key) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM t),
    a AS (SELECT * EXCLUDE (i, n), row_number() OVER (PARTITION BY template, size ORDER BY pos, key) - 1 AS i,
          count(*) OVER (PARTITION BY template, size) AS n FROM s WHERE i >= n - n % size),
    m AS (SELECT conv_id AS own_of, * FROM s WHERE i < n - n % size UNION ALL SELECT NULL AS own_of, * FROM a WHERE i < n - n % size),
    g AS (SELECT template, list(text ORDER BY i % size) AS x, list(CAST(conv_id AS VARCHAR) ORDER BY i % size) AS docs, min_by(key, i % size) AS k
          FROM m GROUP BY template, size, own_of, i // size),
    h AS (SELECT *, 'gen_' || template || '_' || k AS scenario_id, {_draw(2, 'k')} AS h FROM g),
    u AS (
        SELECT *, 'u1' AS utterance_id, 'new_request' AS kind, x[1] || ', ' || array_to_string(x[2:], ' and ') AS text, x AS gold, docs AS od, true AS required, true AS opens FROM h WHERE template = 'multi_intent'
        UNION ALL SELECT *, 'u1', 'new_request', x[1], x[1:1], docs[1:1], true, true FROM h WHERE template IN ('late_detail', 'suppression')
        UNION ALL SELECT *, 'u2', 'refinement', {_line(scenarios.LEADS, 'h')} || ' ' || x[2], x[2:2], docs[2:2], true, false FROM h WHERE template = 'late_detail'
        UNION ALL SELECT *, 'u2', 'presentation_only', {_line(scenarios.ASKS, 'h')}, [], [], false, false FROM h WHERE template = 'suppression'
        UNION ALL SELECT *, 'u1', 'chit_chat', {_line(scenarios.GREETINGS, 'h')}, [], [], false, false FROM h WHERE template = 'chit_chat'
        UNION ALL SELECT *, 'u2', 'new_request', x[1], x[1:1], docs[1:1], true, true FROM h WHERE template = 'chit_chat')
"""
ORACLES = {
    "scenario_turns": f"""WITH {_TURNS} SELECT scenario_id, template, utterance_id, kind, text, len(gold) AS n_gold, array_to_string(od, ',') AS docs, required AS retrieval_required,
        opens AND {_words('text')} > {scenarios.EARLY_WORDS} AS early FROM u""",
    "scenario_timing": f"""WITH {_TURNS}, w AS (SELECT scenario_id, utterance_id, {_words('text')} AS n FROM u),
        b AS (SELECT *, coalesce(sum(n * 400 + 1800) OVER (PARTITION BY scenario_id ORDER BY utterance_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM w),
        e AS (SELECT scenario_id, 'transcript_chunk' AS event_type, start + 400 * unnest(range(0, n, 6)) AS ms FROM b UNION ALL SELECT scenario_id, 'utterance_end', start + n * 400 + 300 FROM b),
        f AS (SELECT * FROM e UNION ALL SELECT scenario_id, 'session_start', min(ms) FROM e GROUP BY 1 UNION ALL SELECT scenario_id, 'session_end', max(ms) + 2000 FROM e GROUP BY 1)
        SELECT scenario_id AS session_id, event_type, count(*) AS n, CAST(min(ms) AS BIGINT) AS first_ms, CAST(max(ms) AS BIGINT) AS last_ms FROM f GROUP BY 1, 2""",
    "stratified_sample": f"""SELECT source, lang, doc_id FROM documents
        QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY {_draw(0, 'doc_id')}, doc_id NULLS FIRST) <= {PER_SOURCE}""",
}
