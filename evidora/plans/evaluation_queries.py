"""Queries on traces, gates, quality and statistics, over tables that stand in for an engine's log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidora import config as C
from evidora.functions import stats
from evidora.functions import text as T
from evidora.operators import evaluate as E
from evidora.operators import ranks
from evidora.plans import sql as S
from evidora.session import table

KIND = {"view": "chunk_received", "click": "retrieval_started", "purchase": "retrieval_completed", "signup": "answer_version_created", "error": "output_emitted"}


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User events as a trace: a user is a session, a day an utterance; every seventh event belongs to the session."""
    e = table(spark, sf_dir, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    event = F.lit("controller_decision")
    for k, v in KIND.items():
        event = F.when(F.col("event_type") == k, v).otherwise(event)
    event = F.when(F.col("event_id") % 5 == 0, "controller_decision").otherwise(event)
    return e.select(
        event.alias("event"), ms.cast("double").alias("ts_ms"), F.col("event_id").cast("double").alias("wall_ms"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"),
        F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("u"), F.floor(ms / 86_400_000).cast("string"))).alias("utterance_id"), (F.col("event_id") % 3 == 0).alias("is_final"),
        F.concat(F.lit("r"), (F.col("event_id") % 2).cast("string")).alias("request_id"), F.col("value"), F.col("event_id"),
    )


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trace(spark, sf_dir).filter("utterance_id IS NOT NULL").select(*E.TURN).distinct()
    h = F.conv(F.substring(F.md5(F.concat("session_id", "utterance_id").cast("binary")), 1, 6), 16, 10).cast("long")
    return t.select(*E.TURN, (h % 2 == 0).alias("eligible"), (h % 3 == 0).alias("retrieval_required"), (h % 4).cast("long").alias("n_gold"))


def trace_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.turns(trace(spark, sf_dir)).select("session_id", "utterance_id", "n", "first_ms", "last_ms", "end_ms", "retrieval_ms", "first_event")


def gate_early(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.gate_early(E.turns(trace(spark, sf_dir)), gold(spark, sf_dir))


def gate_multi_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.gate_multi_intent(trace(spark, sf_dir).filter("event = 'retrieval_started' AND utterance_id IS NOT NULL").select(*E.TURN, F.col("request_id").alias("query_id")), gold(spark, sf_dir))


def gate_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.gate_grounding(table(spark, sf_dir, "events").select((F.col("event_id") % 4).alias("n_claims"), F.least(F.col("event_id") % 4, F.col("user_id") % 4).alias("n_supported"), F.when(F.col("event_id") % 97 == 0, 1).otherwise(0).alias("n_fabricated")))


def gate_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trace(spark, sf_dir).filter("utterance_id IS NOT NULL")
    return E.coverage_problems(t, E.turns(t))


def gate_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of conversations: each assistant turn, every third one a refinement."""
    a = table(spark, sf_dir, "conversations").filter("role = 'assistant'").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    v = a.select(F.col("conv_id").alias("session_id"), n.alias("version"), F.when(n > 1, n - 1).alias("parent_version"), F.when(F.col("turn") % 3 == 0, "refinement").otherwise("initial").alias("change_kind"), F.array_distinct(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.length(x) % 3)).alias("citations"))
    return E.gate_lineage(v)


def suite_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate rates with thresholds and verdicts, and a total by rollup."""
    rows = gold(spark, sf_dir).join(E.turns(trace(spark, sf_dir)), E.TURN).select(F.when(F.col("eligible"), "eligible").otherwise("other").alias("class"), (F.col("retrieval_ms") < F.col("end_ms")).alias("early"))
    made = rows.rollup("class").agg(F.count("*").alias("n"), F.count_if("early").alias("early"))
    share = E.rate(F.col("early"), F.col("n"))
    return made.select(F.coalesce("class", F.lit("all")).alias("class"), "n", "early", F.round(share, 6).alias("rate"), (share >= E.GATES["early"][0]).alias("passed"))


PRICES = [("user", 0.5, 1.5), ("assistant", 1.0, 2.0)]


def llm_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("role").alias("model"), T.token_estimate(F.coalesce("text", F.lit(""))).alias("tokens_in"), (F.col("turn") * 10).alias("tokens_out"))
    costs = E.call_costs(c, spark.createDataFrame(PRICES, "model string, price_in double, price_out double"))
    return costs.groupBy("conv_id").agg(F.count("*").alias("n_calls"), F.sum("tokens_in").alias("tokens_in"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as scored questions: quality is whether one can be answered, density the score."""
    l = table(spark, sf_dir, "labels").filter("doc_id IS NOT NULL")
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    return d.join(l, "doc_id").select("doc_id", "lang", "source", (F.col("quality") == 1).alias("answerable"), (F.col("toxic") == 0).alias("correct"), F.round(T.ratio(F.size(T.content_set(F.col("text"))), F.size(T.content(F.col("text")))), 6).alias("score"))


def wilson_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).groupBy("lang").agg(F.count_if("answerable").alias("k"), F.count("*").alias("n"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return rows.select("lang", "k", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def abstention(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).filter(~F.col("answerable"))
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("score") < 0.5).alias("abstained"))


def claim_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New lines of each assistant turn against the one before; a claim is right if its length is even."""
    a = table(spark, sf_dir, "conversations").filter("role = 'assistant'").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = a.withColumn("version", n).select(F.col("conv_id").alias("session_id"), "version", (F.col("version") - 1).alias("parent_version"), F.lit("initial").alias("change_kind"), F.explode(F.array_distinct(F.split(F.coalesce("text", F.lit("")), "\n"))).alias("text")).withColumn("citations", F.array(F.lit("c")))
    return E.new_claims(rows).groupBy("session_id").agg(F.count("*").alias("n_claims"), F.count_if(F.length("text") % 2 == 0).alias("n_correct"), F.round(F.avg(F.size(F.split(F.trim("text"), r"\s+"))), 6).alias("words"))


SHARES = {f"p{int(q * 100)}": q for q in (0.5, 0.95, 0.99)}


def percentiles_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    of = F.struct("event_type").alias("of")
    found = ranks.linear(rows, ["event_type"], "value", SHARES).drop("n").withColumn("of", of)
    sums = rows.groupBy(of).agg(F.count("*").alias("n"), F.round(F.max("value"), 6).alias("max"), F.round(F.avg("value"), 6).alias("mean"))
    return found.join(sums, "of").select("event_type", "n", *(F.round(c, 6).alias(c) for c in SHARES), "max", "mean")


def percentiles_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.nearest(table(spark, sf_dir, "events"), ["event_type"], "value", SHARES).drop("n")


def percentiles_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.percentiles_floor(table(spark, sf_dir, "events"), "event_type", "value", [0.5, 0.95, 0.99])


def worst_latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five slowest of each type, ties by id: a top-k report."""
    by = Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    return table(spark, sf_dir, "events").select("event_type", "event_id", "value", F.row_number().over(by).alias("rank")).filter("rank <= 5")


def paired_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two outcomes of the same items, compared within sources."""
    rows = labelled(spark, sf_dir).select("source", F.col("answerable").cast("int").alias("a"), F.col("correct").cast("int").alias("b"))
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg(F.col("a") - F.col("b")), 6).alias("diff"), F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("losses"), F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("gains"))


def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).select(F.col("source").alias("cluster"), F.col("answerable").cast("int").alias("a"), F.col("correct").cast("int").alias("b"))
    return E.bootstrap(rows)


GRID = [round(0.05 * k, 2) for k in range(21)]


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sweep(labelled(spark, sf_dir), GRID)


def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.best_threshold(E.sweep(labelled(spark, sf_dir), GRID))


FLAGS = {"NOT answerable AND score < 0.5": "first_stage", "score < 0.6": "wrong_document", "NOT correct": "sentence_selection", "NOT answerable": "refusal"}


def error_cause(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("doc_id", E.cause(FLAGS).alias("cause")).filter("cause IS NOT NULL")


def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = spark.createDataFrame(list(C.ERROR_CLASSES.items()), "cause string, class string")
    rows = error_cause(spark, sf_dir).join(F.broadcast(classes), "cause", "left")  # a fixed short list
    return rows.groupBy(F.coalesce("class", F.lit("K")).alias("class")).agg(F.count("*").alias("n"))


def answer_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classification by two thresholds as two runs; rows that differ or that one lacks."""
    rows = labelled(spark, sf_dir)
    a = rows.select("doc_id", (F.col("score") >= 0.6).alias("answer"))
    b = rows.filter("answerable").select("doc_id", (F.col("score") >= 0.8).alias("answer"))
    return E.answer_changes(a, b, ["doc_id"])


def word_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items against a degraded copy with words lost. Dynamic programming over words: checked in the tests."""
    from evidora.functions.wer import errors_udf

    rows = table(spark, sf_dir, "benchmark").select("item_id", T.tokens(F.col("text")).alias("said"))
    heard = rows.withColumn("heard", F.filter("said", lambda x, i: (i % 7 != 3)))
    scored = heard.select("item_id", errors_udf()("said", "heard").alias("e"), F.size("said").alias("n"))
    return scored.select("item_id", F.col("n").cast("long").alias("n_words"), F.get("e", F.lit(0)).alias("errors"), F.get("e", F.lit(1)).alias("content_errors"))


QUERIES = {f.__name__: f for f in (
    trace_turns, gate_early, gate_multi_intent, gate_grounding, gate_coverage, gate_lineage, suite_rollup, llm_cost, wilson_ci, abstention, claim_precision, percentiles_linear,
    percentiles_nearest, percentiles_floor, worst_latencies, paired_diff, paired_bootstrap, threshold_sweep, best_threshold, error_cause, taxonomy, answer_changes, word_error_rate,
)}

_TRACE = """t AS (SELECT CASE WHEN event_id % 5 = 0 THEN 'controller_decision' WHEN event_type = 'view' THEN 'chunk_received' WHEN event_type = 'click' THEN 'retrieval_started' WHEN event_type = 'purchase' THEN 'retrieval_completed'
  WHEN event_type = 'signup' THEN 'answer_version_created' WHEN event_type = 'error' THEN 'output_emitted' ELSE 'controller_decision' END AS event,
  CAST(epoch_us(ts) // 1000 AS DOUBLE) AS ts_ms, CAST(event_id AS DOUBLE) AS wall_ms, 's' || user_id AS session_id, CASE WHEN event_id % 7 <> 0 THEN 'u' || (epoch_us(ts) // 86400000000) END AS utterance_id, event_id % 3 = 0 AS is_final, 'r' || (event_id % 2) AS request_id FROM events),
ss AS (SELECT session_id, count(*) AS ns FROM t WHERE utterance_id IS NULL GROUP BY session_id),
tt AS (SELECT session_id, utterance_id, count(*) + coalesce(any_value(ns), 0) AS n, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, max(ts_ms) FILTER (event = 'chunk_received' AND is_final) AS end_ms,
  min(ts_ms) FILTER (event = 'retrieval_started') AS retrieval_ms, max(ts_ms) FILTER (event = 'retrieval_started') AS last_retrieval_ms, min(ts_ms) FILTER (event = 'answer_version_created') AS version_ms,
  arg_min(event, ts_ms * 1e7 + wall_ms) AS first_event, count(*) FILTER (event = 'chunk_received') AS nc, count(*) FILTER (event = 'controller_decision') AS nd, count(*) FILTER (event = 'answer_version_created') AS nv, count(*) FILTER (event = 'output_emitted') AS no
  FROM t LEFT JOIN ss USING (session_id) WHERE utterance_id IS NOT NULL GROUP BY session_id, utterance_id)"""
_L = f"l AS (SELECT doc_id, lang, source, quality = 1 AS answerable, toxic = 0 AS correct, round(CASE WHEN len(c) = 0 THEN 0.0 ELSE len(list_distinct(c)) / len(c) END, 6) AS score FROM (SELECT doc_id, lang, source, {S.content(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} AS c FROM documents) JOIN labels USING (doc_id))"
_CAUSE = f"{_L}, x AS (SELECT doc_id, CASE WHEN NOT answerable AND score < 0.5 THEN 'first_stage' WHEN score < 0.6 THEN 'wrong_document' WHEN NOT correct THEN 'sentence_selection' WHEN NOT answerable THEN 'refusal' END AS cause FROM l)"
_SWEEP = f"""{_L}, g AS (SELECT unnest({GRID}) AS threshold), s AS (SELECT CAST(threshold AS DOUBLE) AS threshold, count(*) FILTER (answerable) AS n_answerable, count(*) FILTER (NOT answerable) AS n_other,
  count(*) FILTER (answerable AND score >= threshold AND correct) AS "right", count(*) FILTER (answerable AND score >= threshold AND NOT correct) AS wrong, count(*) FILTER (NOT answerable AND score < threshold) AS refused FROM l, g GROUP BY threshold),
b AS (SELECT *, round(("right" / greatest(n_answerable, 1) + refused / greatest(n_other, 1)) / 2, 6) AS balanced FROM s)"""
_GOLD = """gd AS (SELECT session_id, utterance_id, h % 2 = 0 AS eligible, h % 3 = 0 AS retrieval_required, h % 4 AS n_gold FROM (SELECT DISTINCT session_id, utterance_id, CAST('0x' || substring(md5(session_id || utterance_id), 1, 6) AS BIGINT) AS h FROM t WHERE utterance_id IS NOT NULL)), gt AS (SELECT * FROM gd JOIN tt USING (session_id, utterance_id))"""
_A = "a AS (SELECT conv_id, turn, min(text) AS text FROM conversations WHERE role = 'assistant' GROUP BY ALL)"

ORACLES = {
    "gate_early": f"WITH {_TRACE}, {_GOLD}, x AS (SELECT count(*) FILTER (eligible) AS eligible, count(*) FILTER (eligible AND retrieval_ms < end_ms) AS early, count(*) FILTER (NOT eligible AND NOT retrieval_required) AS idle, count(*) FILTER (NOT eligible AND NOT retrieval_required AND retrieval_ms IS NOT NULL) AS false_triggers FROM gt) SELECT *, round(coalesce(early / nullif(eligible, 0), 1.0), 6) AS early_rate, round(coalesce(false_triggers / nullif(idle, 0), 0.0), 6) AS false_rate FROM x",
    "gate_multi_intent": f"WITH {_TRACE}, {_GOLD}, q AS (SELECT session_id, utterance_id, count(DISTINCT request_id) AS n FROM t WHERE event = 'retrieval_started' AND utterance_id IS NOT NULL GROUP BY ALL), x AS (SELECT count(*) AS compound, count(*) FILTER (n >= 2) AS split FROM gd LEFT JOIN q USING (session_id, utterance_id) WHERE n_gold >= 2) SELECT *, round(coalesce(split / nullif(compound, 0), 1.0), 6) AS split_rate FROM x",
    "suite_rollup": f"WITH {_TRACE}, {_GOLD}, x AS (SELECT CASE WHEN eligible THEN 'eligible' ELSE 'other' END AS class, coalesce(retrieval_ms < end_ms, false) AS early FROM gt), r AS (SELECT coalesce(class, 'all') AS class, count(*) AS n, count(*) FILTER (early) AS early FROM x GROUP BY ROLLUP (class)) SELECT class, n, early, round(early / n, 6) AS rate, early / n >= 0.8 AS passed FROM r",
    "trace_turns": f"WITH {_TRACE} SELECT session_id, utterance_id, n, first_ms, last_ms, end_ms, retrieval_ms, first_event FROM tt",
    "gate_grounding": "SELECT CAST(sum(event_id % 4) AS BIGINT) AS n_claims, CAST(sum(least(event_id % 4, user_id % 4)) AS BIGINT) AS n_supported, count(*) FILTER (event_id % 97 = 0) AS n_fabricated, round(sum(least(event_id % 4, user_id % 4)) / sum(event_id % 4), 6) AS support_rate, sum(least(event_id % 4, user_id % 4)) / sum(event_id % 4) >= 0.85 AND count(*) FILTER (event_id % 97 = 0) = 0 AS passed FROM events",
    "gate_coverage": f"""WITH {_TRACE}, st AS (SELECT session_id, utterance_id, request_id, max(ts_ms) AS f FROM t WHERE event = 'retrieval_started' AND utterance_id IS NOT NULL GROUP BY ALL),
dn AS (SELECT session_id, utterance_id, request_id, max(ts_ms) AS e FROM t WHERE event = 'retrieval_completed' AND utterance_id IS NOT NULL GROUP BY ALL), pr AS (SELECT * FROM dn LEFT JOIN st USING (session_id, utterance_id, request_id))
SELECT session_id, utterance_id, 'no chunk' AS problem FROM tt WHERE nc = 0 UNION ALL SELECT session_id, utterance_id, 'no decision' FROM tt WHERE nd = 0
UNION ALL SELECT session_id, utterance_id, 'completed without start' FROM pr WHERE f IS NULL UNION ALL SELECT session_id, utterance_id, 'completed before start' FROM pr WHERE e < f
UNION ALL SELECT session_id, utterance_id, 'answer before retrieval' FROM tt WHERE last_retrieval_ms > version_ms UNION ALL SELECT session_id, utterance_id, 'answer without output' FROM tt WHERE nv > 0 AND no = 0""",
    "gate_lineage": f"""WITH {_A}, v AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS version, turn % 3 = 0 AS refines, list_distinct(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: length(x) % 3)) AS c FROM a)
SELECT count(*) AS refinements, count(*) FILTER (p.version IS NOT NULL AND len(list_filter(p.c, lambda x: NOT list_contains(v.c, x))) = 0) AS continuous FROM v LEFT JOIN v p ON p.conv_id = v.conv_id AND p.version = v.version - 1 WHERE v.refines""",
    "llm_cost": """WITH c AS (SELECT conv_id, role, greatest(1, length(coalesce(text, '')) // 4) AS i, turn * 10 AS o FROM conversations)
SELECT conv_id, count(*) AS n_calls, CAST(sum(i) AS BIGINT) AS tokens_in, round(sum(i / 1000 * CASE role WHEN 'user' THEN 0.5 WHEN 'assistant' THEN 1.0 ELSE 0 END + o / 1000 * CASE role WHEN 'user' THEN 1.5 WHEN 'assistant' THEN 2.0 ELSE 0 END), 6) AS cost_usd FROM c GROUP BY conv_id""",
    "wilson_ci": f"WITH {_L}, w AS (SELECT lang, count(*) FILTER (answerable) AS k, count(*) AS n FROM l GROUP BY lang), p AS (SELECT *, (k / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) AS c, 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4.0 * n * n)) / (1 + 1.96 * 1.96 / n) AS h FROM w) SELECT lang, k, n, round(greatest(0, c - h), 6) AS low, round(least(1, c + h), 6) AS high FROM p",
    "abstention": f"WITH {_L} SELECT lang, count(*) AS n, count(*) FILTER (score < 0.5) AS abstained FROM l WHERE NOT answerable GROUP BY lang",
    "claim_precision": f"""WITH {_A}, v AS (SELECT conv_id AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS version, unnest(list_distinct(string_split(coalesce(text, ''), chr(10)))) AS text FROM a)
SELECT session_id, count(*) AS n_claims, count(*) FILTER (length(text) % 2 = 0) AS n_correct, round(avg(len(regexp_split_to_array(trim(text), '\\s+'))), 6) AS words FROM v WHERE NOT EXISTS (SELECT 1 FROM v p WHERE p.session_id = v.session_id AND p.version = v.version - 1 AND p.text = v.text) GROUP BY session_id""",
    "percentiles_linear": "SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(max(value), 6) AS max, round(avg(value), 6) AS mean FROM events GROUP BY event_type",
    "percentiles_nearest": "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type",
    "percentiles_floor": "WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY event_type), q AS (SELECT *, unnest([0.5, 0.95, 0.99]) AS q FROM s) SELECT event_type, CAST(q AS DOUBLE) AS q, v[1 + CAST(least(floor(q * len(v)), len(v) - 1) AS BIGINT)] AS value FROM q",
    "worst_latencies": "SELECT event_type, event_id, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 5",
    "paired_diff": f"WITH {_L}, x AS (SELECT source, CAST(answerable AS INT) AS a, CAST(correct AS INT) AS b FROM l) SELECT source, count(*) AS n, round(avg(a - b), 6) AS diff, count(*) FILTER (a = 1 AND b = 0) AS losses, count(*) FILTER (a = 0 AND b = 1) AS gains FROM x GROUP BY source",
    "threshold_sweep": f"WITH {_SWEEP} SELECT * FROM b",
    "best_threshold": f"WITH {_SWEEP} SELECT threshold, balanced FROM b ORDER BY balanced DESC, threshold LIMIT 1",
    "error_cause": f"WITH {_CAUSE} SELECT doc_id, cause FROM x WHERE cause IS NOT NULL",
    "taxonomy": f"WITH {_CAUSE}, {S.values('c', 'cause, class', list(C.ERROR_CLASSES.items()))} SELECT coalesce(class, 'K') AS class, count(*) AS n FROM x LEFT JOIN c USING (cause) WHERE cause IS NOT NULL GROUP BY 1",
    "answer_changes": f"WITH {_L}, a AS (SELECT doc_id, score >= 0.6 AS a FROM l), b AS (SELECT doc_id, score >= 0.8 AS b FROM l WHERE answerable) SELECT doc_id, a, b FROM a FULL JOIN b USING (doc_id) WHERE a IS DISTINCT FROM b",
}
