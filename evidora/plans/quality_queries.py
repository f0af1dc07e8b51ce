"""Queries on the quality of runs: labelled documents stand in for scored questions, conversations for sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidora import config as C
from evidora.functions import text as T
from evidora.operators import evaluate as E
from evidora.operators import quality as Q
from evidora.plans import evaluation_queries as base
from evidora.plans import sql as S
from evidora.session import table

CASES = [(0.2, 1.0), (0.5, 1.0), (0.5, 2.0)]
EVENTS = ("chunk_received", "retrieval_started", "retrieval_completed", "controller_decision", "output_emitted")
TURN_EVENTS = ("controller_decision", "output_emitted")


def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.labelled(spark, sf_dir).groupBy("lang").agg(*Q.classification(F.col("score") >= 0.6, F.col("answerable")))


def f1_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.f1_grid(base.labelled(spark, sf_dir).select("score", F.col("answerable").alias("label")), base.GRID)


def auc_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.auc(base.labelled(spark, sf_dir).select("score", F.col("answerable").alias("label")))


def refusal_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.policies(E.sweep(base.labelled(spark, sf_dir), base.GRID), CASES)


def paired_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as modes, users as scenarios, days as turns."""
    rows = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), F.col("event_type").alias("mode"), F.col("value").alias("ms"))
    return Q.paired_latency(rows, ["user_id", "day"], "view", "click")


def paired_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.labelled(spark, sf_dir)
    return Q.paired_outcomes(rows.select("doc_id", F.col("answerable").alias("right")), rows.filter("score < 0.9").select("doc_id", (F.col("score") >= 0.6).alias("right")), ["doc_id"])


def run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages as metrics, sources as scenarios, ids by ten as turns."""
    rows = base.labelled(spark, sf_dir).select(F.col("lang").alias("metric"), F.col("source").alias("scenario"), F.floor(F.col("doc_id") / 10).alias("turn"), "answerable", "correct", "score")
    return Q.compared(rows.withColumn("value", F.col("answerable").cast("double")), rows.filter("score < 0.9").withColumn("value", F.col("correct").cast("double")))


def stage_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = spark.createDataFrame(list(C.ERROR_CLASSES.items()), "cause string, class string")
    rows = base.labelled(spark, sf_dir).select(E.cause(base.FLAGS).alias("cause")).join(F.broadcast(classes), "cause", "left")  # a fixed short list
    return Q.stage_bounds(rows.select(F.col("cause").isNull().alias("right"), F.coalesce("class", F.lit("K")).alias("class")))


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as chunks; a conversation's intents are the lines of its last turn."""
    c = table(spark, sf_dir, "conversations").filter("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq")).agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))
    last = c.groupBy("session_id").agg(F.max_by("text", "seq").alias("text"))
    return Q.ready_rows(c, last.select("session_id", F.explode(F.split("text", "\n")).alias("intent")))


def log_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.log_problems(base.trace(spark, sf_dir), EVENTS, TURN_EVENTS)


def gate_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A logistic gate fitted on four fifths of the labelled documents, its area on the rest. Iterative: no SQL."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = T.content(F.col("text"))
    rows = d.join(table(spark, sf_dir, "labels").filter("doc_id IS NOT NULL"), "doc_id").select(
        "doc_id", (F.col("quality") == 1).alias("label"), T.ratio(F.size(F.array_distinct(own)), F.size(own)).alias("distinct_share"), T.factual_density(F.col("text")).alias("density"),
        F.log1p(F.size(own)).alias("log_words"), T.ratio(F.length(F.regexp_replace("text", "[a-zA-Z ]", "")), F.length("text")).alias("other_share"),
    )
    _, _, probability = Q.fit_gate(rows.filter("doc_id % 5 <> 0"), ["distinct_share", "density", "log_words", "other_share"], "label")
    return Q.auc(rows.filter("doc_id % 5 = 0").select(F.round(probability(), 4).alias("score"), "label")).select("n_true", "n_false", F.round("auc", 3).alias("auc"))


def overlap(pairs: DataFrame) -> DataFrame:
    """A scorer without a model: how much of the context's words the claim has, and whether the two disagree on having numbers."""
    a, b = T.content_set(F.col("claim")), T.content_set(F.col("context"))
    return pairs.withColumns({"entail": F.round(T.coverage(b, a), 6), "contra": (F.col("claim").rlike("[0-9]") != F.col("context").rlike("[0-9]")).cast("double")})


def feature_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies' first and last lines as two claims on the turn before; every third conversation has one feature from an earlier run."""
    c = table(spark, sf_dir, "conversations").filter("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.min("role").alias("role"), F.min("text").alias("text"))
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    replies = c.withColumn("asked", before).filter("role = 'assistant'")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    rows = replies.select("conv_id", "turn", "asked", lines[0].alias("rd_claim"), F.element_at(lines, -1).alias("ce_claim"), F.when(F.col("conv_id") % 3 == 0, 0.5).alias("entail_rd"))
    made = Q.back_filled(rows, {"rd": ("rd_claim", "asked"), "ce": ("ce_claim", "asked")}, overlap, ["entail", "contra"])
    return made.select("conv_id", "turn", "entail_rd", "contra_rd", "entail_ce", "contra_ce")


QUERIES = {f.__name__: f for f in (
    classification_report, f1_grid, auc_by_rank, refusal_policy, paired_latency, paired_outcomes, run_comparison, stage_bounds, training_rows, log_problems, gate_fit, feature_backfill,
)}


def _report(predicted: str) -> str:
    tp, fp, fn = (f"count(*) FILTER ({x})" for x in (f"{predicted} AND answerable", f"{predicted} AND NOT answerable", f"NOT ({predicted}) AND answerable"))
    part = lambda a, b: f"round(CASE WHEN {b} = 0 THEN 0.0 ELSE ({a}) / ({b}) END, 6)"
    return f"count(*) AS n, {part(f'count(*) FILTER (({predicted}) = answerable)', 'count(*)')} AS accuracy, {part(tp, f'({tp} + {fp})')} AS precision, {part(tp, f'({tp} + {fn})')} AS recall, {part(f'2 * {tp}', f'(2 * {tp} + {fp} + {fn})')} AS f1, {fp} AS premature, {fn} AS missed"


_L, _SWEEP, _CAUSE, _TRACE = base._L, base._SWEEP, base._CAUSE, base._TRACE
_POLICY = ", ".join(f"({p}, {c})" for p, c in CASES)

ORACLES = {
    "classification_report": f"WITH {_L} SELECT lang, {_report('score >= 0.6')} FROM l GROUP BY lang",
    "f1_grid": f"WITH {_L}, g AS (SELECT CAST(unnest({base.GRID}) AS DOUBLE) AS threshold) SELECT threshold, {_report('score >= threshold')} FROM l, g GROUP BY threshold",
    "auc_by_rank": f"""WITH {_L} SELECT (SELECT count(*) FROM l WHERE answerable) AS n_true, (SELECT count(*) FROM l WHERE NOT answerable) AS n_false,
  (SELECT round(avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END), 6) FROM l a, l b WHERE a.answerable AND NOT b.answerable) AS auc""",
    "refusal_policy": f"""WITH {_SWEEP}, c(p, price) AS (VALUES {_POLICY}),
r AS (SELECT threshold, "right" / n_answerable AS r, wrong / n_answerable AS w, (n_other - refused) / n_other AS a FROM b),
u AS (SELECT CAST(p AS DOUBLE) AS p_unanswerable, CAST(price AS DOUBLE) AS price, threshold, round((1 - CAST(p AS DOUBLE)) * (r - CAST(price AS DOUBLE) * w) - CAST(p AS DOUBLE) * CAST(price AS DOUBLE) * a, 6) AS utility, r, w, a FROM r, c)
SELECT p_unanswerable, price, threshold, utility, round(r, 6) AS "right", round(w, 6) AS wrong, round(a, 6) AS asserted FROM u QUALIFY row_number() OVER (PARTITION BY p_unanswerable, price ORDER BY utility DESC, threshold) = 1""",
    "paired_latency": """WITH x AS (SELECT user_id, CAST(ts AS DATE) AS day, min(value) FILTER (event_type = 'view') AS a, min(value) FILTER (event_type = 'click') AS b FROM events GROUP BY ALL),
y AS (SELECT count(*) AS n, round(quantile_cont(a, 0.5), 6) AS base_p50, round(quantile_cont(a, 0.95), 6) AS base_p95, round(quantile_cont(b, 0.5), 6) AS other_p50, round(quantile_cont(b, 0.95), 6) AS other_p95 FROM x WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT *, round(base_p50 / other_p50, 6) AS speed_up FROM y""",
    "paired_outcomes": f"""WITH {_L}, x AS (SELECT count(*) AS n, count(*) FILTER (answerable) AS first_right, count(*) FILTER (score >= 0.6) AS second_right, count(*) FILTER (answerable AND score < 0.6) AS lost,
  count(*) FILTER (NOT answerable AND score >= 0.6) AS gained FROM l WHERE score < 0.9) SELECT *, round((lost - gained) / greatest(n, 1), 6) AS points FROM x""",
    "run_comparison": f"""WITH {_L}, a AS (SELECT lang, source, doc_id // 10 AS t, avg(CAST(answerable AS INT)) AS a FROM l GROUP BY ALL), b AS (SELECT lang, source, doc_id // 10 AS t, avg(CAST(correct AS INT)) AS b FROM l WHERE score < 0.9 GROUP BY ALL)
SELECT lang AS metric, count(*) AS n_paired, round(avg(a), 6) AS baseline, round(avg(b), 6) AS candidate, round(avg(b - a), 6) AS diff FROM a JOIN b USING (lang, source, t) GROUP BY lang""",
    "stage_bounds": f"""WITH {_CAUSE}, {S.values('c', 'cause, class', list(C.ERROR_CLASSES.items()))}, y AS (SELECT x.cause, coalesce(class, 'K') AS class FROM x LEFT JOIN c USING (cause))
SELECT class, count(*) AS n, round(count(*) / (SELECT count(*) FROM y), 6) AS gain, round((count(*) + (SELECT count(*) FROM y WHERE cause IS NULL)) / (SELECT count(*) FROM y), 6) AS bound FROM y WHERE cause IS NOT NULL GROUP BY class""",
    "training_rows": f"""WITH c AS (SELECT conv_id AS session_id, turn AS seq, coalesce(min(text), '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
i AS (SELECT DISTINCT session_id, intent, list_distinct({S.content('intent')}) AS own FROM (SELECT session_id, unnest(string_split(arg_max(text, seq), chr(10))) AS intent FROM c GROUP BY session_id)),
r AS (SELECT a.session_id, a.seq, list_distinct({S.content("string_agg(b.text, ' ')")}) AS heard FROM c a JOIN c b ON a.session_id = b.session_id AND b.seq <= a.seq GROUP BY ALL)
SELECT r.session_id, r.seq, bool_or(len(list_intersect(own, heard)) / len(own) >= 0.7) AS ready FROM r JOIN i ON r.session_id = i.session_id AND len(own) > 0 GROUP BY ALL""",
    "log_problems": f"""WITH {_TRACE} SELECT event, problem, count(*) AS n FROM (SELECT event, unnest(list_filter([CASE WHEN event IS NULL THEN 'no event' END, CASE WHEN event NOT IN {EVENTS} THEN 'unknown event' END, CASE WHEN ts_ms IS NULL THEN 'no time' END,
  CASE WHEN session_id IS NULL THEN 'no session' END, CASE WHEN event IN {TURN_EVENTS} AND utterance_id IS NULL THEN 'no utterance' END], lambda x: x IS NOT NULL)) AS problem FROM t) GROUP BY event, problem""",
    "feature_backfill": f"""WITH c AS (SELECT conv_id, turn, min(role) AS role, min(text) AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY 1, 2),
b AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS asked FROM c),
r AS (SELECT *, string_split(coalesce(text, ''), chr(10)) AS l FROM b WHERE role = 'assistant'),
x AS (SELECT conv_id, turn, asked, l[1] AS a, l[-1] AS z FROM r),
s AS (SELECT *, list_distinct({S.content('a')}) AS wa, list_distinct({S.content('z')}) AS wz, list_distinct({S.content('asked')}) AS w FROM x)
SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN 0.5 WHEN trim(a) <> '' AND asked IS NOT NULL THEN round({S.coverage('w', 'wa')}, 6) END AS entail_rd,
CASE WHEN trim(a) <> '' AND asked IS NOT NULL THEN CAST(regexp_matches(a, '[0-9]') <> regexp_matches(asked, '[0-9]') AS INT) END AS contra_rd,
CASE WHEN trim(z) <> '' AND asked IS NOT NULL THEN round({S.coverage('w', 'wz')}, 6) END AS entail_ce,
CASE WHEN trim(z) <> '' AND asked IS NOT NULL THEN CAST(regexp_matches(z, '[0-9]') <> regexp_matches(asked, '[0-9]') AS INT) END AS contra_ce FROM s""",
}
