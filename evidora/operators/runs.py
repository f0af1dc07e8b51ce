"""Runs against gold rows: outcomes of questions and splits, what each stage allows, causes of wrong claims, failures by bucket,
repeats, pooled sets, latency by stage. Equi-joins and grouped aggregates; a window holds the stages of one turn at most, or runs
of one scenario.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidora.config import FEATURE_DEFAULTS, FEATURES, TURN_MARKS
from evidora.functions import text as T
from evidora.operators import claims as claims_
from evidora.operators import ranks
from evidora.operators.evaluate import TURN, percentiles_floor, rate

LIKE = 0.5


def _likeness(a: str, b: str) -> Column:
    return F.coalesce(T.jaccard(T.content_set(F.col(a)), T.content_set(F.col(b))), F.lit(0.0))


def question_outcomes(gold: DataFrame, results: DataFrame) -> DataFrame:
    """(TURN, at, answered, cited) of gold questions (TURN, at, kind, answers, relevant, title) of new requests and refinements that have
    answers; results (TURN, answer, citations), a row a turn. Where the title gives all answers away, citing counts as answering. A turn
    without a result has neither."""
    rows = gold.filter(F.col("kind").isin("new_request", "refinement") & (F.size("answers") > 0)).join(results, TURN, "left")
    cited = F.coalesce(F.arrays_overlap("relevant", "citations"), F.lit(False))
    marked = rows.withColumns({"cited": cited, "good": T.informative(F.col("answers"), F.coalesce("title", F.lit("")))})
    answered = F.when(F.size("good") > 0, T.has_answer(F.coalesce("answer", F.lit("")), F.col("good"))).otherwise(F.col("cited"))
    return marked.select(*TURN, "at", answered.alias("answered"), "cited")


def live_counts(trace: DataFrame) -> DataFrame:
    """(TURN, n_live): query ids that a turn emitted and never cancelled; trace (TURN, event, query_ids). Turns without any have 0."""
    rows = trace.filter("utterance_id IS NOT NULL").select(*TURN, "event", F.explode_outer("query_ids").alias("query_id"))
    ids = rows.groupBy(*TURN, "query_id").agg(F.bool_or(F.col("event") == "sub_queries_emitted").alias("emitted"), F.bool_or(F.col("event") == "retrieval_cancelled").alias("cancelled"))
    return ids.groupBy(*TURN).agg(F.count_if(F.col("query_id").isNotNull() & F.col("emitted") & ~F.col("cancelled")).alias("n_live"))


def split_outcomes(gold: DataFrame, live: DataFrame) -> DataFrame:
    """Compound requests split into just as many queries as gold has, single ones split at all; gold (TURN, kind, n_gold)."""
    rows = gold.filter("kind = 'new_request' AND n_gold > 0").join(live, TURN)
    several = F.col("n_gold") >= 2
    counts = rows.agg(
        F.count_if(several).alias("n_compound"), F.count_if(several & (F.col("n_live") == F.col("n_gold"))).alias("n_exact"),
        F.count_if(~several).alias("n_single"), F.count_if(~several & (F.col("n_live") > 1)).alias("n_over"),
    )
    return counts.withColumns({"exact_rate": F.round(rate(F.col("n_exact"), F.col("n_compound")), 6), "over_rate": F.round(rate(F.col("n_over"), F.col("n_single"), 0.0), 6)})


def stage_ceilings(questions: DataFrame, queries: DataFrame, evidence: DataFrame, like: float = LIKE) -> DataFrame:
    """(question_id, isolated, gold_in_evidence, answer_in_top3): how far a perfect later stage could get. questions (question_id, turn_id,
    question, relevant, answers); queries (turn_id, query_id, text); evidence (query_id, rank, citation, text), ranks from 1. A question
    is isolated if some query of its turn is like it; the most alike counts, the least id of equals. Without answers the
    relevant citations stand for them."""
    near = questions.join(queries, "turn_id", "left").withColumn("like", _likeness("question", "text"))
    best = near.groupBy("question_id").agg(F.min_by(F.struct("query_id", "like"), F.struct(-F.col("like"), "query_id")).alias("b"))
    isolated = best.filter(F.col("b.like") >= like).select("question_id", F.col("b.query_id").alias("query_id"))
    rows = isolated.join(evidence, "query_id", "left").join(questions.select("question_id", "relevant", "answers"), "question_id")
    hit = F.coalesce(F.array_contains("relevant", F.col("citation")), F.lit(False))
    said = F.coalesce(F.exists(T.sentences(F.col("text")), lambda s: T.has_answer(s, F.col("answers"))), F.lit(False))
    top = F.coalesce(F.col("rank") <= 3, F.lit(False)) & F.when(F.size("answers") > 0, said).otherwise(hit)
    found = rows.groupBy("question_id").agg(F.lit(True).alias("isolated"), F.bool_or(hit).alias("gold_in_evidence"), F.bool_or(top).alias("answer_in_top3"))
    return questions.select("question_id").join(found, "question_id", "left").na.fill(False)


def claim_causes(claims: DataFrame, gold: DataFrame, like: float = LIKE) -> DataFrame:
    """(turn_id, claim_id, cause) of wrong claims: those that cite nothing relevant and hold no answer. claims (turn_id, claim_id, text,
    citations, source), source the sub-query that a claim answers, or null; gold (turn_id, question, relevant, answers, unanswerable)."""
    right = F.coalesce(F.arrays_overlap("citations", "relevant"), F.lit(False)) | F.coalesce(T.has_answer(F.col("text"), F.col("answers")), F.lit(False))
    rows = claims.join(gold, "turn_id", "left").withColumns({"right": right, "like": _likeness("question", "source")})
    each = rows.groupBy("turn_id", "claim_id").agg(F.bool_or("right").alias("right"), F.max("like").alias("like"), F.bool_or(F.coalesce("unanswerable", F.lit(False))).alias("unanswerable"))
    cause = F.when(F.col("unanswerable"), "answered_unanswerable").when(F.col("like") < like, "spurious_subquery").otherwise("wrong_passage")
    return each.filter(~F.col("right")).select("turn_id", "claim_id", cause.alias("cause"))


def retrieval_failures(pairs: DataFrame, evidence: DataFrame) -> DataFrame:
    """(query_id, bucket) of gold pairs (query_id, gold_doc) that give no claim: A where no evidence is of the document, B where the best
    sentence of its first chunk fails the relevance gate. What passes is verbatim evidence and so supported."""
    own = evidence.withColumn("doc", T.citation_doc(F.col("citation"))).join(pairs.withColumnRenamed("gold_doc", "doc"), ["query_id", "doc"])
    first = own.groupBy("query_id").agg(F.min("rank").alias("rank"))
    best = claims_.best_sentences(evidence).select("query_id", "rank", claims_.relevant(F.col("own"), T.content_set(F.col("sentence"))).alias("passes"))
    rows = pairs.join(first, "query_id", "left").join(best, ["query_id", "rank"], "left")
    bucket = F.when(F.col("rank").isNull(), "A").when(~F.coalesce("passes", F.lit(False)), "B")
    return rows.select("query_id", bucket.alias("bucket")).filter("bucket IS NOT NULL")


def late_turns(turns: DataFrame, gold: DataFrame) -> DataFrame:
    """(TURN, bucket C) of turns that could have searched early and didn't start before their end; gold (TURN, eligible)."""
    rows = turns.join(gold.filter("eligible"), TURN).filter("end_ms IS NOT NULL AND (retrieval_ms IS NULL OR retrieval_ms >= end_ms)")
    return rows.select(*TURN, F.lit("C").alias("bucket"))


def median_runs(events: DataFrame, scenario: str, run: str) -> DataFrame:
    """(scenario, run, n): the repeat of each scenario whose trace has the middle length, the upper of two; equal lengths by run."""
    sizes = events.groupBy(scenario, run).agg(F.count("*").alias("n"))
    of = Window.partitionBy(scenario)
    placed = sizes.withColumns({"place": F.row_number().over(of.orderBy("n", run)), "runs": F.count("*").over(of)})
    return placed.filter("place = runs DIV 2 + 1").select(scenario, run, "n")


def pooled(a: DataFrame, b: DataFrame) -> DataFrame:
    """Items (set, scenario, item, metric, value) of two runs over several sets, paired: (metric, cluster, a, b). Scenarios of one name in
    two sets are two clusters, as ``evaluate.bootstrap`` needs them."""
    keys = ["set", "scenario", "item", "metric"]
    rows = a.select(*keys, F.col("value").alias("a")).join(b.select(*keys, F.col("value").alias("b")), keys)
    return rows.select("metric", F.concat_ws(":", "set", "scenario").alias("cluster"), "a", "b")


def pooled_means(pairs: DataFrame) -> DataFrame:
    counts = [F.count("*").alias("n_paired"), F.countDistinct("cluster").alias("n_clusters")]
    return pairs.groupBy("metric").agg(*counts, *(F.round(F.avg(x), 6).alias(n) for x, n in ((F.col("a"), "baseline"), (F.col("b"), "candidate"), (F.col("b") - F.col("a"), "diff"))))


def stage_timings(marks: DataFrame) -> DataFrame:
    """(TURN, stage, ms) of marks (TURN, mark, ms): from each mark of TURN_MARKS that a turn has to the next it has, and post_speech from
    the first to the output. Turns without their end have none; of a repeated mark the last counts."""
    place = F.array_position(F.array(*map(F.lit, TURN_MARKS)), F.col("mark"))
    known = marks.filter("utterance_id IS NOT NULL").groupBy(*TURN, "mark", place.alias("place")).agg(F.max("ms").alias("ms")).filter("place > 0")
    of = Window.partitionBy(*TURN)
    ended = known.withColumns({"end": F.max(F.when(F.col("place") == 1, F.col("ms"))).over(of), "before": F.lag("ms").over(of.orderBy("place"))}).filter("end IS NOT NULL")
    last = F.col("place") == len(TURN_MARKS)
    rows = ended.select(*TURN, F.when(last, "post_speech").otherwise(F.col("mark")).alias("stage"), F.round(F.col("ms") - F.when(last, F.col("end")).otherwise(F.col("before")), 3).alias("ms"))
    return rows.filter("ms IS NOT NULL")


def stage_summary(samples: DataFrame) -> DataFrame:
    """(stage, n, p50, p95, p99, max, mean) of samples (stage, ms)."""
    shares = ranks.linear(samples, ["stage"], "ms", {f"p{int(100 * q)}": q for q in (0.5, 0.95, 0.99)})
    sums = samples.groupBy(F.struct("stage").alias("_g")).agg(F.max("ms").alias("max"), F.avg("ms").alias("mean"))
    made = shares.withColumn("_g", F.struct("stage")).join(sums, "_g")
    return made.select("stage", "n", *(F.round(c, 3).alias(c) for c in ("p50", "p95", "p99", "max", "mean")))


def slow_outputs(timings: DataFrame, limit: float = 5.0) -> DataFrame:
    """Turns that took longer than ``limit`` ms after speech, with the stage that took most of it."""
    stages = timings.filter("stage <> 'post_speech'").groupBy(*TURN).agg(F.max_by(F.struct("stage", "ms"), F.struct("ms", "stage")).alias("s"))
    rows = timings.filter((F.col("stage") == "post_speech") & (F.col("ms") > limit)).select(*TURN, F.col("ms").alias("post_speech"))
    return rows.join(stages, TURN, "left").select(*TURN, "post_speech", F.col("s.stage").alias("stage"), F.col("s.ms").alias("ms"))


def sink_overhead(samples: DataFrame, base: str) -> DataFrame:
    """(sink, p50, p95, p50_pct, p95_pct) of latencies (sink, ms): how much each sink adds to the one called ``base``, in percent."""
    each = percentiles_floor(samples, "sink", "ms", [0.5, 0.95], of_last=True)
    rows = each.groupBy("sink").agg(F.max(F.when(F.col("q") == 0.5, F.col("value"))).alias("p50"), F.max(F.when(F.col("q") == 0.95, F.col("value"))).alias("p95"))
    without = rows.filter(F.col("sink") == base).select(F.col("p50").alias("b50"), F.col("p95").alias("b95"))  # one row
    added = lambda x, b: F.round(100 * (F.col(x) - F.col(b)) / F.nullif(F.col(b), F.lit(0.0)), 1)
    return rows.crossJoin(F.broadcast(without)).select("sink", "p50", "p95", added("p50", "b50").alias("p50_pct"), added("p95", "b95").alias("p95_pct"))


def gate_features(subs: DataFrame) -> DataFrame:
    """(item_id, FEATURES) of an item's best sub-query: the highest ``top`` of those with a reader's claim, else of those with a scorer's
    claim, the first (``at``) of equals. agree: the reader's span lies in the scorer's claim. Missing values get defaults; items
    without a claim have no row. subs (item_id, at, rd_claim, ce_claim, reader_span, features but agree)."""
    has = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    span, claim = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in ("reader_span", "ce_claim"))
    agree = ((span != "") & F.contains(claim, span)).cast("double")
    rows = subs.filter(has("rd_claim") | has("ce_claim")).withColumn("agree", agree)
    values = F.struct(*(F.col(f).cast("double").alias(f) for f in FEATURES))
    best = rows.groupBy("item_id").agg(F.max_by(values, F.struct(has("rd_claim"), "top", -F.col("at"))).alias("f"))
    return best.select("item_id", *(F.coalesce(F.col("f")[f], F.lit(FEATURE_DEFAULTS.get(f, 0.0))).alias(f) for f in FEATURES))


def edge_cases(checks: DataFrame, errors: DataFrame, turns: DataFrame) -> DataFrame:
    """(item, gate, issue, detail): fabricated citations of checks (item, fabricated), errors (item, error_type, message), and doubts of turns
    (item, uncertainty, reason) that didn't merely fail."""
    made_up = checks.filter(F.size("fabricated") > 0).select("item", F.lit("grounding").alias("gate"), F.lit("fabricated citations").alias("issue"), F.array_join("fabricated", "|").alias("detail"))
    failed = errors.select("item", F.lit("robustness").alias("gate"), F.col("error_type").alias("issue"), F.col("message").alias("detail"))
    doubt = turns.filter((F.coalesce("uncertainty", F.lit("")) != "") & ~F.col("reason").eqNullSafe("degraded"))
    return made_up.union(failed).union(doubt.select("item", F.lit("grounding").alias("gate"), F.lit("uncertainty flagged").alias("issue"), F.col("uncertainty").alias("detail")))
