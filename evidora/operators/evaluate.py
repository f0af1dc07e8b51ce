"""Evaluation over event logs: turns, gates, answer quality, paired statistics.

A trace is a long table of events; every key starts with the run's scenario, as session ids are used again
across scenarios. All is grouped aggregation; turns are never gathered into arrays.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidora.operators import ranks

TURN = ["session_id", "utterance_id"]
GATES = {"early": (0.80, 1.0), "false_trigger": (0.10, 0.0), "multi_intent": (0.70, 1.0), "grounding": (0.85, 1.0), "lineage": (1.0, 1.0), "coverage": (1.0, 1.0)}


def when_event(name: str, value: Column) -> Column:
    return F.when(F.col("event") == name, value)


def turns(trace: DataFrame) -> DataFrame:
    """One row per turn; events of the session as a whole count in each of its turns."""
    own = trace.filter("utterance_id IS NOT NULL")
    shared = trace.filter("utterance_id IS NULL AND session_id IS NOT NULL").groupBy("session_id").agg(F.count("*").alias("n_session"))
    made = own.groupBy(*TURN).agg(
        F.count("*").alias("n"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"),
        F.max(when_event("chunk_received", F.when(F.col("is_final"), F.col("ts_ms")))).alias("end_ms"),
        F.min(when_event("retrieval_started", F.col("ts_ms"))).alias("retrieval_ms"),
        F.max(when_event("retrieval_started", F.col("ts_ms"))).alias("last_retrieval_ms"),
        F.min(when_event("answer_version_created", F.col("ts_ms"))).alias("version_ms"),
        F.min_by("event", F.struct("ts_ms", "wall_ms")).alias("first_event"),
        *(F.count_if(F.col("event") == e).alias(f"n_{e}") for e in ("chunk_received", "controller_decision", "answer_version_created", "output_emitted")),
    )
    return made.join(shared, "session_id", "left").withColumn("n", F.col("n") + F.coalesce("n_session", F.lit(0))).drop("n_session")


def rate(k: Column, n: Column, default: float = 1.0) -> Column:
    return F.coalesce(k / F.nullif(n.cast("double"), F.lit(0.0)), F.lit(default))


def gate_early(turns_: DataFrame, gold: DataFrame) -> DataFrame:
    """gold: (session_id, utterance_id, eligible, retrieval_required). False triggers count where no search was due and
    the turn isn't eligible."""
    rows = gold.join(turns_, TURN)
    early = F.col("eligible") & (F.col("retrieval_ms") < F.col("end_ms"))
    idle = ~F.col("eligible") & ~F.col("retrieval_required")
    return rows.agg(
        F.count_if(F.col("eligible")).alias("eligible"), F.count_if(early).alias("early"), F.count_if(idle).alias("idle"),
        F.count_if(idle & F.col("retrieval_ms").isNotNull()).alias("false_triggers"),
    ).withColumns({"early_rate": F.round(rate(F.col("early"), F.col("eligible")), 6), "false_rate": F.round(rate(F.col("false_triggers"), F.col("idle"), 0.0), 6)})


def gate_multi_intent(queries: DataFrame, gold: DataFrame) -> DataFrame:
    """queries: (session_id, utterance_id, query_id) as emitted; gold: (.., n_gold). Compound turns need two different ids."""
    emitted = queries.groupBy(*TURN).agg(F.countDistinct("query_id").alias("n"))
    rows = gold.filter("n_gold >= 2").join(emitted, TURN, "left")
    return rows.agg(F.count("*").alias("compound"), F.count_if(F.col("n") >= 2).alias("split")).withColumn("split_rate", F.round(rate(F.col("split"), F.col("compound")), 6))


def gate_grounding(checks: DataFrame) -> DataFrame:
    """checks: (n_claims, n_supported, n_fabricated)."""
    sums = checks.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("n_claims", "n_supported", "n_fabricated")))
    return sums.withColumn("support_rate", F.round(rate(F.col("n_supported"), F.col("n_claims")), 6)).withColumn("passed", (F.col("support_rate") >= 0.85) & (F.col("n_fabricated") == 0))


def gate_lineage(versions: DataFrame) -> DataFrame:
    """versions: (session_id, version, parent_version, change_kind, citations). A refinement follows its parent by one
    and keeps its citations."""
    parent = versions.select("session_id", F.col("version").alias("parent_version"), F.col("citations").alias("had"))
    rows = versions.filter("change_kind = 'refinement'").join(parent, ["session_id", "parent_version"], "left")
    kept = F.coalesce(F.size(F.array_except("had", "citations")) == 0, F.lit(True))
    good = (F.col("parent_version") + 1 == F.col("version")) & kept
    return rows.agg(F.count("*").alias("refinements"), F.count_if(good).alias("continuous"))


def coverage_problems(trace: DataFrame, turns_: DataFrame) -> DataFrame:
    """(session_id, utterance_id, problem): rules on what a turn's events must hold."""
    started = trace.filter("event = 'retrieval_started'").groupBy(*TURN, "request_id").agg(F.max("ts_ms").alias("from_ms"))
    done = trace.filter("event = 'retrieval_completed'").groupBy(*TURN, "request_id").agg(F.max("ts_ms").alias("to_ms"))
    pairs = done.join(started, [*TURN, "request_id"], "left")

    def rule(rows: DataFrame, condition: Column, problem: str) -> DataFrame:
        return rows.filter(condition).select(*TURN, F.lit(problem).alias("problem"))

    found = [
        rule(turns_, F.col("n_chunk_received") == 0, "no chunk"), rule(turns_, F.col("n_controller_decision") == 0, "no decision"),
        rule(pairs, F.col("from_ms").isNull(), "completed without start"), rule(pairs, F.col("to_ms") < F.col("from_ms"), "completed before start"),
        rule(turns_, F.col("last_retrieval_ms") > F.col("version_ms"), "answer before retrieval"),
        rule(turns_, (F.col("n_answer_version_created") > 0) & (F.col("n_output_emitted") == 0), "answer without output"),
    ]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every


def call_costs(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """calls (model, tokens_in, tokens_out) with cost_usd; a model without a price costs nothing."""
    joined = calls.join(F.broadcast(prices), "model", "left")  # a price list, a row per model
    return joined.withColumn("cost_usd", F.col("tokens_in") / 1000 * F.coalesce("price_in", F.lit(0.0)) + F.col("tokens_out") / 1000 * F.coalesce("price_out", F.lit(0.0)))


def new_claims(claims: DataFrame) -> DataFrame:
    """Claims (session_id, version, parent_version, change_kind, text, citations) that the parent version hasn't got; reformatting
    turns have none."""
    parent = claims.select("session_id", F.col("version").alias("parent_version"), "text", "citations").distinct()
    return claims.filter("change_kind <> 'restructure'").join(parent, ["session_id", "parent_version", "text", "citations"], "left_anti")


PER_BUCKET = 1 << 16


def bootstrap(items: DataFrame, n_boot: int = 4000, seed: int = 0, per_bucket: int = PER_BUCKET) -> DataFrame:
    """(observed, low, high) of the mean of a - b over paired items (cluster, a, b), whole clusters drawn with replacement. Clusters are summed first
    and dealt by hash to buckets of about ``per_bucket``. How many of a resample's draws fall to each bucket is one multinomial draw, seeded by the
    resample, that every task makes alike; which of its clusters they take, each task draws for its own bucket. So a bucket gives ``n_boot`` rows
    whatever it holds, and a task holds one bucket's sums. Any number of executors makes the same draws."""
    clusters = items.groupBy("cluster").agg(F.sum(F.col("a") - F.col("b")).cast("double").alias("d"), F.count("*").alias("n"))
    size = clusters.count()
    if not size:
        return items.sparkSession.createDataFrame([(0.0, 0.0, 0.0)], "observed double, low double, high double")
    buckets = -(-size // per_bucket)
    dealt = clusters.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), F.col("cluster").cast("string")), F.lit(buckets)).cast("int"))
    held = {r.bucket: r.n for r in dealt.groupBy("bucket").agg(F.count("*").alias("n")).collect()}  # a number a bucket
    shares = np.array([held.get(k, 0) for k in range(buckets)], dtype="float64") / size

    def draw(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values(["cluster", "d", "n"], kind="stable")
        d, n, at = own["d"].to_numpy(), own["n"].to_numpy(), int(key[0])
        rows = np.zeros((n_boot, 2))
        for b in range(n_boot):
            taken = np.random.default_rng([seed, b]).multinomial(size, shares)[at]
            times = np.bincount(np.random.default_rng([seed, b, at + 1]).integers(0, len(d), taken), minlength=len(d))
            rows[b] = times @ d, times @ n
        return pd.DataFrame({"b": np.arange(n_boot), "d": rows[:, 0], "n": rows[:, 1]})

    parts = dealt.withColumn("cluster", F.col("cluster").cast("string")).groupBy("bucket").applyInPandas(draw, "b long, d double, n double")
    means = parts.groupBy("b").agg((F.sum("d") / F.sum("n")).alias("m"))
    bounds = means.agg(F.array_sort(F.collect_list("m")).alias("m"))  # n_boot numbers
    observed = clusters.agg((F.sum("d") / F.sum("n")).alias("observed"))
    return observed.crossJoin(bounds).select("observed", F.get("m", F.lit(int(0.025 * (n_boot - 1)))).alias("low"), F.get("m", F.lit(int(0.975 * (n_boot - 1)))).alias("high"))


def by_interval(scored: DataFrame, thresholds: list[float], *also: str) -> tuple[DataFrame, Column]:
    """Rows of (threshold, also, n) that stand for (score, also) at each threshold of a stated, short grid, and whether their score reaches it. Rows are
    counted once by the interval their score is in, and only the counts meet the grid. A null score reaches none."""
    grid = sorted(set(thresholds))
    reached = sum((F.coalesce((F.col("score") >= t).cast("int"), F.lit(0)) for t in grid), F.lit(0))
    counts = scored.groupBy(reached.alias("_reached"), *also).agg(F.count("*").alias("n"))
    steps = scored.sparkSession.createDataFrame([(t, k) for k, t in enumerate(grid)], "threshold double, _step int")
    return counts.crossJoin(F.broadcast(steps)), F.col("_reached") > F.col("_step")


def sweep(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """Outcomes (answerable, correct, score) by threshold: recall, abstention and their mean."""
    rows, reaches = by_interval(scored, thresholds, "answerable", "correct")
    many = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0))
    n = rows.withColumn("asserted", reaches).groupBy("threshold").agg(
        many(F.col("answerable")).alias("n_answerable"), many(~F.col("answerable")).alias("n_other"),
        many(F.col("answerable") & F.col("asserted") & F.col("correct")).alias("right"),
        many(F.col("answerable") & F.col("asserted") & ~F.col("correct")).alias("wrong"),
        many(~F.col("answerable") & ~F.col("asserted")).alias("refused"),
    )
    recall = F.col("right") / F.greatest(F.col("n_answerable"), F.lit(1))
    abstain = F.col("refused") / F.greatest(F.col("n_other"), F.lit(1))
    return n.withColumn("balanced", F.round((recall + abstain) / 2, 6))


def best_threshold(swept: DataFrame) -> DataFrame:
    """The threshold of the best balance, the least of equals."""
    return swept.agg(F.max_by("threshold", F.struct("balanced", -F.col("threshold"))).alias("threshold"), F.max("balanced").alias("balanced"))


def percentiles_floor(rows: DataFrame, group: str, value: str, quantiles: list[float], of_last: bool = False) -> DataFrame:
    """(group, q, value): the value at place floor(q n) of each group, or floor(q (n - 1))."""
    made = ranks.floor(rows, [group], value, {f"_q{k}": q for k, q in enumerate(quantiles)}, of_last).filter("n > 0")
    each = F.array(*[F.struct(F.lit(q).alias("q"), F.col(f"_q{k}").alias(value)) for k, q in enumerate(quantiles)])
    return made.select(group, F.explode(each).alias("e")).select(group, "e.q", F.col(f"e.{value}").alias("value"))


def cause(flags: dict[str, str]) -> Column:
    """The first failing stage of an error, in the pipeline's order."""
    out = None
    for condition, name in flags.items():
        out = F.when(F.expr(condition), name) if out is None else out.when(F.expr(condition), name)
    return out


def answer_changes(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose answers differ between two runs, or that one of them lacks."""
    return a.select(*keys, F.col("answer").alias("a")).join(b.select(*keys, F.col("answer").alias("b")), keys, "full").filter(~F.col("a").eqNullSafe(F.col("b")))
