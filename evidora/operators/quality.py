"""Quality of runs against gold rows: classification, ranking of scores, refusal policies, paired runs, stage bounds,
training rows, log rules, a logistic gate. Grouped aggregates and equi-joins; nothing is gathered but short lists.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidora.functions import stats
from evidora.functions import text as T
from evidora.operators import ranks
from evidora.operators.evaluate import by_interval

SCORE_DIGITS = 6


def classification(predicted: Column, label: Column, weight: Column | None = None) -> list[Column]:
    """Aggregates of a two-class decision: counts, accuracy, precision, recall, F1; 0 where nothing can be divided by. A row stands for ``weight`` rows."""
    many = F.count_if if weight is None else lambda condition: F.coalesce(F.sum(F.when(condition, weight)), F.lit(0))
    hit, false, missed, n = many(predicted & label), many(predicted & ~label), many(~predicted & label), F.count("*") if weight is None else F.sum(weight)
    shares = {"accuracy": (many(predicted == label), n), "precision": (hit, hit + false), "recall": (hit, hit + missed), "f1": (2 * hit, 2 * hit + false + missed)}
    return [n.alias("n"), *(F.round(T.ratio(a, b), 6).alias(k) for k, (a, b) in shares.items()), false.alias("premature"), missed.alias("missed")]


def f1_grid(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """``classification`` of (score, label) at each threshold of a stated, short grid."""
    rows, reaches = by_interval(scored, thresholds, "label")
    return rows.groupBy("threshold").agg(*classification(reaches, F.col("label"), F.col("n")))


def auc(scored: DataFrame) -> DataFrame:
    """Area under the curve of (score, label): the share of pairs that are in order, equal scores half. Scores from 0 to 1 are
    rounded to six digits, so that a million rows at most are ordered, however many there are before; null without pairs."""
    counts = scored.groupBy(F.round("score", SCORE_DIGITS).alias("s")).agg(F.count_if("label").alias("p"), F.count_if(~F.col("label")).alias("q"))
    below = F.coalesce(F.sum("q").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    area = F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)) / F.nullif(F.sum("p") * F.sum("q"), F.lit(0)).cast("double")
    return counts.withColumn("below", below).agg(F.coalesce(F.sum("p"), F.lit(0)).alias("n_true"), F.coalesce(F.sum("q"), F.lit(0)).alias("n_false"), F.round(area, 6).alias("auc"))


def policies(swept: DataFrame, cases: list[tuple[float, float]]) -> DataFrame:
    """The threshold of the best utility for each stated (share of unanswerable questions, price of a wrong answer), the least
    of equals, with its rates of right and wrong answers and of assertions where no answer exists."""
    rates = swept.select(
        "threshold", T.ratio(F.col("right"), F.col("n_answerable")).alias("right"), T.ratio(F.col("wrong"), F.col("n_answerable")).alias("wrong"),
        T.ratio(F.col("n_other") - F.col("refused"), F.col("n_other")).alias("asserted"),
    )
    each = [F.struct(F.lit(p).alias("p_unanswerable"), F.lit(c).alias("price"), F.round(stats.utility(F.col("right"), F.col("wrong"), F.col("asserted"), p, c), 6).alias("utility")) for p, c in cases]
    rows = rates.withColumn("c", F.explode(F.array(*each))).select("threshold", "right", "wrong", "asserted", "c.*")
    best = F.max_by(F.struct("threshold", "utility", "right", "wrong", "asserted"), F.struct("utility", -F.col("threshold")))
    return rows.groupBy("p_unanswerable", "price").agg(best.alias("b")).select("p_unanswerable", "price", "b.threshold", "b.utility", *(F.round(f"b.{c}", 6).alias(c) for c in ("right", "wrong", "asserted")))


def paired_latency(rows: DataFrame, keys: list[str], base: str, other: str) -> DataFrame:
    """Latencies (keys, mode, ms) of two modes over the turns that both have: medians, 95th percentiles, and how much faster."""
    one = rows.groupBy(*keys).agg(*(F.min(F.when(F.col("mode") == m, F.col("ms"))).alias(c) for m, c in ((base, "a"), (other, "b")))).filter("a IS NOT NULL AND b IS NOT NULL")
    each = one.select(F.expr("stack(2, 'base', a, 'other', b) AS (side, ms)"))
    found = ranks.linear(each, ["side"], "ms", {"p50": 0.5, "p95": 0.95})
    of = lambda side, c: F.round(F.max(F.when(F.col("side") == side, F.col(c))), 6).alias(f"{side}_{c}")
    made = found.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), *(of(side, c) for side in ("base", "other") for c in ("p50", "p95")))
    return made.withColumn("speed_up", F.round(F.col("base_p50") / F.nullif(F.col("other_p50"), F.lit(0.0)), 6))


def paired_outcomes(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Two runs' outcomes (keys, right) over the items that both have: right in each, lost, gained, and lost less gained by item."""
    rows = a.select(*keys, F.col("right").alias("a")).join(b.select(*keys, F.col("right").alias("b")), keys)
    counts = rows.agg(F.count("*").alias("n"), F.count_if("a").alias("first_right"), F.count_if("b").alias("second_right"), F.count_if(F.col("a") & ~F.col("b")).alias("lost"), F.count_if(~F.col("a") & F.col("b")).alias("gained"))
    return counts.withColumn("points", F.round((F.col("lost") - F.col("gained")) / F.greatest(F.col("n"), F.lit(1)), 6))


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """Items (metric, scenario, turn, value) of two runs, averaged by turn first, as the claims of a turn can't be paired."""
    turn = ["metric", "scenario", "turn"]
    mean = lambda rows, name: rows.groupBy(*turn).agg(F.avg("value").alias(name))
    rows = mean(a, "a").join(mean(b, "b"), turn)
    return rows.groupBy("metric").agg(F.count("*").alias("n_paired"), F.round(F.avg("a"), 6).alias("baseline"), F.round(F.avg("b"), 6).alias("candidate"), F.round(F.avg(F.col("b") - F.col("a")), 6).alias("diff"))


def stage_bounds(items: DataFrame) -> DataFrame:
    """(class, n, gain, bound) of items (right, class): what repairing one class of failures would give at most."""
    total = items.agg(F.count("*").alias("total"), F.count_if("right").alias("now"))
    lost = items.filter(~F.col("right")).groupBy("class").agg(F.count("*").alias("n"))
    return lost.crossJoin(total).select("class", "n", F.round(F.col("n") / F.col("total"), 6).alias("gain"), F.round((F.col("n") + F.col("now")) / F.col("total"), 6).alias("bound"))


def ready_rows(chunks: DataFrame, intents: DataFrame, cover: float = 0.7) -> DataFrame:
    """Training rows (session_id, seq, ready) of chunks (session_id, seq, text) and gold intents (session_id, intent): whether the words up
    to a chunk cover a share of some intent. An intent is ready where enough of its words have come first, so running
    texts, whose size grows with the square of a session, aren't made. Sessions without an intent with words have no rows."""
    wanted = intents.select("session_id", "intent", T.content_set(F.col("intent")).alias("own")).filter(F.size("own") > 0).distinct()
    need = wanted.select("session_id", "intent", F.size("own").alias("n"), F.explode("own").alias("token"))
    heard = chunks.select("session_id", "seq", F.explode(T.content_set(F.coalesce("text", F.lit("")))).alias("token")).groupBy("session_id", "token").agg(F.min("seq").alias("first"))
    came = need.join(heard, ["session_id", "token"]).groupBy("session_id", "intent", "n").agg(F.array_sort(F.collect_list("first")).alias("came"))
    at = F.get("came", F.ceil(F.col("n") * F.lit(cover) - F.lit(1e-9)).cast("int") - 1)
    ready = came.select("session_id", at.alias("at")).groupBy("session_id").agg(F.min("at").alias("at"))
    rows = chunks.join(wanted.select("session_id").distinct(), "session_id", "left_semi").join(ready, "session_id", "left")
    return rows.select("session_id", "seq", F.coalesce(F.col("seq") >= F.col("at"), F.lit(False)).alias("ready"))


def back_filled(rows: DataFrame, pairs: dict[str, tuple[str, str]], scorer, features: list[str]) -> DataFrame:
    """rows with a column ``<feature>_<name>`` for each pair of text columns (claim, context) called ``name``. ``scorer`` takes a table of distinct pairs
    (claim, context) and gives it with the features; it sees each pair once, however many rows and names share it, and only those that some row
    lacks a feature of. What rows already have stays, so a second run scores nothing anew. A null or blank claim, or a null context, has no features.
    Rows are as many as before, repeated ones included."""
    made = [(name, f, f"{f}_{name}") for name in pairs for f in features]
    rows = rows.select("*", *[F.lit(None).cast("double").alias(c) for _, _, c in made if c not in rows.columns])
    key = {name: F.when((F.trim(a) != "") & F.col(b).isNotNull(), F.struct(F.col(a).alias("claim"), F.col(b).alias("context"))) for name, (a, b) in pairs.items()}
    lacks = {name: F.when(F.greatest(*[F.col(c).isNull() for n, _, c in made if n == name], F.lit(False)), key[name]) for name in pairs}
    asked = rows.select(F.explode(F.array_distinct(F.array(*lacks.values()))).alias("p")).filter("p IS NOT NULL").select("p.*").distinct()
    scored = scorer(asked).select(F.struct("claim", "context").alias("_p"), *[F.col(f).cast("double").alias(f"_{f}") for f in features])
    for name in pairs:
        found = rows.withColumn("_p", lacks[name]).join(scored, "_p", "left")
        rows = found.withColumns({c: F.coalesce(c, f"_{f}") for n, f, c in made if n == name}).drop("_p", *[f"_{f}" for f in features])
    return rows


def log_problems(trace: DataFrame, events: tuple[str, ...], turn_events: tuple[str, ...]) -> DataFrame:
    """(event, problem, n): what a log's rows lack. Events must be known and have a time and a session, those of turns an utterance too."""
    event = F.col("event")
    rules = {
        "no event": event.isNull(), "unknown event": event.isNotNull() & ~event.isin(*events), "no time": F.col("ts_ms").isNull(), "no session": F.col("session_id").isNull(),
        "no utterance": F.coalesce(event.isin(*turn_events), F.lit(False)) & F.col("utterance_id").isNull(),
    }
    found = F.filter(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())), lambda x: x.isNotNull())
    return trace.select("event", F.explode(found).alias("problem")).groupBy("event", "problem").agg(F.count("*").alias("n"))


def fit_gate(rows: DataFrame, features: list[str], label: str, l2: float = 1.0):
    """A logistic model of standardised features with a ridge; nulls count as 0. Returns (intercept, weights) on raw features
    and the function that scores rows as a Column, so that scoring needs no model object."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    clean = rows.select(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features), F.col(label).cast("double").alias("label"))
    n = clean.count()
    model = LogisticRegression(regParam=l2 / max(1, n), standardization=True, maxIter=100, tol=1e-9).fit(VectorAssembler(inputCols=features, outputCol="features").transform(clean))
    weights, bias = model.coefficients.toArray().tolist(), float(model.intercept)

    def probability() -> Column:
        z = F.lit(bias)
        for c, w in zip(features, weights, strict=True):
            z = z + F.lit(w) * F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))

    if not all(map(math.isfinite, [bias, *weights])):
        raise ValueError("the fit did not converge: both classes are needed")
    return bias, weights, probability
