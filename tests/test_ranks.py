"""Exact order statistics, sweeps by counts, and scenarios made from questions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from evidora.operators import evaluate as E
from evidora.operators import quality as Q
from evidora.operators import ranks


def some_values(seed, n=3000):
    """A hot group, heavy ties, a long tail, nulls, a group of nulls alone, a null group."""
    rng = random.Random(seed)
    tail = lambda: round(math.exp(rng.gauss(0, 4)), 3)
    rows = [(rng.choice(["hot", "hot", "hot", "few", None]), rng.choice([None, 5.0, 5.0, tail(), -tail()])) for _ in range(n)]
    return [*rows, ("none", None), ("one", 1.5), ("two", 1.0), ("two", 2.0)]


@pytest.mark.parametrize("blocks", [1, 2, 7, 256])
def test_places_are_exact_for_any_number_of_blocks(spark, blocks):
    data = some_values(blocks)
    rows = spark.createDataFrame(data, "g string, x double")
    places = {"least": lambda n: F.lit(0), "mid": lambda n: F.floor(n / 2), "near_top": lambda n: F.floor(0.99 * n), "beyond": lambda n: n + 5}
    got = {r.g: tuple(r)[1:] for r in ranks.at_places(rows, ["g"], "x", places, blocks).collect()}
    for g in {g for g, _ in data}:
        x = sorted(v for k, v in data if k == g and v is not None)
        n = len(x)
        want = (x[0], x[n // 2], x[min(int(0.99 * n), n - 1)], x[-1]) if n else (None,) * 4
        assert got[g] == (n, *want), g
    assert len(got) == 6


def test_linear_equals_the_built_in_function_and_takes_no_group(spark):
    rows = spark.createDataFrame(some_values(5), "g string, x double")
    ours = ranks.linear(rows, [], "x", {"a": 0.0, "b": 0.37, "c": 0.95, "d": 1.0}, blocks=16).first()
    theirs = rows.agg(*(F.percentile("x", q) for q in (0.0, 0.37, 0.95, 1.0))).first()
    assert tuple(ours)[1:] == pytest.approx(tuple(theirs), rel=1e-12)
    assert ranks.linear(rows.limit(0), ["g"], "x", {"a": 0.5}).collect() == []


def test_nearest_equals_the_built_in_function_on_whole_numbers(spark):
    rng = random.Random(2)
    rows = spark.createDataFrame([(rng.randrange(3), rng.randrange(50)) for _ in range(700)], "g int, x long")
    ours = sorted(map(tuple, ranks.nearest(rows, ["g"], "x", {"p50": 0.5, "p99": 0.99}, blocks=5).drop("n").collect()))
    each = (F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY x)").cast("long") for q in (0.5, 0.99))
    assert ours == sorted(map(tuple, rows.groupBy("g").agg(*each).collect()))


def test_sweeps_count_rows_once_and_equal_plain_counts(spark):
    rng = random.Random(4)
    grid = [0.0, 0.25, 0.5, 0.5, 1.0]
    data = [(rng.random() < 0.6, rng.choice([True, False, None]), rng.choice([None, 0.0, 0.25, 0.5, rng.random()])) for _ in range(500)]
    rows = spark.createDataFrame(data, "answerable boolean, correct boolean, score double")
    got = {r.threshold: r for r in E.sweep(rows, grid).collect()}
    assert sorted(got) == sorted(set(grid))
    for t, r in got.items():
        asserts = [s is not None and s >= t for _, _, s in data]
        assert r.right == sum(a and s and c is True for (a, c, _), s in zip(data, asserts))
        assert r.wrong == sum(a and s and c is False for (a, c, _), s in zip(data, asserts))
        assert r.refused == sum(not a and not s for (a, _, _), s in zip(data, asserts))
        assert r.n_answerable + r.n_other == len(data)
    f1 = {r.threshold: r for r in Q.f1_grid(rows.select("score", F.col("answerable").alias("label")), grid).collect()}
    for t, r in f1.items():
        assert r.n == len(data) and r.premature == sum(s is not None and s >= t and not a for a, _, s in data)
    assert E.sweep(rows.limit(0), grid).collect() == []


def test_backfill_scores_each_pair_once_and_keeps_what_is_there(spark):
    data = [(1, "a b", "a", "c", 0.25), (2, "a b", "a", "a b", None), (2, "a b", "a", "a b", None), (3, None, "a", " ", None), (4, "x", None, "y", None), (5, "a b", "a", None, 0.75)]
    rows = spark.createDataFrame(data, "id long, one string, context string, two string, s_p double")
    seen = []

    def scorer(pairs):
        seen.extend(map(tuple, pairs.collect()))
        return pairs.withColumn("s", F.length("claim").cast("double"))

    made = Q.back_filled(rows, {"p": ("one", "context"), "q": ("two", "context")}, scorer, ["s"])
    assert sorted(seen) == [("a b", "a"), ("c", "a")]
    got = sorted(((r.id, r.s_p, r.s_q) for r in made.collect()), key=str)
    assert got == [(1, 0.25, 1.0), (2, 3.0, 3.0), (2, 3.0, 3.0), (3, None, None), (4, None, None), (5, 0.75, None)]
    seen.clear()
    again = Q.back_filled(made.filter("id IN (2, 3, 4)"), {"p": ("one", "context"), "q": ("two", "context")}, scorer, ["s"])
    assert again.count() == 4 and seen == []
