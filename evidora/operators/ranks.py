"""Exact order statistics of large groups.

Equal values are counted first, so a group has one row per distinct value. A sketch of each group gives ``blocks`` - 1 cut points, which deal its
values to blocks; how many rows a block has is counted, not sketched, so the result is exact however far the cuts are off. Only the blocks that hold
a wanted place are sorted, each by one task: about a ``blocks``-th of the group's distinct values. No buffer holds a group's values. Nulls aren't
values: a group of nulls alone has n = 0 and null results. A group's key may be null, which is a group like any other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCKS = 256
Place = Callable[[Column], Column]


def _cuts_below(cuts: Column, value: Column, blocks: int) -> Column:
    """How many of the sorted cuts are less than the value, by halving."""
    steps = max(blocks - 1, 1).bit_length()
    widths = F.array(*[F.lit(1 << k) for k in reversed(range(steps))])
    return F.aggregate(widths, F.lit(0), lambda at, w: F.when((at + w <= F.size(cuts)) & (F.try_element_at(cuts, at + w) < value), at + w).otherwise(at))


def at_places(rows: DataFrame, group: list[str], value: str, places: dict[str, Place], blocks: int = BLOCKS) -> DataFrame:
    """(group, n, a column per place): the value at each place, from 0, of its group in order. A place is made from the number of values, and one
    outside 0 to n - 1 is held at the nearer end."""
    key = F.struct(*group) if group else F.struct(F.lit(0).alias("all"))
    counts = rows.groupBy(key.alias("_g"), F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    shares = F.array(*[F.lit(k / blocks) for k in range(1, max(blocks, 2))])
    groups = counts.groupBy("_g").agg(
        F.percentile_approx("_v", shares, 8 * blocks).alias("_cuts"), F.coalesce(F.sum(F.when(F.col("_v").isNotNull(), F.col("_c"))), F.lit(0)).alias("n")
    )
    dealt = counts.filter("_v IS NOT NULL").join(groups.select("_g", "_cuts"), "_g").select("_g", "_v", "_c", _cuts_below(F.col("_cuts"), F.col("_v"), blocks).alias("_b"))
    sizes = dealt.groupBy("_g", "_b").agg(F.sum("_c").alias("_in"))
    before = F.coalesce(F.sum("_in").over(Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), F.greatest(F.least(place(F.col("n")).cast("long"), F.col("n") - 1), F.lit(0)).alias("at")) for name, place in places.items()])
    inside = F.transform(F.filter("_wanted", lambda p: (p["at"] >= F.col("_before")) & (p["at"] < F.col("_before") + F.col("_in"))), lambda p: F.struct(p["name"].alias("name"), (p["at"] - F.col("_before")).alias("at")))
    targets = sizes.withColumn("_before", before).join(groups.select("_g", wanted.alias("_wanted")), "_g").select("_g", "_b", inside.alias("_here")).filter(F.size("_here") > 0)
    here = Window.partitionBy("_g", "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    run = dealt.join(targets, ["_g", "_b"]).withColumn("_upto", F.sum("_c").over(here))
    hits = F.filter("_here", lambda p: (p["at"] < F.col("_upto")) & (p["at"] >= F.col("_upto") - F.col("_c")))
    found = run.select("_g", "_v", F.explode(hits).alias("p")).groupBy("_g").agg(*[F.max(F.when(F.col("p.name") == name, F.col("_v"))).alias(name) for name in places])
    return groups.select("_g", "n").join(found, "_g", "left").select(*[F.col("_g")[c].alias(c) for c in group], "n", *places)


def linear(rows: DataFrame, group: list[str], value: str, quantiles: dict[str, float], blocks: int = BLOCKS) -> DataFrame:
    """(group, n, a column per quantile) by straight lines between neighbours: the value at q (n - 1)."""
    places: dict[str, Place] = {}
    for name, q in quantiles.items():
        places |= {f"_lo_{name}": lambda n, q=q: F.floor(q * (n - 1)), f"_hi_{name}": lambda n, q=q: F.ceil(q * (n - 1))}
    rank = lambda q: q * (F.col("n") - 1)
    own = lambda k, q: (F.col(f"_lo_{k}") + (F.col(f"_hi_{k}") - F.col(f"_lo_{k}")) * (rank(q) - F.floor(rank(q)))).cast("double")
    return at_places(rows, group, value, places, blocks).select(*group, "n", *[own(k, q).alias(k) for k, q in quantiles.items()])


def nearest(rows: DataFrame, group: list[str], value: str, quantiles: dict[str, float], blocks: int = BLOCKS) -> DataFrame:
    """(group, n, a column per quantile): the least value with at least a share of q at or below it."""
    return at_places(rows, group, value, {k: (lambda n, q=q: n - F.floor(n - q * n) - 1) for k, q in quantiles.items()}, blocks)


def floor(rows: DataFrame, group: list[str], value: str, quantiles: dict[str, float], of_last: bool = False, blocks: int = BLOCKS) -> DataFrame:
    """(group, n, a column per quantile): the value at place floor(q n), or floor(q (n - 1))."""
    return at_places(rows, group, value, {k: (lambda n, q=q: F.floor(q * (n - int(of_last)))) for k, q in quantiles.items()}, blocks)
