"""Scans along an order that cut a long group over tasks.

A scan gives a row something of all rows before it in its group. A group is cut into blocks of its order, here stretches of ``width`` of a whole
number. Rows are scanned inside their block, each block gives one summary, summaries are scanned in their group, and the rows of a block take over what
the blocks before it give. So a task sorts one block at a time, however long its group is, and only summaries, one a block, are sorted by group. A group
and a place may be null: nulls are a group like any other, and rows without a place come before all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3_600_000
_FIRST = Window.unboundedPreceding


def _cut(rows: DataFrame, group: list[str], at: str, width: int) -> DataFrame:
    """``div`` goes to zero, so the block at zero is twice as long; blocks keep the order."""
    number = F.coalesce(F.expr(f"`{at}` div {width}"), F.lit(-(2**63)))
    key = F.struct(*group) if group else F.struct(F.lit(0).alias("all"))
    return rows.withColumn("_block", F.struct(key.alias("g"), number.alias("n")))


def _carried(summaries: DataFrame, **what) -> DataFrame:
    """Summaries with columns made over the blocks before each, in turn: each of ``what`` takes that window."""
    before = Window.partitionBy("_block.g").orderBy("_block.n").rowsBetween(_FIRST, -1)
    for name, made in what.items():
        summaries = summaries.withColumn(name, made(before))
    return summaries.select("_block", *what)


def last_known(rows: DataFrame, group: list[str], at: str, order: list[str], value: str, into: str, width: int = HOUR) -> DataFrame:
    """``into``: the last ``value`` that isn't null up to and with the row, by ``order``, which ``at`` leads. Of rows with equal places, null
    values come first and greater ones last."""
    cut = _cut(rows, group, at, width)
    order = [*order, value]
    top = F.max(F.when(F.col(value).isNotNull(), F.struct(*[F.col(c).alias(f"o{k}") for k, c in enumerate(order)])))
    ends = cut.groupBy("_block").agg(top.alias("_top"))
    carry = _carried(ends, _before=lambda w: F.last(F.col("_top")[f"o{len(order) - 1}"], ignorenulls=True).over(w))
    here = Window.partitionBy("_block").orderBy(*order).rowsBetween(_FIRST, 0)
    own = cut.withColumn("_own", F.last(value, ignorenulls=True).over(here))
    return own.join(carry, "_block").withColumn(into, F.coalesce("_own", "_before")).drop("_block", "_own", "_before")


def as_of(left: DataFrame, right: DataFrame, group: list[str], at: str, value: str, into: str, width: int = HOUR) -> DataFrame:
    """left with ``into``: ``value`` of the last row of right in its group whose ``at`` isn't after its own, or null. Of right's rows at one place
    the greatest value counts, and one that is null counts as a row."""
    told = right.select(*group, at, F.struct(F.col(value).alias("v")).alias("_told"), F.lit(0).alias("_side"))
    asked = left.withColumn("_side", F.lit(1))
    found = last_known(asked.unionByName(told, allowMissingColumns=True), group, at, [at, "_side"], "_told", "_found", width)
    return found.filter("_side = 1").withColumn(into, F.col("_found.v")).drop("_side", "_told", "_found")


def numbered(rows: DataFrame, group: list[str], at: str, order: list[str], into: str, width: int = HOUR) -> DataFrame:
    """``into``: the place of each row in its group from 0 by ``order``, which ``at`` leads."""
    cut = _cut(rows, group, at, width)
    carry = _carried(cut.groupBy("_block").agg(F.count("*").alias("_n")), _before=lambda w: F.coalesce(F.sum("_n").over(w), F.lit(0)))
    own = cut.withColumn("_own", F.row_number().over(Window.partitionBy("_block").orderBy(*order)) - 1)
    return own.join(carry, "_block").withColumn(into, (F.col("_before") + F.col("_own")).cast("long")).drop("_block", "_own", "_before")


def serial_ends(rows: DataFrame, group: list[str], at: str, arrived: str, lasts: str, into: str, width: int = 4096) -> DataFrame:
    """``into``: when each of a group's tasks ends that one worker does one after another in the order of ``at``: max(end of the one before,
    arrival) + duration. That is the durations so far plus the greatest arrival less the durations before it, and no less than zero: two
    running values, both of which blocks can carry. A null arrival waits for nothing, a null duration is none. Of equal places the
    earlier arrival and then the shorter task goes first."""
    cut = _cut(rows, group, at, width).withColumns({"_a": F.coalesce(arrived, F.lit(0)), "_d": F.coalesce(lasts, F.lit(0))})
    here = Window.partitionBy("_block").orderBy(at, "_a", "_d").rowsBetween(_FIRST, 0)
    own = cut.withColumn("_sum", F.sum("_d").over(here)).withColumn("_slack", F.max(F.col("_a") - F.col("_sum") + F.col("_d")).over(here))
    parts = own.groupBy("_block").agg(F.sum("_d").alias("_total"), F.max("_slack").alias("_most"))
    carry = _carried(
        parts.withColumn("_past", F.coalesce(F.sum("_total").over(Window.partitionBy("_block.g").orderBy("_block.n").rowsBetween(_FIRST, -1)), F.lit(0))),
        _clock=lambda w: F.col("_past") + F.greatest(F.coalesce(F.max(F.col("_most") - F.col("_past")).over(w), F.lit(0)), F.lit(0)),
    )
    done = own.join(carry, "_block").withColumn(into, F.col("_sum") + F.greatest("_clock", "_slack"))
    return done.drop("_block", "_a", "_d", "_sum", "_slack", "_clock")
