"""Decisions that run through rows in order: averages, levels, cycles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered_values(rows: DataFrame, groups: Sequence[str], order: str, value: str, most: int = 100_000) -> DataFrame:
    """Per group the values in order, for a fold.

    The groups are runs and their rows are rounds: a few thousand at most.  A
    group of more than ``most`` rounds raises instead of filling a task.
    """
    out = rows.groupBy(*groups).agg(F.count("*").alias("__n"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).alias("rounds"))
    return out.withColumn("rounds", F.when(F.col("__n") <= most, F.col("rounds")).otherwise(F.raise_error(F.lit("too many rounds to fold")).cast("array<struct<o:int,v:double>>"))).drop("__n")


def smoothed(rounds: Column, keep: float) -> Column:
    """Exponential average over an array of (o, v), seeded by the first value; nulls are passed over."""
    values = F.filter(rounds, lambda r: r["v"].isNotNull())
    rest = F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0)))
    return F.when(F.size(values) > 0, F.aggregate(rest, F.get(values, F.lit(0))["v"], lambda s, r: keep * r["v"] + (1.0 - keep) * s))


def stepped_level(rounds: Column, start: int, low: float, high: float, least: int, most: int) -> Column:
    """A level that goes up by one where the value is at least ``high``, down where below ``low``."""
    step = lambda s, r: F.least(F.greatest(s + F.when(r["v"] >= high, 1).when(r["v"] < low, -1).otherwise(0), F.lit(least)), F.lit(most))
    return F.aggregate(rounds, F.lit(start), step)


def cycled(cycle: Sequence[str], place: Column) -> Column:
    """The entry of a repeating cycle for a 1-based place."""
    return F.element_at(F.array(*[F.lit(c) for c in cycle]), F.pmod(place - 1, F.lit(len(cycle))).cast("int") + 1)


def relative_scores(rows: DataFrame, group: str, score: str) -> DataFrame:
    """``relative``: the score's place between the group's lowest and highest; 0.5 where they are equal.

    The ranges are an aggregation joined back, so that a hot group isn't gathered for a window.  Groups must not be null.
    """
    low, high = F.col("__low"), F.col("__high")
    ranges = rows.groupBy(group).agg(F.min(score).alias("__low"), F.max(score).alias("__high"))
    return rows.join(ranges, group).withColumn("relative", F.when(high == low, F.lit(0.5)).otherwise(F.try_divide(F.col(score) - low, high - low))).drop("__low", "__high")
