"""Deduplication, overlays, replays and unions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.joins import best_rows


def first_by(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in order."""
    return best_rows(rows, keys, order, 1).drop("place")


def replay(rows: DataFrame, source: str, count: int) -> DataFrame:
    """``count`` rows that go round and round the distinct sources in order.

    The sources needed are the first ``count`` distinct ones, found by a top-n;
    with fewer of them the cycle repeats.
    """
    firsts = rows.select(source).where(F.col(source).isNotNull()).distinct().orderBy(source).limit(count)
    numbered = firsts.withColumn("__pos", F.row_number().over(Window.orderBy(source)) - 1).withColumn("__n", F.count("*").over(Window.partitionBy()))
    turns = F.explode(F.sequence(F.lit(0), F.expr(f"({count} - 1 - __pos) div __n")))
    return numbered.where(F.col("__pos") < count).withColumn("__turn", turns).select(source, F.col("__turn").cast("int").alias("turn"))


def overlay(base: DataFrame, retry: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``base`` with the values of ``retry`` where it has one, and the keys that only it has."""
    r = retry.select(*keys, F.col(value).alias("__new"))
    return base.select(*keys, value).join(r, list(keys), "full").select(*keys, F.coalesce("__new", value).alias(value))


def ordered_distinct(values: Column, most: int | None = None) -> Column:
    """Values that are distinct without regard to case, the first spelling of each kept, in order."""
    step = lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x)))
    out = F.aggregate(F.array_compact(values), F.array().cast("array<string>"), step)
    return out if most is None else F.slice(out, 1, most)
