"""Samples whose category shares match given targets."""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.ranking import bin_offsets, hash_bin, hash_order
from millrace.scratch import keep

#: The targets are a table of categories written by people; more rows than this is an error.
TARGET_ROWS = 10_000


def divisor_seats(counts: Sequence[int], targets: Sequence[float], floors: Sequence[int], size: int) -> list[int]:
    """Seats per category: how many of its records are among the ``size`` smallest priorities.

    The r-th record of a category has priority (r - 0.5) / target; records up
    to the category's floor come before all others.  Equal priorities go to
    the earlier category.  A category with target 0 gets its floor only.
    """
    have = np.asarray(counts, dtype=np.int64)
    share = np.asarray(targets, dtype=np.float64)
    seats = _smallest(np.zeros_like(have), np.minimum(have, np.asarray(floors, dtype=np.int64)), share, size)
    rest = size - int(seats.sum())
    if rest > 0:
        seats = _smallest(seats, np.where(share > 0, have, seats), share, rest)
    return [int(x) for x in seats]


def _smallest(start: np.ndarray, end: np.ndarray, share: np.ndarray, want: int) -> np.ndarray:
    """Moves ``start`` towards ``end`` by the ``want`` smallest priorities; a share of 0 comes last."""
    if want >= int((end - start).sum()):
        return end.copy()
    if want <= 0:
        return start.copy()

    def at(t: float) -> np.ndarray:
        ranks = np.floor(np.minimum(t * share + 0.5, 2.0**62)).astype(np.int64)
        return np.clip(np.minimum(ranks, end), start, end)

    low, high = 0.0, (float(end.max()) + 1.0) / max(share[share > 0].min(initial=1.0), 1e-300)
    for _ in range(64):  # the largest threshold that gives no more than is wanted
        middle = (low + high) / 2
        low, high = (middle, high) if int((at(middle) - start).sum()) <= want else (low, middle)
    seats = at(low)
    # rounding may have put a record on either side of the threshold: step back a little, then add one by one
    seats = np.maximum(start, seats - 2 * (share > 0))
    queue = [((seats[i] + 0.5) / share[i] if share[i] > 0 else float("inf"), i) for i in range(len(seats)) if seats[i] < end[i]]
    heapq.heapify(queue)
    for _ in range(want - int((seats - start).sum())):
        _, i = heapq.heappop(queue)
        seats[i] += 1
        if seats[i] < end[i]:
            heapq.heappush(queue, ((seats[i] + 0.5) / share[i] if share[i] > 0 else float("inf"), i))
    return seats


@F.pandas_udf(T.ArrayType(T.LongType()))
def _seats(counts: pd.Series, targets: pd.Series, floors: pd.Series, sizes: pd.Series) -> pd.Series:
    return pd.Series([divisor_seats(*one) for one in zip(counts, targets, floors, sizes, strict=True)])


@dataclass
class QuotaSample:
    """``sample``: the chosen rows with rank and priority.  ``report``: a row per stratum and target category."""

    sample: DataFrame
    report: DataFrame


def quota_sample(rows: DataFrame, targets: DataFrame, axis: str, stratum: str, category: str, record: str, size_pct: int, seed: int = 0) -> QuotaSample:
    """Draws from every (axis, stratum) a sample whose category shares match the targets.

    ``rows`` has one row per record: the four named columns and any others.
    ``targets`` has axis, category, target_pct and min_keep.  The sample size
    is ``size_pct`` percent of the stratum's rows, rounded down, over all of
    them, known category or not; only rows of a target category can be drawn.

    Records are ranked at random (seeded) within stratum and category, the r-th
    has priority (r - 0.5) / target, records within ``min_keep`` come first, and
    the smallest priorities of the stratum are kept; what an exhausted category
    leaves goes to the next priorities.  A category's priorities follow from
    its count alone, so the threshold is found on the table of counts, and one
    pass over the rows keeps those under it.  Ranks come from hash bins: a
    stratum or category may hold a third of all rows.

    Nulls: a null stratum is a stratum, a null category is unknown.  Rows
    repeated under one record id are separate records; make ids unique first.
    No rows give an empty sample and report.  Report columns: axis, stratum,
    category, target_pct, min_keep, n, sample_size, available, required, seats,
    is_short, seats_short; required is the larger of min_keep and target_pct percent of the
    sample size, rounded up.
    """
    spark = rows.sparkSession
    wanted = targets.select(F.col("axis"), F.col("category"), F.col("target_pct").cast("double"), F.col("min_keep").cast("int")).orderBy("axis", F.desc("target_pct"), "category").limit(TARGET_ROWS + 1).collect()
    if len(wanted) > TARGET_ROWS:
        raise ValueError(f"more than {TARGET_ROWS} target rows")
    schema = T.StructType([T.StructField("__axis", T.StringType()), T.StructField("__category", T.StringType()), T.StructField("target_pct", T.DoubleType()), T.StructField("min_keep", T.IntegerType()), T.StructField("__place", T.IntegerType())])
    plan = spark.createDataFrame([(*r, i) for i, r in enumerate(wanted)], schema)

    order = hash_order(seed, F.col(record).cast("string"))
    keyed = rows.withColumn("__axis", F.col(axis)).withColumn("__stratum", F.coalesce(F.concat(F.lit("s"), F.col(stratum)), F.lit("null"))).withColumn("__category", F.col(category)).withColumn("__order", order).withColumn("__bin", hash_bin(order))
    kept = keep(keyed, "quota-rows")
    cells = ["__axis", "__stratum", "__category"]
    slim = kept.df.select(*cells, "__bin")
    by_bin = keep(bin_offsets(slim, cells, "__bin"), "quota-bins")
    counts = by_bin.df.groupBy(*cells).agg(F.sum("bin_size").alias("available"))
    strata = counts.groupBy("__axis", "__stratum").agg(F.sum("available").alias("n"))
    grid = strata.join(F.broadcast(plan), "__axis").join(counts, cells, "left")
    grid = grid.withColumn("available", F.coalesce("available", F.lit(0))).withColumn("sample_size", F.expr(f"(n * {int(size_pct)}) div 100"))
    grid = grid.withColumn("required", F.greatest(F.col("min_keep").cast("bigint"), F.expr("cast(ceil(cast(sample_size as decimal(18, 0)) * cast(target_pct as decimal(9, 5)) * 0.01) as bigint)")))

    # a row per stratum, holding at most one entry per target
    entries = F.array_sort(F.collect_list(F.struct("__place", "__category", "target_pct", "min_keep", "available", "required")))
    strata_rows = grid.groupBy("__axis", "__stratum", "n", "sample_size").agg(entries.alias("t"))
    given = _seats("t.available", "t.target_pct", "t.min_keep", "sample_size")
    seats = strata_rows.withColumn("seats", given).select("__axis", "__stratum", "n", "sample_size", F.explode(F.arrays_zip("t", "seats")).alias("z")).select("__axis", "__stratum", "n", "sample_size", "z.t.*", "z.seats")
    seats = keep(seats, "quota-seats")
    # only bins that reach into the seats take part, so four rows in five are gone before the ranking
    live = by_bin.df.join(seats.df.select(*cells, "seats", "target_pct", "min_keep"), cells).where(F.col("offset") < F.col("seats"))
    ranked = _rank(kept.df, live, [*cells, "__bin"])
    chosen = ranked.where("rank <= seats").withColumn("priority", (F.col("rank") - 0.5) / F.col("target_pct")).withColumn("within_floor", F.col("rank") <= F.col("min_keep"))
    sample = chosen.drop(*cells, "__bin", "__order", "seats", "target_pct", "min_keep", "bin_size")
    report = seats.df.select(F.col("__axis").alias("axis"), F.expr("if(__stratum = 'null', null, substring(__stratum, 2))").alias("stratum"), F.col("__category").alias("category"), "target_pct", "min_keep", "n", "sample_size", "available", "required", "seats", (F.col("available") < F.col("required")).alias("is_short"), (F.col("seats") < F.col("required")).alias("seats_short"))
    return QuotaSample(sample, report)


def _rank(rows: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    from pyspark.sql import Window

    within = Window.partitionBy(*keys).orderBy("__order")
    return rows.join(live.hint("merge"), keys).withColumn("rank", F.col("offset") + F.row_number().over(within)).drop("offset")
