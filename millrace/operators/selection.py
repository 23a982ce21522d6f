"""Quotas, caps, rotations, seeded samples and greedy selection."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.ranking import BINS, bin_offsets, binned_rank, hash_bin
from millrace.scratch import keep

_WORD = (1 << 64) - 1


def largest_remainder(weights: Sequence[float], seats: int, ties: str = "weight", empty: str = "even") -> list[int]:
    """Seats in proportion to the weights, whole parts first, then the largest remainders.

    Equal remainders go to the larger weight (``ties`` weight) or the earlier
    entry (``ties`` first).  With no positive weight the seats are shared
    evenly (``empty`` even) or not given (``empty`` none).  The list is a plan
    of categories, not data.
    """
    n = len(weights)
    if not n or seats <= 0:
        return [0] * n
    total = sum(w for w in weights if w > 0)
    if total <= 0:
        return [seats // n + (i < seats % n) for i in range(n)] if empty == "even" else [0] * n
    exact = [max(w, 0.0) * seats / total for w in weights]
    given = [int(x) for x in exact]
    left = seats - sum(given)
    order = sorted(range(n), key=lambda i: (-(exact[i] - given[i]), -weights[i] if ties == "weight" else 0, i))
    for i in order[:left]:
        given[i] += 1
    return given


def remainder_seats(weights: DataFrame, key: str, weight: str, seats: int) -> DataFrame:
    """``largest_remainder`` on a small table: (key, weight, seats)."""
    whole = Window.partitionBy()
    share = F.col(weight) * seats / F.sum(weight).over(whole)
    base = weights.withColumn("__exact", share).withColumn("__base", F.floor("__exact"))
    order = Window.orderBy((F.col("__exact") - F.col("__base")).desc(), F.desc(weight), F.col(key))
    left = F.lit(seats) - F.sum("__base").over(whole)
    return base.withColumn("__left", left).withColumn("seats", (F.col("__base") + (F.row_number().over(order) <= F.col("__left")).cast("int")).cast("bigint")).select(key, weight, "seats")


def capped(rows: DataFrame, groups: Sequence[str], order: Sequence[Column], cap: int | Column, out: str = "place") -> DataFrame:
    """The first ``cap`` rows of each group, with their place."""
    limit = cap if isinstance(cap, Column) else F.lit(cap)
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col(out) <= limit)


def ranked_whole(rows: DataFrame, order: Column, key: str, bins: int = BINS) -> DataFrame:
    """``rows`` with their rank by a 64-bit hash order over the whole table, without one task seeing all rows."""
    binned = rows.withColumn("__order", order).withColumn("__bin", hash_bin(F.col("__order"), bins)).withColumn("__all", F.lit(1))
    offsets = bin_offsets(binned, ["__all"], "__bin")
    return binned_rank(binned, offsets, ["__all"], "__bin", [F.col("__order"), F.col(key)]).drop("__order", "__bin", "__all")


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement; the same ones at any partitioning.  A top-n, so no full sort."""
    return rows.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), F.col(key)).limit(n)


def quota_then_backfill(rows: DataFrame, stratum: str, key: str, score: str, quota: int, total: int) -> DataFrame:
    """Up to ``quota`` rows of each stratum by score, then the best of the rest up to ``total``."""
    place = Window.partitionBy(stratum).orderBy(F.desc_nulls_last(score), F.col(key))
    ranked = rows.withColumn("__place", F.row_number().over(place)).withColumn("within_quota", F.col("__place") <= quota)
    order = [F.desc("within_quota"), F.desc_nulls_last(score), F.col(key)]
    return ranked.orderBy(*order).limit(total).drop("__place")


def _among(column: str, values: Sequence) -> Column:
    """Whether the column has one of the values, of which null may be one."""
    known = [v for v in values if v is not None]
    hit = F.coalesce(F.col(column).isin(known), F.lit(False)) if known else F.lit(False)
    return hit | F.col(column).isNull() if None in values else hit


def _far(bits: str, seen: Sequence[int], least_distance: int) -> Column:
    """Whether the bits are ``least_distance`` or more from all patterns seen; null is."""
    apart = F.forall(F.lit(list(seen)), lambda other: F.bit_count(F.col(bits).cast("bigint").bitwiseXOR(other.cast("bigint"))) >= least_distance)
    return F.coalesce(apart, F.lit(True))


def greedy_selection(rows: DataFrame, key: str, order: Sequence[Column], group: str, per_group: int, per_stratum: int, stratum: str, bits: str | None, least_distance: int, total: int, over_fetch: int = 8) -> DataFrame:
    """Takes rows in order unless a cap is reached or the bits are too close to a row already taken.

    Each decision depends on the ones before, so it is sequential by
    definition.  The rows are sorted once, in parallel, and decided in blocks of
    ``over_fetch`` * ``total``; before every block the rows that the caps and
    patterns so far exclude for good are left out, in parallel.  So the first
    row of a block is always taken, there are at most ``total`` + 1 blocks and no
    row that the rule allows is lost.  Without bits a row can only be taken
    if it is among the first ``per_group`` of its stratum and group, and then
    among the first ``total`` + ``per_stratum`` of its stratum; the others aren't
    sorted.  ``cut_short`` is false, as no stratum is cut.
    """
    spark = rows.sparkSession
    types = dict(rows.dtypes)
    schema = f"`{key}` {types[key]}, `{group}` {types[group]}, `{stratum}` {types[stratum]}, cut_short boolean"
    if min(per_group, per_stratum, total) <= 0:
        return spark.createDataFrame([], schema)
    if not bits:
        rows = capped(rows, [stratum, group], order, per_group, "__place")
        rows = capped(rows, [stratum], order, total + per_stratum, "__place")
    columns = {"__key": key, "__group": group, "__stratum": stratum, **({"__bits": bits} if bits else {})}
    placed = keep(rows.orderBy(*order).select(*[F.col(c).alias(a) for a, c in columns.items()], F.monotonically_increasing_id().alias("__at")), "greedy-rows")
    by_group: Counter = Counter()
    by_stratum: Counter = Counter()
    seen: list[int] = []
    taken: list[tuple] = []
    at, size = -1, over_fetch * total
    while len(taken) < total:
        left = placed.df.where(F.col("__at") > at)
        left = left.where(~_among("__group", [g for g, n in by_group.items() if n >= per_group]))
        left = left.where(~_among("__stratum", [s for s, n in by_stratum.items() if n >= per_stratum]))
        if seen:
            left = left.where(_far("__bits", seen, least_distance))
        block = left.orderBy("__at").limit(size).collect()
        for row in block:
            g, s, pattern = row["__group"], row["__stratum"], row["__bits"] if bits else None
            if len(taken) >= total or by_group[g] >= per_group or by_stratum[s] >= per_stratum:
                continue
            if pattern is not None:
                if any(((pattern ^ other) & _WORD).bit_count() < least_distance for other in seen):
                    continue
                seen.append(pattern)
            by_group[g] += 1
            by_stratum[s] += 1
            taken.append((row["__key"], g, s, False))
        if len(block) < size:
            break
        at = block[-1]["__at"]
    placed.drop()
    return spark.createDataFrame(taken, schema)
