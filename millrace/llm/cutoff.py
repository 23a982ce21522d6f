"""Score cutoffs that keep a target share of each group's rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.ordered import is_finite, ordered_bits
from millrace.operators.lookup import counted, sized_join
from millrace.scratch import Kept, keep

#: A round tells 2 ** DIGITS bins apart in a group, and twice that where scores of both signs are left.
DIGITS = 11


@dataclass
class Cutoffs:
    """``cutoffs``: groups, n, target_kept, cutoff.  ``scored``: the finite rows with their ``score_bits``.  ``count``, ``largest``, ``rows``: of the groups, of the largest one, of all."""

    cutoffs: DataFrame
    scored: DataFrame
    count: int
    largest: int
    rows: int


def _digit(bits: str):
    """The bin of a row: the distance from the group's lowest live score, in steps of 2 ** shift."""
    step = F.when(
        (F.col("lo") < 0) & (F.col("hi") >= 0), F.lit(52)
    ).otherwise(F.greatest(F.lit(0), F.ceil(F.log2((F.col("hi") - F.col("lo")).cast("double") + 1.0)).cast("int") - DIGITS))
    return F.call_function("shiftright", F.col(bits), step).alias("digit")


def share_cutoffs(rows: DataFrame, groups: Sequence[str], score: str, keep_pct: str) -> Cutoffs:
    """Cutoff per group that keeps ``keep_pct`` percent of its rows, rounded up.

    The cutoff is the k-th highest score, k = (n * keep_pct + 99) div 100; ties
    at the cutoff are all kept, so a group may keep more than k.  Rows whose
    score is null, NaN or infinite, or whose ``keep_pct`` is null, take no
    part; a group of which nothing is left has no cutoff, and k = 0 (a share
    of 0) keeps nothing: its cutoff is null.  An empty table gives no rows.
    Groups may have null keys; those form a group.

    Histogram refinement: scores are counted into bins per group, the bin that
    holds the target rank is kept, and so on until its lowest and highest score
    are equal or the rank is the bin's first or last.  Scores are compared as
    64-bit images of the doubles, so that each round settles at least 11 bits and
    six rounds settle any input.  Only rows of the live bins are read again.
    Counts are combined before the shuffle: a group of any size costs a few
    thousand counters.
    """
    keys = list(groups)
    # null-safe grouping: the keys are carried as one struct
    base = rows.where(is_finite(F.col(score)) & F.col(keep_pct).isNotNull())
    base = base.withColumn("score_bits", ordered_bits(F.col(score))).withColumn("__g", F.xxhash64(*keys, *[F.col(k).isNull() for k in keys]))
    scored = keep(base, "cutoff-scores")
    # the hash only spreads the work; the group's own keys decide equality
    on = ["__g", *[f"__k{i}" for i in range(len(keys))]]
    slim = scored.df.select("__g", *[F.coalesce(F.col(k).cast("string"), F.lit("\u0000null")).alias(f"__k{i}") for i, k in enumerate(keys)], "score_bits", F.col(score).alias("__score"), F.col(keep_pct).cast("bigint").alias("__pct"))
    state = slim.groupBy(*on).agg(
        F.count("*").alias("n"), F.max("__pct").alias("__pct"), F.min("score_bits").alias("lo"), F.max("score_bits").alias("hi"), F.min("__score").alias("lo_score"), F.max("__score").alias("hi_score")
    ).withColumn("k", F.expr("(n * __pct + 99) div 100")).drop("__pct")
    state = state.withColumn("left", F.col("k")).withColumn("live", F.col("n"))
    state = keep(_settle(state), "cutoff-state")
    live, settled, spent = slim, [state.df.where("done")], []
    groups_all = _sizes(state.df)
    while (sizes := _sizes(state.df.where("not done")))[0]:
        narrow = state.df.where("not done").select(*on, "lo", "hi", "n", "k", "left")
        joined = sized_join(live.select(*on, "score_bits", "__score"), narrow.select(*on, "lo", "hi", "n"), on, sizes[0], F.col("score_bits"), "n", *sizes[1:]).drop("n")
        live_rows = keep(joined.where("score_bits between lo and hi"), "cutoff-live")
        bins = live_rows.df.groupBy(*on, _digit("score_bits")).agg(
            F.count("*").alias("live"), F.min("score_bits").alias("lo"), F.max("score_bits").alias("hi"), F.min("__score").alias("lo_score"), F.max("__score").alias("hi_score")
        )
        above = Window.partitionBy(*on).orderBy(F.col("digit").desc()).rowsBetween(Window.unboundedPreceding, -1)
        ranked = bins.withColumn("above", F.coalesce(F.sum("live").over(above), F.lit(0)))
        zoomed = ranked.join(counted(narrow.select(*on, "n", "k", "left"), sizes[0]), on).where("left > above and left <= above + live")
        zoomed = zoomed.withColumn("left", F.col("left") - F.col("above")).drop("digit", "above")
        state = keep(_settle(zoomed), "cutoff-state")
        settled.append(state.df.where("done"))
        for old in spent:
            old.drop()
        spent, live = [live_rows], live_rows.df
    for old in spent:
        old.drop()
    result = settled[0]
    for part in settled[1:]:
        result = result.unionByName(part)
    named = result.select(*[F.when(F.col(f"__k{i}") != "\u0000null", F.col(f"__k{i}")).cast(scored.df.schema[k].dataType).alias(k) for i, k in enumerate(keys)], *on, "n", F.col("k").alias("target_kept"), "cutoff", "cut_bits")
    return Cutoffs(named, scored.df, *groups_all)


def _sizes(state: DataFrame) -> tuple[int, int, int]:
    """The number of groups, the rows of the largest and of all."""
    found = state.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    return found[0], found[1], found[2]


def _settle(state: DataFrame) -> DataFrame:
    """Marks the groups whose cutoff is known and adds it."""
    one = F.col("lo") == F.col("hi")
    first, last = F.col("left") <= 1, F.col("left") == F.col("live")
    cut = F.when(F.col("k") <= 0, F.lit(None)).when(first, F.col("hi_score")).when(one | last, F.col("lo_score"))
    bits = F.when(F.col("k") <= 0, F.lit(None)).when(first, F.col("hi")).when(one | last, F.col("lo"))
    wide = state.withColumn("done", one | first | last).withColumn("cutoff", cut.cast("double")).withColumn("cut_bits", bits.cast("bigint"))
    return wide.select(*[c for c in wide.columns if c.startswith("__")], "n", "k", "left", "live", "lo", "hi", "lo_score", "hi_score", "done", "cutoff", "cut_bits")


def kept_rows(found: Cutoffs, groups: Sequence[str], spread_by: str) -> DataFrame:
    """The rows at or above their group's cutoff, with ``cutoff``, ``n`` and ``target_kept``."""
    keys = list(groups)
    on = ["__g", *[f"__k{i}" for i in range(len(keys))]]
    rows = found.scored.select("*", *[F.coalesce(F.col(k).cast("string"), F.lit("\u0000null")).alias(f"__k{i}") for i, k in enumerate(keys)])
    cuts = found.cutoffs.select(*on, "n", "target_kept", "cutoff", "cut_bits")
    joined = sized_join(rows, cuts, on, found.count, F.col(spread_by), "n", found.largest, found.rows)
    return joined.where("score_bits >= cut_bits").drop(*on, "score_bits", "cut_bits")


def cutoff_report(found: Cutoffs, groups: Sequence[str], spread_by: str) -> DataFrame:
    """Per group: n, target_kept, cutoff and the number of rows really kept (0 where nothing is)."""
    on = ["__g", *[f"__k{i}" for i in range(len(list(groups)))]]
    kept = kept_rows(found, groups, spread_by)
    kept = kept.select(F.xxhash64(*groups, *[F.col(k).isNull() for k in groups]).alias("__g"), *[F.coalesce(F.col(k).cast("string"), F.lit("\u0000null")).alias(f"__k{i}") for i, k in enumerate(groups)])
    sizes = kept.groupBy(*on).agg(F.count("*").alias("kept"))
    return found.cutoffs.join(counted(sizes, found.count), on, "left").select(*groups, "n", "target_kept", "cutoff", F.coalesce("kept", F.lit(0)).alias("kept"))
