"""Which items of a group are taken in order, each if it still fits into what is open."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.lookup import lookup_join
from millrace.operators.ranking import BINS
from millrace.scratch import Kept, keep

_SHIFT = 64 - (BINS.bit_length() - 1)


def _after(order: str, item: str, cursor: Column) -> Column:
    """Whether the row comes after the cursor; one without an item ends its bin."""
    tie = (F.col(order) == cursor["at"]) & F.coalesce(F.col(item) > cursor["item"], F.lit(False))
    return cursor["at"].isNull() | (F.col(order) > cursor["at"]) | tie


def taken(rounds: Column, size: str, order: str, item: str) -> Column:
    """Whether one of the rounds took the row."""

    def in_round(r: Column) -> Column:
        return (F.col(size) <= r["open"]) & _after(order, item, r["since"]) & ~_after(order, item, r["until"])

    return F.exists(rounds, in_round)


def first_fit(rows: DataFrame, goals: DataFrame, groups: Sequence[str], plan: str, item: str, size: str, order: str, bin_column: str, cells: int) -> Kept:
    """Per plan and group, which rows are taken: (plan, groups, rounds, extra, open).

    ``rows``: groups, ``item``, its whole-number ``size``, its 64-bit hash
    ``order`` and the ``bin_column`` of that (``hash_bin``).  ``goals``: plan,
    groups, goal (bigint); ``cells`` is its counted size.  In the order of the
    hash (ties by item) a row is taken if it still fits into what is open of
    the goal; after the last one the row whose size is nearest to what is left
    is taken on top, if that brings the sum nearer to the goal (``extra``).
    Rows of size 0 or less aren't taken.

    That sequence is found without walking it: all rows up to the first that
    doesn't fit form a round; the next round has the later rows that fit into
    what is left.  A round ends in one hash bin of the group, so sums are taken
    by bin and only the rows of that bin are ordered.  Sizes of what is open
    fall from round to round, and rounds go on until no row fits.  ``rounds``
    says for each what was open and which range of the order it covers:
    ``taken`` tells of a row whether it is in one.
    """
    places = [plan, *groups]
    kind = dict(rows.dtypes)[item]
    cursor = f"struct<at:bigint,item:{kind}>"
    nowhere = F.lit(None).cast(cursor)
    slim = rows.where(F.col(size) > 0).select(*groups, item, size, order, bin_column)
    state = keep(goals.select(*places, F.col("goal").alias("open"), nowhere.alias("since"), F.array().cast(f"array<struct<open:bigint,since:{cursor},until:{cursor}>>").alias("rounds"), F.lit(True).alias("active")), "fit-state")

    def candidates(s: DataFrame, *extra: str) -> DataFrame:
        entry = F.struct(plan, "open", "since", *extra)
        by_group = s.groupBy(*groups).agg(F.collect_list(entry).alias("__plans"))  # an entry per plan
        joined = lookup_join(slim, by_group, groups, cells, F.col(order))
        return joined.withColumn("__p", F.explode("__plans")).select(*slim.columns, "__p.*")

    while state.df.where("active and open > 0").limit(1).count():
        found = candidates(state.df.where("active and open > 0"))
        found = found.where((F.col(size) <= F.col("open")) & _after(order, item, F.col("since")))
        sums = found.groupBy(*places, bin_column).agg(F.sum(size).alias("__sum"), F.first("open").alias("open"))
        ordered = Window.partitionBy(*places).orderBy(bin_column)
        before = F.coalesce(F.sum("__sum").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        binned = sums.withColumn("__before", before).withColumn("__last", F.lead(bin_column).over(ordered).isNull())
        ends = binned.where("__before <= open and (open < __before + __sum or __last)").select(*places, bin_column, "__before")
        inside = lookup_join(found.drop("since"), ends, [*places, bin_column], cells, F.col(order))
        within = Window.partitionBy(*places, bin_column).orderBy(order, item)
        running = inside.withColumn("__upto", F.col("__before") + F.sum(F.col(size)).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        at = F.struct(F.col(order).alias("at"), F.col(item).alias("item"))
        fits = F.col("__upto") <= F.col("open")
        last = running.groupBy(*places).agg(F.max(F.when(fits, at)).alias("until"), F.max(F.when(fits, F.col("__upto"))).alias("used"), F.first("__before").alias("__before"), F.first(bin_column).alias("__bin"))
        # nothing fits in that bin: the round ends with the bin before it
        edge = F.struct((F.expr(f"shiftleft(cast(__bin as bigint), {_SHIFT})") - 1).alias("at"), F.lit(None).cast(kind).alias("item"))
        last = last.select(*places, F.when(F.col("until").isNotNull(), F.col("until")).otherwise(edge).alias("until"), F.coalesce("used", "__before").alias("used"))
        joined = state.df.join(last, places, "left")
        hit = F.col("used").isNotNull()
        one = F.struct("open", "since", "until")
        after = joined.select(
            *places, (F.col("open") - F.coalesce("used", F.lit(0))).alias("open"), F.when(hit, F.col("until")).otherwise(F.col("since")).alias("since"), F.when(hit, F.concat("rounds", F.array(one))).otherwise(F.col("rounds")).alias("rounds"), hit.alias("active")
        )
        older, state = state, keep(after, "fit-state")
        older.drop()
    rest = candidates(state.df.where("open > 0"), "rounds")
    rest = rest.where((F.col(size) > F.col("open")) & (F.col(size) < 2 * F.col("open")) & ~taken(F.col("rounds"), size, order, item))
    extra = rest.groupBy(*places).agg(F.min_by(item, F.struct(F.col(size), F.col(order), F.col(item))).alias("extra"))
    out = keep(state.df.join(extra, places, "left").select(*places, "rounds", "extra", "open"), "fit-rounds")
    state.drop()
    return out
