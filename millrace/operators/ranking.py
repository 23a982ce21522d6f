"""Exact ranks and running sums in groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.scratch import keep

BINS = 1024


def hash_order(seed: int, *columns: Column) -> Column:
    """A seeded random order: the same rows get the same order at any size."""
    return F.xxhash64(*columns, F.lit(seed))


def hash_bin(order: Column, bins: int = BINS) -> Column:
    """The bin of a 64-bit hash; bins ascend with the hash.  ``bins`` is a power of two."""
    return F.shiftright(order, 64 - (bins.bit_length() - 1)).cast("int")


def bin_offsets(rows: DataFrame, groups: Sequence[str], bin_column: str, value: Column | None = None) -> DataFrame:
    """Per group and bin: ``bin_size`` and ``offset``, the sum of the earlier bins' sizes.

    ``value`` is what is summed (default: 1 a row).  The window sees one row a
    bin, never the rows of a group.
    """
    size = F.sum(value if value is not None else F.lit(1)).cast("bigint")
    sizes = rows.groupBy(*groups, bin_column).agg(size.alias("bin_size"))
    before = Window.partitionBy(*groups).orderBy(bin_column).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("offset", F.coalesce(F.sum("bin_size").over(before), F.lit(0).cast("bigint")))


def binned_rank(rows: DataFrame, offsets: DataFrame, groups: Sequence[str], bin_column: str, order: Sequence[Column], out: str = "rank") -> DataFrame:
    """``rows`` with their exact 1-based rank in the group.

    Rows are shuffled by group *and bin*, so that a hot group spreads over all
    tasks; ``offsets`` (from ``bin_offsets``) lifts the rank within the bin to
    the rank in the group.  Bins missing from ``offsets`` are left out.
    """
    keys = [*groups, bin_column]
    within = Window.partitionBy(*keys).orderBy(*order)
    joined = rows.join(offsets.drop("bin_size").hint("merge"), keys)  # the window needs the same shuffle and sort
    return joined.withColumn(out, F.col("offset") + F.row_number().over(within)).drop("offset")


def binned_running_sum(rows: DataFrame, offsets: DataFrame, groups: Sequence[str], bin_column: str, order: Sequence[Column], value: Column, out: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over the earlier rows of the group."""
    keys = [*groups, bin_column]
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(offsets.drop("bin_size").hint("merge"), keys)  # the window needs the same shuffle and sort
    return joined.withColumn(out, F.col("offset") + F.coalesce(F.sum(value).over(before), F.lit(0)).cast("bigint")).drop("offset")


def ranked_by_value(rows: DataFrame, groups: Sequence[str], value: str, ties: Sequence[Column], out: str = "rank", bins: int = BINS) -> DataFrame:
    """``rows`` with their 1-based rank in the group by a finite ``value``, highest first, nulls last.

    Bins cut each group's range of values into equal parts and so descend with
    the value; the rows of a group of any size spread over them, unless one
    value holds most rows.  Groups must not be null.  ``rows`` is written once,
    as it is read for the ranges, the counts and the ranks.
    """
    kept = keep(rows, "rank-rows").df
    ranges = kept.groupBy(*groups).agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
    part = F.floor(F.try_divide(F.col("__high") - F.col(value), F.col("__high") - F.col("__low")) * (bins - 1)).cast("int")
    binned = kept.join(ranges, list(groups)).withColumn("__bin", F.when(F.col(value).isNull(), F.lit(bins)).otherwise(F.coalesce(part, F.lit(0)))).drop("__low", "__high")
    order = [F.col(value).desc_nulls_last(), *ties]
    return binned_rank(binned, bin_offsets(binned, groups, "__bin"), groups, "__bin", order, out).drop("__bin")
