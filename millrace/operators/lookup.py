"""Joins of a large table with a small one on keys that may be skewed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A side is broadcast only if it was counted and has no more rows than this.
BROADCAST_ROWS = 50_000
SALTS = 16


def lookup_join(big: DataFrame, small: DataFrame, on: Sequence[str], small_rows: int, salt: Column, how: str = "inner", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``big`` joined with ``small``, whose rows are unique by ``on``.

    ``small_rows`` is the counted size of ``small``.  Up to ``broadcast_rows``
    it is broadcast.  Beyond that both sides are shuffled, each row of ``small``
    repeated once per salt and ``big`` spread over the salts, so no key of
    ``big`` gathers in one task.  The hint is needed: Spark's estimate is that of
    ``small``'s files, before the salts, and a broadcast is built on the driver.
    ``how``: inner or left.
    """
    if small_rows <= broadcast_rows:
        return big.join(F.broadcast(small), list(on), how)
    spread = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = big.withColumn("__salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int"))
    return salted.join(spread.hint("merge"), [*on, "__salt"], how).drop("__salt")


def counted(small: DataFrame, small_rows: int, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``small`` as a side of a join: broadcast if its counted size allows it, never by Spark's estimate."""
    return F.broadcast(small) if small_rows <= broadcast_rows else small.hint("merge")


#: Keys of a join with more rows than both of these are hot: a number, and a share of all rows.
HOT_ROWS = 1_000_000
HOT_SHARE = 1 / 1000


def hot_join(big: DataFrame, small: DataFrame, on: str, big_rows: int, small_rows: int, how: str = "inner", broadcast_rows: int = BROADCAST_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``big`` joined with ``small``, unique by ``on``, where ``small`` may be large and a few keys of ``big`` hot.

    Both sizes are counted ones.  A small side of up to ``broadcast_rows`` is
    broadcast.  Beyond that the hot keys of ``big`` (fewer than 1 / HOT_SHARE
    by their definition) are found by a count that is combined before its
    shuffle; their rows meet the few rows of ``small`` by a broadcast, all
    others by a shuffle.  ``how``: inner or left.
    """
    if small_rows <= broadcast_rows:
        return big.join(F.broadcast(small), on, how)
    least = max(hot_rows, int(big_rows * HOT_SHARE))
    if big_rows <= least:
        return big.join(small, on, how)
    hot = [r[0] for r in big.where(F.col(on).isNotNull()).groupBy(on).count().where(F.col("count") > least).collect()]
    if not hot:
        return big.join(small, on, how)
    is_hot = F.coalesce(F.col(on).isin(hot), F.lit(False))
    return big.where(is_hot).join(F.broadcast(small.where(is_hot)), on, how).unionByName(big.where(~is_hot).join(small.where(~is_hot), on, how))


def sized_join(big: DataFrame, small: DataFrame, on: Sequence[str], small_rows: int, salt: Column, size: str, largest: int, big_rows: int, broadcast_rows: int = BROADCAST_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner ``lookup_join`` where ``small`` has in ``size`` how many rows of ``big`` each key has at most.

    ``largest`` is the greatest ``size`` and ``big_rows`` their sum.  Only hot
    keys are repeated and spread over the salts, so a million small groups cost
    one row each in the shuffle; the hot ones (fewer than 1 / HOT_SHARE by
    their definition) are made known to ``big`` by a broadcast.
    """
    if small_rows <= broadcast_rows:
        return big.join(F.broadcast(small), list(on))
    least = max(hot_rows, int(big_rows * HOT_SHARE))
    if largest <= least:
        return big.join(small.hint("merge"), list(on))
    is_hot = F.col(size) > least
    hot = small.where(is_hot).select(*on, F.lit(True).alias("__hot"))
    spread = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.when(is_hot, SALTS - 1).otherwise(0))))
    own = F.when(F.col("__hot"), F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")).otherwise(0)
    salted = big.join(F.broadcast(hot), list(on), "left").withColumn("__salt", own).drop("__hot")
    return salted.join(spread.hint("merge"), [*on, "__salt"]).drop("__salt")
