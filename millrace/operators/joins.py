"""Joins of the curation and evaluation steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_by(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the last in order; a build side must be unique or the join multiplies rows."""
    rank = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(rank)).where("__r = 1").drop("__r")


def fallback_join(left: DataFrame, right: DataFrame, key: tuple[str, str], second: tuple[str, str], columns: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``left`` with ``columns`` of the right row that matches on ``key``, or else on ``second``.

    Keys are (left column, right column).  Of right rows sharing a key the last
    in ``order`` counts.  ``matched_by``: key, second or null.
    """
    first = last_by(right.where(F.col(key[1]).isNotNull()), [key[1]], order).select(F.col(key[1]).alias("__k1"), F.struct(*columns).alias("__first"))
    other = last_by(right.where(F.col(second[1]).isNotNull()), [second[1]], order).select(F.col(second[1]).alias("__k2"), F.struct(*columns).alias("__second"))
    both = left.join(first, left[key[0]] == F.col("__k1"), "left").join(other, left[second[0]] == F.col("__k2"), "left")
    by = F.when(F.col("__first").isNotNull(), "key").when(F.col("__second").isNotNull(), "second")
    return both.withColumn("__hit", F.coalesce("__first", "__second")).select(*left.columns, *[F.col("__hit")[c].alias(c) for c in columns], by.alias("matched_by"))


def best_rows(rows: DataFrame, groups: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; cut in every partition before the shuffle."""
    rank = Window.partitionBy(*groups).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(rank)).where(F.col("place") <= n)


def best_against_rest(rows: DataFrame, group: str, index: str, score: str, chosen: Column, margin: float, per_group: int) -> DataFrame:
    """Pairs of a group's best chosen row and others that score lower by ``margin`` or more.

    The nearest ``per_group`` losers that keep the margin are taken: the margin
    is tested before the limit.  One winner a group keeps the pairs linear.
    """
    winner = best_rows(rows.where(chosen & F.col(score).isNotNull()), [group], [F.desc(score), F.col(index)], 1)
    winner = winner.select(F.col(group), F.col(index).alias("winner"), F.col(score).alias("winner_score"))
    losers = rows.where(F.col(score).isNotNull()).select(F.col(group), F.col(index).alias("loser"), F.col(score).alias("loser_score"))
    pairs = losers.join(winner, group).where((F.col("winner") != F.col("loser")) & (F.col("winner_score") - F.col("loser_score") >= margin))
    return best_rows(pairs, [group], [F.desc("loser_score"), F.col("loser")], per_group)


def hardest_pairs(rows: DataFrame, group: str, index: str, score: str, positive: Column, negative: Column, each: int) -> DataFrame:
    """Positives against negatives of a group, the ``each`` weakest of the one and strongest of the other.

    At most ``each`` squared pairs a group, however large it is.
    """
    good = best_rows(rows.where(positive & F.col(score).isNotNull()), [group], [F.asc(score), F.col(index)], each).select(group, F.col(index).alias("winner"), F.col(score).alias("winner_score"))
    bad = best_rows(rows.where(negative & F.col(score).isNotNull()), [group], [F.desc(score), F.col(index)], each).select(group, F.col(index).alias("loser"), F.col(score).alias("loser_score"))
    return good.join(bad, group)


def sign_bands(vector: Column, bands: int, width: int) -> Column:
    """The vector's sign bits in ``bands`` words of ``width`` bits, as (band, word)."""
    bit = lambda b, i: F.when(F.get(vector, F.lit(b * width + i)) > 0, F.lit(1 << i)).otherwise(F.lit(0))
    words = [sum((bit(b, i) for i in range(1, width)), bit(b, 0)) for b in range(bands)]
    return F.array(*[F.struct(F.lit(b).alias("band"), w.alias("word")) for b, w in enumerate(words)])


def sign_neighbours(rows: DataFrame, key: str, vector: str, dims: int, bands: int, at_most: int) -> DataFrame:
    """Pairs (a, b), a < b, of distinct sign patterns that differ in at most ``at_most`` bits.

    Exact while ``at_most`` < ``bands``: patterns that close agree in a whole
    band (pigeonhole).  Equal patterns are collapsed to their smallest key
    first, so copies never multiply; ``copies`` counts them.
    """
    width = dims // bands
    banded = rows.select(key, sign_bands(F.col(vector), bands, width).alias("__bands"))
    classes = banded.groupBy("__bands").agg(F.min(key).alias("rep"), F.count("*").alias("copies"))
    parts = classes.select("rep", "copies", "__bands", F.explode("__bands").alias("b")).select("rep", "copies", "__bands", "b.*")
    other = parts.select(F.col("rep").alias("rep2"), F.col("copies").alias("copies2"), F.col("__bands").alias("__bands2"), "band", "word")
    apart = F.aggregate(F.zip_with("__bands", "__bands2", lambda x, y: F.bit_count(x["word"].bitwiseXOR(y["word"]))), F.lit(0), lambda s, x: s + x)
    pairs = parts.join(other, ["band", "word"]).where("rep < rep2").withColumn("bits", apart).where(F.col("bits") <= at_most)
    return pairs.select(F.col("rep").alias("a"), F.col("rep2").alias("b"), "bits", F.col("copies").alias("a_copies"), F.col("copies2").alias("b_copies")).distinct()
