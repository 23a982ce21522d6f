"""Aggregates of the evaluation reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.exprs import clamp, finite


def describe(rows: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """count, min, p10, p25, mean, p50, p75, p90, max, std (population) of the finite values; an empty group has count 0 and nulls."""
    x = finite(F.col(value))
    quantiles = F.percentile(x, F.array(*[F.lit(q) for q in (0.1, 0.25, 0.5, 0.75, 0.9)]))
    out = rows.groupBy(*groups).agg(F.count(x).alias("count"), F.min(x).alias("min"), F.avg(x).alias("mean"), F.max(x).alias("max"), F.stddev_pop(x).alias("std"), quantiles.alias("__q"))
    names = ("p10", "p25", "p50", "p75", "p90")
    return out.select(*groups, "count", "min", *[F.col("__q")[i].alias(n) for i, n in enumerate(names)], "mean", "max", "std")


def pearson(x: Column, y: Column) -> Column:
    """Correlation over rows where both are finite; null for fewer than two such rows or no variance."""
    both = finite(x).isNotNull() & finite(y).isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.when(F.count(a) >= 2, F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))))


def auc(rows: DataFrame, groups: Sequence[str], score: str, positive: str) -> DataFrame:
    """Probability that a positive scores above a negative, ties counting half; null if a side is empty.

    From the counts of positives and negatives at each distinct score, in score
    order: no pair is formed and a window sees one row per distinct score.
    """
    levels = rows.where(finite(F.col(score)).isNotNull() & F.col(positive).isNotNull()).groupBy(*groups, score).agg(F.sum(F.col(positive).cast("bigint")).alias("p"), F.sum((~F.col(positive)).cast("bigint")).alias("n"))
    below = Window.partitionBy(*groups).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    wins = levels.withColumn("w", F.col("p") * (F.coalesce(F.sum("n").over(below), F.lit(0)) + F.col("n") / 2.0))
    sums = wins.groupBy(*groups).agg(F.sum("w").alias("w"), F.sum("p").alias("positives"), F.sum("n").alias("negatives"))
    return sums.select(*groups, "positives", "negatives", F.try_divide(F.col("w"), F.nullif(F.col("positives") * F.col("negatives"), F.lit(0))).alias("auc"))


def geometric_mean(x: Column, low: float = 1e-6) -> Column:
    """As an aggregate: finite values held to low .. 1, 0 for none."""
    return F.coalesce(F.exp(F.avg(F.ln(clamp(finite(x), low, 1.0)))), F.lit(0.0))


def weighted_average(x: Column, weight: Column) -> Column:
    """As an aggregate: finite values with positive weights; null for none."""
    used = finite(x).isNotNull() & (weight > 0)
    return F.try_divide(F.sum(F.when(used, x * weight)), F.sum(F.when(used, weight)))


def entropy_bucket(rate: Column, low: float, high: float) -> Column:
    """What a group's success rate says about it."""
    return F.when(rate <= 0, "all_fail").when(rate >= 1, "all_pass").when(rate.between(low, high), "productive").otherwise("edge")


def first_mode(rows: DataFrame, groups: Sequence[str], value: str, position: Sequence[Column]) -> DataFrame:
    """The most common value of each group; of equally common ones the one seen first."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("n"), F.min(F.struct(*position)).alias("__first"))
    rank = Window.partitionBy(*groups).orderBy(F.desc("n"), "__first")
    return counts.withColumn("__r", F.row_number().over(rank)).where("__r = 1").select(*groups, value, "n")


def label_pair_accuracy(rows: DataFrame, group: str, label: str, score: str, apart: int = 5) -> DataFrame:
    """How often, of two rows of a group whose labels differ, the one with the higher label scores higher.

    Labels count in hundredths and scores in thousandths; ``apart`` is the least
    difference of labels in hundredths.  Rows are first counted by label and
    score, then each label of a group (there are at most 101 for labels of 0 to
    1) is held against the counts of lower labels in score order.  No pair of
    rows is formed.  Per group: pairs (equal scores left out), hits, accuracy.
    """
    used = rows.where(finite(F.col(label)).isNotNull() & finite(F.col(score)).isNotNull())
    cells = used.groupBy(group, F.round(F.col(label) * 100).cast("int").alias("l"), F.round(F.col(score) * 1000).cast("int").alias("s")).agg(F.count("*").alias("n"))
    labels = cells.groupBy(group).agg(F.array_sort(F.collect_set("l")).alias("ls"))
    against = cells.join(labels, group).withColumn("at", F.explode(F.filter("ls", lambda x: (x == F.col("l")) | (x >= F.col("l") + apart))))
    levels = against.groupBy(group, "at", "s").agg(F.sum(F.when(F.col("l") == F.col("at"), F.col("n")).otherwise(0)).alias("own"), F.sum(F.when(F.col("l") < F.col("at"), F.col("n")).otherwise(0)).alias("low"))
    below = Window.partitionBy(group, "at").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    counted = levels.withColumn("hits", F.col("own") * F.coalesce(F.sum("low").over(below), F.lit(0))).groupBy(group, "at").agg(F.sum("hits").alias("hits"), F.sum("own").alias("own"), F.sum("low").alias("low"), F.sum(F.col("own") * F.col("low")).alias("ties"))
    sums = counted.groupBy(group).agg(F.sum("hits").alias("hits"), F.sum(F.col("own") * F.col("low") - F.col("ties")).alias("pairs"))
    return sums.select(group, "pairs", "hits", F.try_divide(F.col("hits"), F.nullif(F.col("pairs"), F.lit(0))).cast("double").alias("accuracy"))
