"""The valid version of each record in a log of versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(rows: DataFrame, keys: Sequence[str], at: str, ties: Sequence[Column] | None = None) -> DataFrame:
    """One row per key: the one with the latest ``at``.

    A null ``at`` is older than any other.  Rows that tie on ``at`` are ordered
    by ``ties`` (default: a hash of all columns), so that exact copies collapse
    and the choice never depends on the order of the input.  Null keys form one
    key of their own.  ``row_number() = 1`` lets Spark cut every input
    partition to one row per key before the shuffle, so a key that holds a
    third of all rows costs no more than any other.
    """
    if ties is None:
        plain = [F.col(f"`{c}`") for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind]
        ties = [F.xxhash64(*plain)]
    rank = Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(F.col(f"`{at}`").desc_nulls_last(), *ties)
    return rows.withColumn("__rank", F.row_number().over(rank)).where("__rank = 1").drop("__rank")
