"""Named strategies, an overridable stage and calls to outside services."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Strategies:
    """Builders by name, with aliases for older names."""

    def __init__(self, kind: str):
        self.kind = kind
        self.known: dict[str, Callable] = {}
        self.aliases: dict[str, str] = {}

    def add(self, name: str, *older: str) -> Callable[[Callable], Callable]:
        def keep(f: Callable) -> Callable:
            self.known[name] = f
            self.aliases.update(dict.fromkeys(older, name))
            return f

        return keep

    def __getitem__(self, name: str) -> Callable:
        name = self.aliases.get(name, name)
        if name not in self.known:
            raise ValueError(f"no {self.kind} named {name}; there are {', '.join(sorted(self.known))}")
        return self.known[name]


def staged(rows: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame] | None]]) -> DataFrame:
    """Runs the stages in order; one that is None is left out."""
    for _, stage in stages:
        rows = rows if stage is None else stage(rows)
    return rows


def called(rows: DataFrame, key: str, given: str, call: Callable[[str], str], cache: DataFrame | None = None, tries: int = 3, pause: float = 0.0) -> DataFrame:
    """(key, answer, error) of an outside call per row; answers in the ``cache`` (key, answer) aren't asked again.

    Calls run in the executors, a batch of rows at a time.  A call that fails is
    tried again; after the last try its row has the error and no answer, so one
    bad row doesn't end the job.  A retried task asks again: ``call`` must bear that.
    """
    todo = rows.select(key, given)
    if cache is not None:
        todo = todo.join(cache.where(F.col("answer").isNotNull()).select(key), key, "left_anti")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers, errors = [], []
            for value in batch[given]:
                answer = error = None
                for n in range(tries):
                    try:
                        answer, error = call(value), None
                        break
                    except Exception as e:  # reported in the row
                        error = f"{type(e).__name__}: {e}"
                        time.sleep(pause * 2**n)
                answers.append(answer)
                errors.append(error)
            yield pd.DataFrame({key: batch[key], "answer": answers, "error": errors})

    fresh = todo.mapInPandas(ask, f"`{key}` {dict(rows.dtypes)[key]}, answer string, error string")
    if cache is None:
        return fresh
    known = rows.select(key).join(cache.where(F.col("answer").isNotNull()).select(key, "answer"), key)
    return fresh.unionByName(known.withColumn("error", F.lit(None).cast("string")))
