"""The candidate log as a stream: upserts, completed groups, live metrics, controller state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.scratch import new_path


def stream_of(spark: SparkSession, path: str, files_per_batch: int = 4) -> DataFrame:
    """A folder of parquet files as a stream."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_available(query_name: str, stream: DataFrame, each: Callable[[DataFrame, int], None]) -> None:
    """Runs a stream over what is there and ends; ``each`` must be idempotent by batch number."""
    spark = stream.sparkSession
    writer = stream.writeStream.queryName(query_name).trigger(availableNow=True).option("checkpointLocation", new_path(spark, f"stream-{query_name}"))
    writer.foreachBatch(each).start().awaitTermination()


def merge_latest(state: DataFrame | None, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key of the state and a batch."""
    both = batch if state is None else state.unionByName(batch)
    best = F.max_by(F.struct(*both.columns), F.struct(*order))
    return both.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(best.alias("r")).select("r.*")


class LatestTable:
    """A table of the last row per key, kept as written generations; a repeated batch changes nothing."""

    def __init__(self, spark: SparkSession, keys: list[str], order: list[str]):
        self.spark, self.keys, self.order = spark, keys, order
        self.path, self.batch = new_path(spark, "latest"), -1

    def __call__(self, rows: DataFrame, batch: int) -> None:
        if batch <= self.batch:
            return
        merged = merge_latest(self.read(), rows, self.keys, self.order)
        merged.write.mode("overwrite").parquet(f"{self.path}/{batch:06d}")
        self.batch = batch

    def read(self) -> DataFrame | None:
        return None if self.batch < 0 else self.spark.read.parquet(f"{self.path}/{self.batch:06d}")


def level_controller(values: DataFrame, key: str, order: str, value: str, start: int, low: float, high: float, least: int, most: int) -> DataFrame:
    """A level per key that steps with each value and lives on in the stream's state."""

    def step(own: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, seen = state.get if state.exists else (start, 0)
        for v in pd.concat(list(parts)).sort_values(order)[value].dropna():
            level = min(max(level + (1 if v >= high else -1 if v < low else 0), least), most)
            seen += 1
        state.update((int(level), int(seen)))
        yield pd.DataFrame({key: [own[0]], "level": [int(level)], "seen": [int(seen)]})

    kind = dict(values.dtypes)[key]
    return values.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, level int, seen int", "level int, seen int", "update", GroupStateTimeout.NoTimeout)
