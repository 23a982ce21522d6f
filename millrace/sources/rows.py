"""A Python data source: records of a remote or generated set, read shard by shard."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Shard(InputPartition):
    def __init__(self, number: int, first: int, after: int):
        self.number, self.first, self.after = number, first, after


class ShardReader(DataSourceReader):
    """Splits ``total`` records into ``shards``, leaving out the first ``skip`` and stopping at ``limit``."""

    def __init__(self, options: dict):
        self.skip = int(options.get("skip", 0))
        total = int(options.get("total", 0))
        limit = int(options.get("limit", total))
        self.after = min(total, self.skip + limit)
        self.shards = max(1, int(options.get("shards", 4)))
        self.name = options.get("name", "set")

    def partitions(self) -> list[InputPartition]:
        step = -(-(self.after - self.skip) // self.shards) if self.after > self.skip else 0
        return [Shard(i, self.skip + i * step, min(self.after, self.skip + (i + 1) * step)) for i in range(self.shards)] if step else [Shard(0, 0, 0)]

    def read(self, partition: Shard) -> Iterator[tuple]:
        for n in range(partition.first, partition.after):
            yield f"{self.name}-{n:08d}", n, partition.number


class RecordSet(DataSource):
    """Format ``record_set``: a stand-in for a remote set; subclass and override the reader for a real one."""

    @classmethod
    def name(cls) -> str:
        return "record_set"

    def schema(self) -> str:
        return "key string, position long, shard int"

    def reader(self, schema) -> ShardReader:
        return ShardReader(self.options)
