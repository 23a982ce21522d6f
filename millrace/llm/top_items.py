"""The N best items of every group, by merging sorted runs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of the files read that a bucket is meant for; sizes from here on mean that the optimizer knows none; the most buckets.
BUCKET_BYTES = 64 << 20
UNKNOWN_BYTES = 1 << 60
MOST_BUCKETS = 100_000
#: Rows of one group in progress after which its runs are merged and cut.
HELD = 50_000


class LoserTree:
    """Merges sorted runs; each internal node holds the run that lost there.

    A run is a list of keys in ascending order.  ``pop`` takes the smallest
    head of all runs with one comparison a level, ``seek`` moves every run
    past a group without visiting its items one by one.
    """

    def __init__(self, runs: Sequence[list], firsts: Sequence[list]):
        self.runs, self.firsts = runs, firsts
        self.at = [0] * len(runs)
        width = 1
        while width < len(runs):
            width *= 2
        self.width = width
        self.losers = [-1] * width
        self.heads = [run[0] if run else None for run in runs] + [None] * (width - len(runs))
        self._build()

    def _build(self) -> None:
        width, heads = self.width, self.heads
        winners = [-1] * width + list(range(width))
        for node in range(width - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            if heads[b] is None or (heads[a] is not None and heads[a] <= heads[b]):
                winners[node], self.losers[node] = a, b
            else:
                winners[node], self.losers[node] = b, a
        self.winner = winners[1] if width > 1 else 0

    def _replay(self, run: int) -> None:
        heads, losers = self.heads, self.losers
        winner, head, node = run, heads[run], (run + self.width) // 2
        while node:
            other = losers[node]
            rival = heads[other]
            if rival is not None and (head is None or rival < head):
                losers[node], winner, head = winner, other, rival
            node //= 2
        self.winner = winner

    def _advance(self, run: int, to: int) -> None:
        self.at[run] = to
        self.heads[run] = self.runs[run][to] if to < len(self.runs[run]) else None

    def pop(self):
        """(run, position) of the smallest head, or None at the end."""
        run = self.winner
        if self.heads[run] is None:
            return None
        at = self.at[run]
        self._advance(run, at + 1)
        self._replay(run)
        return run, at

    def seek(self, group: int) -> None:
        """Moves every run to its first item after ``group``."""
        while (head := self.heads[self.winner]) is not None and head[0] == group:
            run = self.winner
            self._advance(run, self.firsts[run][self.at[run]])
            self._replay(run)


def _changes(columns: Sequence[pa.ChunkedArray | pa.Array], rows: int) -> np.ndarray:
    """Where a row differs from the one before it; the first row does."""
    new = np.zeros(rows, dtype=bool)
    if rows:
        new[0] = True
    for column in columns:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        differs = pc.fill_null(pc.not_equal(column[1:], column[:-1]), True)
        both_null = pc.and_(pc.is_null(column[1:]), pc.is_null(column[:-1]))
        new[1:] |= np.asarray(pc.and_not(differs, both_null))
    return new


def _cut_runs(groups: Sequence[str], top: int):
    """Keeps the first ``top`` rows of each group of a sorted run, across its batches."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, last = 0, None
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            columns = [batch.column(g) for g in groups]
            new = _changes(columns, rows)
            head = tuple(c[0].as_py() for c in columns)
            if head != last:
                carried = 0
            starts = np.flatnonzero(new)
            place = np.arange(rows) - np.repeat(starts, np.diff(np.append(starts, rows)))
            first_end = starts[1] if len(starts) > 1 else rows
            place[:first_end] += carried
            tail = tuple(c[rows - 1].as_py() for c in columns)
            last, carried = tail, int(place[-1]) + 1
            yield batch.filter(pa.array(place < top))

    return cut


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Whole numbers that order as the column's values do; null comes first."""
    values = column.combine_chunks()
    if pa.types.is_string(values.type) or pa.types.is_large_string(values.type):
        encoded = values.dictionary_encode()
        order = pc.sort_indices(encoded.dictionary)  # strings sort by bytes
        rank = np.empty(len(encoded.dictionary), dtype=np.int64)
        rank[np.asarray(order)] = np.arange(len(rank))
        index = np.asarray(pc.fill_null(encoded.indices, -1))
        return np.where(index < 0, -1, rank[np.maximum(index, 0)] if len(rank) else -1)
    numbers = np.asarray(pc.fill_null(values.cast(pa.int64()), 0))
    _, codes = np.unique(numbers, return_inverse=True)
    return np.where(np.asarray(pc.is_null(values)), -1, codes)


def merge_table(table: pa.Table, run: str, groups: Sequence[str], order: Sequence[str], top: int) -> pa.Table:
    """The first ``top`` rows of each group with their ``rank``; the rows come by group, run and order."""
    rows = table.num_rows
    if not rows:
        return table.drop_columns([run]).append_column("rank", pa.array([], pa.int32()))
    group = np.cumsum(_changes([table.column(g) for g in groups], rows)) - 1
    keys = [_codes(table.column(c)) for c in order]
    run_of = np.asarray(table.column(run).combine_chunks())
    by_run = np.argsort(run_of, kind="stable")  # within a run the rows ascend by group and order
    runs, firsts, places = [], [], np.split(by_run, np.flatnonzero(np.diff(run_of[by_run])) + 1)
    for index in places:
        own = group[index]
        ends = np.append(np.flatnonzero(np.diff(own)) + 1, len(own))
        firsts.append(np.repeat(ends, np.diff(np.insert(ends, 0, 0))).tolist())
        runs.append(list(zip(own.tolist(), *(k[index].tolist() for k in keys), strict=True)))
    tree = LoserTree(runs, firsts)
    take, ranks, at_group, given = [], [], None, 0
    while (step := tree.pop()) is not None:
        r, at = step
        current = runs[r][at][0]
        at_group, given = (current, 1) if current != at_group else (at_group, given + 1)
        take.append(places[r][at])
        ranks.append(given)
        if given == top:
            tree.seek(at_group)
    return table.take(pa.array(take)).drop_columns([run]).append_column("rank", pa.array(ranks, pa.int32()))


def merge_stream(batches: Iterator[pa.RecordBatch], run: str, groups: Sequence[str], order: Sequence[str], top: int) -> Iterator[pa.Table]:
    """Merges a bucket batch by batch; held are one batch and the runs of the group that it ends in.

    A run has at most ``top`` rows of a group, so a group in progress is cut
    again whenever it has grown past ``HELD`` rows: what the merge of its runs
    so far leaves out can't be among its first ``top``.
    """
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        new = np.flatnonzero(_changes([table.column(g) for g in groups], table.num_rows))
        if new[-1]:
            yield merge_table(table.slice(0, int(new[-1])), run, groups, order, top)
            table = table.slice(int(new[-1]))
        if table.num_rows > HELD:
            merged = merge_table(table, run, groups, order, top).drop_columns(["rank"])
            # the survivors form a run of their own, before all that follow
            table = merged.append_column(run, pa.array(np.full(merged.num_rows, -1), table.schema.field(run).type)).select(table.column_names)
        held = table.combine_chunks()
    if held is not None:
        yield merge_table(held, run, groups, order, top)


def _buckets(items: DataFrame) -> int:
    """As many buckets as the session's shuffles have, or more where the size of the tables read needs them."""
    leaves = items._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    known = sum(n for n in sizes if n < UNKNOWN_BYTES)
    least = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(max(least, known // BUCKET_BYTES), MOST_BUCKETS)


def top_items(items: DataFrame, groups: Sequence[str], order: Sequence[str], top: int, buckets: int | None = None) -> DataFrame:
    """The first ``top`` rows of every group by ``order`` (ascending), with their ``rank``.

    ``groups`` are strings or whole numbers, ``order`` whole numbers or strings
    that make rows of a group distinct (a descending score is given as its
    negated order-preserving image); strings order by bytes, nulls come first.
    Rows that tie on everything are kept in an unspecified but harmless order;
    make them distinct first if copies shall count once.  Null group keys form
    a group.  An empty table gives no rows; other columns are carried along.

    Every input partition becomes a run, sorted by group and order and cut to
    ``top`` rows a group.  The shuffle stores the runs by bucket, in the order
    of group, run and rank (a sort that spills); how many buckets follows from
    the size of the tables read.  One task a bucket reads them as a stream,
    merges the runs of the groups in a batch with a loser tree and after ``top``
    rows seeks every run to the next group.  A task holds one batch and the
    group it ends in, whatever the size of its bucket, and a group of any size
    sends at most ``top`` rows a run to its bucket.
    """
    buckets = buckets or _buckets(items)
    names = list(items.columns)
    runs = items.sortWithinPartitions(*groups, *order)
    cut = runs.mapInArrow(_cut_runs(groups, top), runs.schema).withColumn("__run", F.spark_partition_id())
    stored = cut.repartition(buckets, *groups).sortWithinPartitions(*groups, "__run", *order)
    schema = T.StructType([*items.schema.fields, T.StructField("rank", T.IntegerType())])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for merged in merge_stream(batches, "__run", groups, order, top):
            yield from merged.select([*names, "rank"]).to_batches(max_chunksize=20_000)

    return stored.mapInArrow(merge, schema)
