"""Filling containers of fixed capacity with whole items."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.ranking import bin_offsets, hash_bin, hash_order
from millrace.scratch import keep

class _Gaps:
    """Containers by room left: ranges of consecutive container numbers."""

    def __init__(self) -> None:
        self.sizes: list[int] = []
        self.ranges: dict[int, list[tuple[int, int]]] = {}

    def add(self, gap: int, start: int, count: int) -> None:
        if gap <= 0 or count <= 0:
            return
        if gap not in self.ranges:
            bisect.insort(self.sizes, gap)
            self.ranges[gap] = []
        self.ranges[gap].append((start, count))

    def best(self, size: int) -> int | None:
        """The smallest room that holds ``size``."""
        i = bisect.bisect_left(self.sizes, size)
        return self.sizes[i] if i < len(self.sizes) else None

    def take(self, gap: int, want: int) -> tuple[int, int]:
        """Up to ``want`` containers with this room, as one range."""
        start, count = self.ranges[gap].pop()
        if count > want:
            self.ranges[gap].append((start + want, count - want))
            count = want
        if not self.ranges[gap]:
            del self.ranges[gap]
            self.sizes.pop(bisect.bisect_left(self.sizes, gap))
        return start, count


def plan_containers(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Packs ``counts[size]`` items of each size; sizes are 1 .. capacity.

    Returns steps (size, first item, items, first container, items a
    container), items being counted from 0 within their size, and the number
    of containers.  Items above a third of the capacity: at most two fit into
    a container; from the largest down, each is matched with the largest other
    one that still fits, or stands alone.  The rest, from the largest down, go
    where the least room is left that holds them, or into a new container.
    The work depends on the number of different sizes, not of items.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    if left and (min(left) < 1 or max(left) > capacity):
        raise ValueError("a size outside 1 .. capacity")
    used = dict.fromkeys(left, 0)
    steps: list[tuple[int, int, int, int, int]] = []
    gaps, containers = _Gaps(), 0

    def put(size: int, items: int, start: int, each: int = 1) -> None:
        steps.append((size, used[size], items, start, each))
        used[size] += items
        left[size] -= items

    large = sorted(s for s in left if 3 * s > capacity)
    lower = list(range(len(large)))  # a way down to the next size that may have items left

    def alive(i: int) -> int:
        """The largest index up to ``i`` whose size has items left, or -1."""
        way = []
        while i >= 0 and not left[large[i]]:
            way.append(i)
            i = lower[i] if lower[i] < i else i - 1
        for j in way:
            lower[j] = i
        return i

    top = len(large) - 1
    while (top := alive(top)) >= 0:
        size = large[top]
        i = alive(min(bisect.bisect_right(large, capacity - size) - 1, top))
        if i == top and left[size] < 2:
            i = alive(i - 1)
        if i < 0:
            n = left[size]
            put(size, n, containers)
            gaps.add(capacity - size, containers, n)
        elif (mate := large[i]) == size:
            n = left[size] // 2
            put(size, 2 * n, containers, 2)
            gaps.add(capacity - 2 * size, containers, n)
        else:
            n = min(left[size], left[mate])
            put(size, n, containers)
            put(mate, n, containers)
            gaps.add(capacity - size - mate, containers, n)
        containers += n
    for size in sorted((s for s in left if left[s]), reverse=True):
        while left[size]:
            gap = gaps.best(size)
            if gap is None:
                each = capacity // size
                full, rest = divmod(left[size], each)
                if full:
                    put(size, full * each, containers, each)
                    gaps.add(capacity - each * size, containers, full)
                else:
                    put(size, rest, containers, rest)
                    gaps.add(capacity - rest * size, containers, 1)
                containers += full or 1
                continue
            each = min(gap // size, left[size])
            start, n = gaps.take(gap, max(1, left[size] // each))
            put(size, n * each, start, each)
            gaps.add(gap - each * size, start, n)
    return steps, containers


def pack(items: DataFrame, limits: DataFrame, item: str, size: str, seed: int = 0) -> DataFrame:
    """The container of every item, for each limit.

    ``items``: one row per item with its whole-number ``size``; ``limits``:
    (limit_name, capacity), a bounded table.  Result: limit_name, the item,
    piece, pieces, piece_size, container.  An item above the capacity is
    split into pieces of full capacity, each alone in a container, and one of
    what remains, which is packed as an item; all others have one piece.
    An item of size 0 (or of null size) takes no room and is put with others;
    with nothing else to pack, into container 0.  Items repeated under one id
    are packed each.  No items give no rows.

    Only the number of items of each size decides the plan, so the driver plans
    on a histogram of at most ``capacity`` counters a limit (the plan of a
    capacity of 131,072 with every size in use takes seconds) and the rows look
    their container up by their rank within their size.  Ranks come from hash
    bins: any size may be held by a third of all rows.
    """
    wanted = limits.select("limit_name", F.col("capacity").cast("int")).distinct().orderBy("limit_name").collect()
    spark = items.sparkSession
    each = F.explode(F.array(*[F.struct(F.lit(r[0]).alias("limit_name"), F.lit(r[1]).alias("capacity")) for r in wanted]))
    base = items.select(F.col(item).alias("__item"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("__size"))
    order = hash_order(seed, F.col("__item").cast("string"))
    sized = base.select("__item", "__size", each.alias("limit")).select("__item", "__size", "limit.*")
    sized = sized.withColumn("__full", F.expr("greatest((__size - 1) div capacity, 0)")).withColumn("__rest", F.expr("cast(__size - __full * capacity as int)"))
    sized = sized.withColumn("__order", order).withColumn("__bin", hash_bin(F.col("__order"), 256))
    kept = keep(sized, "pack-items")
    cells = ["limit_name", "__rest"]
    offsets = keep(bin_offsets(kept.df, cells, "__bin"), "pack-bins")
    # bounded: a counter for each limit and size up to its capacity
    counts: dict[str, dict[int, int]] = {}
    for r in offsets.df.groupBy(*cells).agg(F.sum("bin_size").alias("n")).collect():
        counts.setdefault(r[0], {})[r[1]] = r[2]
    extra = {r[0]: r[1] for r in kept.df.where("__full > 0").groupBy("limit_name").agg(F.sum("__full")).collect()}
    plans, packed = {}, {}
    for name, capacity in wanted:
        steps, packed[name] = plan_containers({s: n for s, n in counts.get(name, {}).items() if s > 0}, capacity)
        by_size: dict[int, list] = {}
        for s, first, n, start, per in steps:
            by_size.setdefault(s, []).append((first, start, per))
        plans[name] = {s: tuple(np.array(x, dtype=np.int64) for x in zip(*sorted(rows), strict=True)) for s, rows in by_size.items()}
    shared = spark.sparkContext.broadcast(plans)  # at most a few steps for each size up to the capacity

    keys = [*cells, "__bin"]
    within = Window.partitionBy(*keys).orderBy("__order", "__item")
    ranked = kept.df.join(offsets.df.drop("bin_size").hint("merge"), keys).withColumn("__rank", F.col("offset") + F.row_number().over(within) - 1)

    @F.pandas_udf(T.LongType())
    def container(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for name, rest, rank in parts:
            out = np.full(len(rest), -1, dtype=np.int64)
            frame = pd.DataFrame({"name": name, "rest": rest})
            for (limit, s), index in frame.groupby(["name", "rest"], sort=False).indices.items():
                if s > 0:
                    first, start, per = shared.value[limit][s]
                    r = rank.to_numpy()[index]
                    step = np.searchsorted(first, r, side="right") - 1
                    out[index] = start[step] + (r - first[step]) // per[step]
            yield pd.Series(out)

    placed = ranked.withColumn("__container", container("limit_name", "__rest", "__rank"))
    mixed = F.create_map(*[x for r in wanted for x in (F.lit(r[0]), F.lit(packed[r[0]]))])
    total = F.create_map(*[x for r in wanted for x in (F.lit(r[0]), F.lit(packed[r[0]] + extra.get(r[0], 0)))])
    empty = F.when(total[F.col("limit_name")] > 0, F.pmod(F.col("__rank"), total[F.col("limit_name")])).otherwise(F.lit(0))
    rest = placed.select("limit_name", "__item", F.col("__full").alias("piece"), (F.col("__full") + 1).alias("pieces"), F.col("__rest").cast("bigint").alias("piece_size"), F.when(F.col("__rest") > 0, F.col("__container")).otherwise(empty).cast("bigint").alias("container"))
    # full pieces stand alone, numbered after the mixed containers in the order of hash bins
    cut = kept.df.where("__full > 0")
    before = keep(bin_offsets(cut, ["limit_name"], "__bin", F.col("__full")), "pack-cut-bins")
    running = Window.partitionBy("limit_name", "__bin").orderBy("__order", "__item").rowsBetween(Window.unboundedPreceding, -1)
    numbered = cut.join(before.df.drop("bin_size"), ["limit_name", "__bin"]).withColumn("first", mixed[F.col("limit_name")] + F.col("offset") + F.coalesce(F.sum("__full").over(running), F.lit(0)))
    pieces = numbered.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__full") - 1)))
    full = pieces.select("limit_name", "__item", "piece", (F.col("__full") + 1).alias("pieces"), F.col("capacity").cast("bigint").alias("piece_size"), (F.col("first") + F.col("piece")).cast("bigint").alias("container"))
    return rest.unionByName(full).withColumnRenamed("__item", item)
