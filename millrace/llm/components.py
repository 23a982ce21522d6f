"""Connected components by hooking and pointer jumping, and the ties they come from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.lookup import hot_join
from millrace.scratch import Kept, keep

#: The holders of one value are first tied within this many parts, then part to part.
PARTS = 64


def star_edges(holders: DataFrame) -> DataFrame:
    """Edges (u, v), u > v, that tie all nodes holding the same value.

    ``holders``: (value, node).  Nodes are linked to the smallest node of their
    part of the value's holders, and the parts' smallest nodes to the smallest
    of all: one edge a holder, never a pair of every two, and a value that a
    third of all nodes hold spreads over ``PARTS`` tasks.
    """
    part = F.pmod(F.xxhash64("node"), F.lit(PARTS)).cast("int")
    placed = holders.where("value is not null and node is not null").withColumn("part", part).repartition("value", "part").dropDuplicates(["value", "part", "node"])
    hubs = placed.withColumn("hub", F.min("node").over(Window.partitionBy("value", "part")))
    inner = hubs.where("node != hub").select(F.col("node").alias("u"), F.col("hub").alias("v"))
    tops = hubs.where("node = hub").withColumn("top", F.min("node").over(Window.partitionBy("value")))
    outer = tops.where("node != top").select(F.col("node").alias("u"), F.col("top").alias("v"))
    return inner.unionByName(outer)


def _jump(links: Kept) -> Kept:
    """Points every node of a forest (node, up) at its root."""
    while True:
        above = links.df.select(F.col("node").alias("up"), F.col("up").alias("up2"))
        n = links.count()  # a large tree has most of its nodes under one root
        once = hot_join(links.df, above, "up", n, n, "left").select("node", F.coalesce("up2", "up").alias("up"), F.col("up2").isNotNull().alias("moved"))
        moved = keep(once, "jump")
        links.drop()
        links = Kept.__new__(Kept)
        links.spark, links.path, links.df = moved.spark, moved.path, moved.df.select("node", "up")
        if not moved.df.where("moved").limit(1).count():
            return links


def components(edges: DataFrame) -> Kept:
    """(node, root) for every node that isn't the smallest of its component.

    ``edges``: (u, v) in any order and number; loops and nulls are ignored.
    Each round every node that has a smaller neighbour hooks to the smallest
    one, the trees are flattened by pointer jumping, and the edges are
    contracted to roots.  The edges left shrink with every round.
    """
    u, v = F.col("u"), F.col("v")
    left = keep(edges.where("u != v").select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "edges")
    found: Kept | None = None
    while left.df.limit(1).count():
        hooked = keep(left.df.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("up")), "hooks")
        roots = _jump(hooked)
        ru = roots.df.select(F.col("node").alias("u"), F.col("up").alias("ru"))
        rv = roots.df.select(F.col("node").alias("v"), F.col("up").alias("rv"))
        n_edges, n_roots = left.count(), roots.count()
        lower = hot_join(left.df, ru, "u", n_edges, n_roots).select("ru", "v")
        moved = hot_join(lower, rv, "v", n_edges, n_roots, "left").select(F.col("ru").alias("a"), F.coalesce("rv", "v").alias("b")).where("a != b")
        contracted = keep(moved.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
        if found is None:
            merged = keep(roots.df.select("node", F.col("up").alias("root")), "roots")
        else:
            up = roots.df.select(F.col("node").alias("root"), "up")
            older = hot_join(found.df, up, "root", found.count(), n_roots, "left").select("node", F.coalesce("up", "root").alias("root"))
            merged = keep(older.unionByName(roots.df.select("node", F.col("up").alias("root"))), "roots")
            found.drop()
        roots.drop()
        left.drop()
        found, left = merged, contracted
    left.drop()
    if found is None:
        found = keep(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).limit(0), "roots")
    return found
