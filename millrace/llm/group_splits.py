"""Train, validation and test splits that keep tied records together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.components import components, star_edges
from millrace.operators.lookup import hot_join
from millrace.scratch import Kept, children, exists, keep, new_path, touch

#: Components above this share of all keys are placed one by one; there are at most as many as fit into 1.
LARGE_SHARE = 1 / 2000
#: The others go to splits by the bin of their root's hash.
BINS = 4096
#: More splits than this is an error.
SPLIT_ROWS = 1000
QUARANTINE = "quarantine"

TABLES = {"keys": "key string, node string, split string, generation int", "values": "value string, node string", "roots": "node string, root_key string"}
COMMITTED = "_COMMITTED"


class ComponentStore:
    """The persisted component table: generations under one folder, each committed by a marker.

    A generation adds the rows of its new keys and values (``keys``,
    ``values``), with the root they had when they came; what is there is never
    written again.  ``roots`` tells which of those roots have been tied to a
    smaller one since; it alone is rewritten, and holds a row per root that
    lost its place, not per key.  A store opened by its path continues after
    the last committed generation; what a failed update left is overwritten.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        done = [name for name in children(spark, self.path) if name.isdigit() and exists(spark, f"{self.path}/{name}/{COMMITTED}")]
        self.generation = max((int(name) for name in done), default=0)

    @classmethod
    def fresh(cls, spark: SparkSession) -> ComponentStore:
        """A store in the scratch folder, which ends with the session; open one by path to keep it."""
        return cls(spark, new_path(spark, "component-store"))

    def _read(self, name: str, generations: range) -> DataFrame:
        paths = [f"{self.path}/{g:06d}/{name}" for g in generations]
        return self.spark.read.schema(TABLES[name]).parquet(*paths) if paths else self.spark.createDataFrame([], TABLES[name])

    def _with_roots(self, rows: DataFrame) -> DataFrame:
        roots = self._read("roots", range(self.generation, self.generation + 1) if self.generation else range(0))
        found = hot_join(rows, roots, "node", rows.count(), roots.count(), "left") if self.generation > 1 else rows.withColumn("root_key", F.lit(None).cast("string"))
        return found.withColumn("root_key", F.coalesce("root_key", "node")).drop("node")

    def keys(self) -> DataFrame:
        """key, split, generation (in which it came) and root_key, the smallest key of its tied set."""
        return self._with_roots(self._read("keys", range(1, self.generation + 1)))

    def values(self) -> DataFrame:
        """value and root_key, the smallest key of the set that it ties."""
        return self._with_roots(self._read("values", range(1, self.generation + 1)))

    def roots(self) -> DataFrame:
        return self._read("roots", range(self.generation, self.generation + 1) if self.generation else range(0))

    def commit(self, keys: DataFrame, values: DataFrame, roots: DataFrame) -> None:
        after = f"{self.path}/{self.generation + 1:06d}"
        keys.select("key", "node", "split", "generation").write.mode("overwrite").parquet(f"{after}/keys")
        values.select("value", "node").write.mode("overwrite").parquet(f"{after}/values")
        roots.select("node", "root_key").write.mode("overwrite").parquet(f"{after}/roots")
        touch(self.spark, f"{after}/{COMMITTED}")
        self.generation += 1


def place_large(sizes: list[tuple[str, int]], wanted: dict[str, float], filled: dict[str, int]) -> dict[str, str]:
    """Each component, largest first, to the split that lacks the most."""
    lack = {s: wanted[s] - filled.get(s, 0) for s in wanted}
    placed = {}
    for root, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        split = max(lack, key=lambda s: (lack[s], s))
        placed[root] = split
        lack[split] -= n
    return placed


def update_components(store: ComponentStore, keyed: DataFrame, targets: DataFrame | None, seed: int = 0) -> None:
    """Adds keys and what ties them, and gives every new component a split.

    ``keyed``: (key, values): a key and the array of values it holds; two keys
    that share a value are tied, and ties carry over.  A key may come several
    times, now or in later generations.  ``targets``: (split_name, target_pct),
    or None if only the components are wanted.

    Keys already in the store keep their split.  A component with no earlier
    key gets a split: the largest ones go one by one to the split that lacks
    the most keys, the rest by the hash of their root to bins that fill what is
    lacking.  A component that has grown gives its split to its new keys.  If
    new keys tie components of different splits, the earlier keys keep theirs
    and the new keys that did it are quarantined, in no split: whichever split
    they were put in would leak into another.

    Null keys and null values are ignored; no rows leave the store as it was,
    one generation on.
    """
    spark = store.spark
    rows = keep(keyed.where("key is not null"), "split-keys")
    holders = rows.df.select("key", F.explode("values").alias("value")).where("value is not null").select("value", F.col("key").alias("node"))
    links, fresh, new_values = holders, rows.df.select("key").distinct(), holders.groupBy("value").agg(F.min("node").alias("node"))
    old_keys = spent = None
    if store.generation:
        old_keys, old_values = store.keys(), store.values()
        known = old_keys.select("key", "root_key").join(fresh, "key", "left_semi")
        touched = keep(old_values.join(new_values.select("value"), "value", "left_semi"), "split-touched")
        # an earlier key or value stands for its component's root, tied through a value of its own
        own = known.select(F.concat(F.lit("\u0000"), "root_key").alias("value"), F.col("key").alias("node"))
        roots = own.select("value").distinct().select("value", F.substring("value", 2, 2**31 - 1).alias("node"))
        links = links.unionByName(own).unionByName(roots).unionByName(touched.df.select("value", F.col("root_key").alias("node")))
        fresh = fresh.join(old_keys.select("key"), "key", "left_anti")
        new_values = new_values.join(touched.df.select("value"), "value", "left_anti")
        spent = touched
    found = components(star_edges(links))
    n_found = found.count()
    fresh, new_values = keep(fresh, "split-fresh"), keep(new_values, "split-values")

    def rooted(table: Kept) -> DataFrame:
        joined = hot_join(table.df, found.df, "node", table.count(), n_found, "left")
        return joined.withColumn("node", F.coalesce("root", "node")).drop("root")

    added = keep(rooted(keep(fresh.df.withColumn("node", F.col("key")), "split-nodes")).withColumn("split", F.lit(None).cast("string")).withColumn("generation", F.lit(store.generation + 1)), "split-placed")
    # roots that were tied to a smaller one, now or in an earlier generation
    merged = None
    if store.generation:
        moved = found.df.join(old_keys.select(F.col("root_key").alias("node")).distinct(), "node", "left_semi").select("node", F.col("root").alias("root_key"))
        earlier = store.roots()
        again = hot_join(earlier.select(F.col("node").alias("from"), F.col("root_key").alias("node")), found.df, "node", earlier.count(), n_found, "left")
        merged = keep(again.select(F.col("from").alias("node"), F.coalesce("root", "node").alias("root_key")).unionByName(moved), "split-roots")
    roots_now = merged.df if merged else spark.createDataFrame([], TABLES["roots"])
    after = added.df
    if targets is not None:
        after = _assign(store, old_keys, added, found.df, n_found, targets, seed)
    store.commit(after, rooted(new_values), roots_now)
    for one in (rows, found, added, fresh, new_values, spent, merged):
        if one is not None:
            one.drop()


def _assign(store: ComponentStore, old_keys: DataFrame | None, added: Kept, found: DataFrame, n_found: int, targets: DataFrame, seed: int) -> DataFrame:
    """``added`` with the split of every new key."""
    spark = store.spark
    wanted = targets.select("split_name", F.col("target_pct").cast("double")).orderBy("split_name").limit(SPLIT_ROWS + 1).collect()
    if len(wanted) > SPLIT_ROWS:
        raise ValueError(f"more than {SPLIT_ROWS} splits")
    whole = sum(r[1] for r in wanted)
    split = F.when(F.col("split") != QUARANTINE, F.col("split"))
    per_new = added.df.groupBy(F.col("node").alias("root_key")).agg(F.count("*").alias("n"))
    filled: dict[str, int] = {}
    if old_keys is None:
        sized = per_new.withColumn("low", F.lit(None).cast("string")).withColumn("high", F.lit(None).cast("string"))
    else:
        filled = {r[0]: r[1] for r in old_keys.groupBy("split").count().collect()}
        # the splits that the tied earlier components have: one row an earlier root
        before = old_keys.groupBy(F.col("root_key").alias("node")).agg(F.min(split).alias("low"), F.max(split).alias("high"))
        now = before.join(found, "node", "left").groupBy(F.coalesce("root", "node").alias("root_key")).agg(F.min("low").alias("low"), F.max("high").alias("high"))
        sized = per_new.join(now, "root_key", "left")
    total = added.count() + sum(filled.values())
    goal = {r[0]: r[1] / whole * total for r in wanted}
    sizes = keep(sized, "split-sizes")
    # new keys of a component whose earlier keys agree take its split; where they disagree, quarantine
    has_old = F.col("low").isNotNull()
    inherited = F.when(has_old, F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.lit(QUARANTINE)))
    for r in sizes.df.where(has_old).groupBy(inherited.alias("split")).agg(F.sum("n")).collect():
        filled[r[0]] = filled.get(r[0], 0) + r[1]
    new = sizes.df.where(~has_old)
    # at most 1 / LARGE_SHARE components can be this large
    large = [(r[0], r[1]) for r in new.where(F.col("n") > max(1.0, LARGE_SHARE * total)).select("root_key", "n").collect()]
    placed = place_large(large, goal, filled)
    for root, n in large:
        filled[placed[root]] = filled.get(placed[root], 0) + n
    bin_of = F.pmod(F.xxhash64("root_key", F.lit(seed)), F.lit(BINS)).cast("int")
    small = new.where(~(F.col("n") > max(1.0, LARGE_SHARE * total)))
    bins = {r[0]: r[1] for r in small.groupBy(bin_of.alias("bin")).agg(F.sum("n")).collect()}
    by_bin = fill_bins(bins, {s: goal[s] - filled.get(s, 0) for s in goal})
    names = F.array(*[F.lit(s) for s in by_bin])
    chosen = F.element_at(names, bin_of + 1)
    if placed:
        table = spark.createDataFrame(sorted(placed.items()), "root_key string, forced string")
        sized = sizes.df.join(F.broadcast(table), "root_key", "left")
    else:
        sized = sizes.df.withColumn("forced", F.lit(None).cast("string"))
    per_root = sized.select(F.col("root_key").alias("node"), F.coalesce(inherited, "forced", chosen).alias("given"))
    placed_keys = hot_join(added.df, per_root, "node", added.count(), sizes.count())
    return placed_keys.withColumn("split", F.col("given")).drop("given")


def fill_bins(sizes: dict[int, int], lacking: dict[str, float]) -> list[str]:
    """A split for each bin: bins go in order, each to the split whose lack it fills best."""
    lack = dict(lacking)
    out = []
    for b in range(BINS):
        split = max(lack, key=lambda s: (lack[s], s))
        out.append(split)
        lack[split] -= sizes.get(b, 0)
    return out


def tied_keys(store: ComponentStore) -> DataFrame:
    """(root_key, key) of each key that isn't the smallest of its tied set."""
    return store.keys().where("key != root_key").select("root_key", "key")


def splits(store: ComponentStore) -> DataFrame:
    return store.keys().select("key", "root_key", "split")
