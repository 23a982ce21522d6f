from __future__ import annotations

import random
from collections import Counter, defaultdict

from millrace.llm.components import components, star_edges
from millrace.llm.group_splits import QUARANTINE, ComponentStore, splits, tied_keys, update_components

TARGETS = [("train", 80), ("validation", 8), ("test", 12)]


def brute(rows):
    up: dict[str, str] = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    held = defaultdict(list)
    for key, values in rows:
        if key is not None:
            root(key)
            for v in values or []:
                if v is not None:
                    held[v].append(key)
    for own in held.values():
        for k in own[1:]:
            a, b = sorted((root(own[0]), root(k)))
            up[b] = a
    return {k: root(k) for k in up}


def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, values array<string>")


def targets(spark):
    return spark.createDataFrame(TARGETS, "split_name string, target_pct int")


def test_components_of_a_long_chain(spark):
    names = [f"n{i * 7919 % 1009:04d}" for i in range(300)]
    found = components(spark.createDataFrame([*zip(names, names[1:]), ("x", "x"), (names[1], names[0])], "u string, v string"))
    assert {(r.node, r.root) for r in found.df.collect()} == {(n, min(names)) for n in names if n != min(names)}


def test_star_edges_stay_linear(spark):
    held = spark.createDataFrame([("hot", f"k{i:05d}") for i in range(2000)] + [(None, "k1"), ("solo", "k1"), ("hot", None)], "value string, node string")
    assert star_edges(held).count() == 1999


def test_ties_match_union_find(spark):
    rng = random.Random(4)
    rows = [(f"k{i}", [rng.choice([None, "hot", f"v{rng.randint(0, 400)}", f"v{rng.randint(0, 400)}"]) for _ in range(rng.randint(0, 3))]) for i in range(500)]
    rows += [(None, ["hot"]), ("k3", None), rows[0], ("", ["v1"])]
    store = ComponentStore.fresh(spark)
    update_components(store, frame(spark, rows), None)
    want = brute(rows)
    assert {(r.root_key, r.key) for r in tied_keys(store).collect()} == {(r, k) for k, r in want.items() if r != k}
    assert sorted(r.key for r in splits(store).collect()) == sorted(want)


def test_splits_keep_shares_and_generations(spark):
    rng = random.Random(6)
    first = [(f"k{i}", [f"v{rng.randint(0, 1500)}"]) for i in range(3000)]
    later = [(f"m{i}", [f"v{rng.randint(0, 3000)}"]) for i in range(1500)] + first[:5]
    store = ComponentStore.fresh(spark)
    update_components(store, frame(spark, first), targets(spark))
    before = {r.key: r.split for r in splits(store).collect()}
    update_components(store, frame(spark, later), targets(spark))
    after = {r.key: (r.root_key, r.split) for r in splits(store).collect()}
    assert {k: after[k][1] for k in before} == before
    want = brute(first + later)
    assert {k: r for k, (r, _) in after.items()} == want
    by_root = defaultdict(set)
    for k, (r, s) in after.items():
        by_root[r].add(s)
    assert all(len(s - {QUARANTINE}) == 1 for s in by_root.values())  # one value a key: nothing can conflict
    shares = Counter(s for _, s in after.values())
    for name, pct in TARGETS:
        assert abs(shares[name] / len(after) - pct / 100) < 0.02


def test_conflicting_merge_is_quarantined(spark):
    rows = [(f"k{i}", [f"v{i}"]) for i in range(400)]
    store = ComponentStore.fresh(spark)
    update_components(store, frame(spark, rows), targets(spark))
    before = {r.key: r.split for r in splits(store).collect()}
    train = next(k for k, s in sorted(before.items()) if s == "train")
    test = next(k for k, s in sorted(before.items()) if s == "test")
    bridge = [("bridge", [f"v{train[1:]}", f"v{test[1:]}"]), ("follower", [f"v{train[1:]}"]), (train, ["w"]), ("grown", ["w2"])]
    update_components(store, frame(spark, bridge), targets(spark))
    update_components(store, frame(spark, [("late", ["w"])]), targets(spark))
    after = {r.key: r for r in splits(store).collect()}
    assert {k: after[k].split for k in before} == before
    assert after["bridge"].split == after["follower"].split == after["late"].split == QUARANTINE
    assert len({after[k].root_key for k in (train, test, "bridge", "follower", "late")}) == 1
    assert after["grown"].split in {"train", "test", "validation"}


def test_empty(spark):
    store = ComponentStore.fresh(spark)
    update_components(store, frame(spark, []), targets(spark))
    assert splits(store).count() == 0 and tied_keys(store).count() == 0


def test_a_store_opened_by_path_goes_on(spark, tmp_path):
    rng = random.Random(8)
    parts = [[(f"{g}{i}", [f"v{rng.randint(0, 900)}", f"w{rng.randint(0, 900)}"]) for i in range(150)] for g in "zma"]
    kept: dict[str, str] = {}
    for n, part in enumerate(parts):
        store = ComponentStore(spark, str(tmp_path / "store"))
        assert store.generation == n
        update_components(store, frame(spark, part), targets(spark))
        # a later update that fails leaves no marker and no trace
        (tmp_path / "store" / f"{n + 2:06d}" / "keys").mkdir(parents=True)
        now = {r.key: r for r in splits(ComponentStore(spark, str(tmp_path / "store"))).collect()}
        assert {k: now[k].split for k in kept} == kept
        assert {k: r.root_key for k, r in now.items()} == brute([row for done in parts[: n + 1] for row in done])
        kept = {k: r.split for k, r in now.items()}
        added = spark.read.parquet(str(tmp_path / "store" / f"{n + 1:06d}" / "keys")).count()
        assert added == len(part)  # earlier keys aren't written again
    values = {r.value: r.root_key for r in ComponentStore(spark, str(tmp_path / "store")).values().collect()}
    want = brute([row for part in parts for row in part])
    assert values == {v: want[k] for part in parts for k, own in part for v in own}
