"""Joins, selection, folds and streams against plain Python on small tables."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from millrace.operators.folds import cycled, ordered_values, relative_scores, smoothed, stepped_level
from millrace.operators.joins import best_against_rest, fallback_join, hardest_pairs, sign_neighbours
from millrace.operators.lookup import lookup_join, sized_join
from millrace.operators.selection import greedy_selection, quota_then_backfill, ranked_whole, seeded_sample
from millrace.operators.sets import ordered_distinct, overlay, replay
from millrace.operators.stats import auc, describe, first_mode
from millrace.streaming.log import LatestTable, run_available, stream_of


def test_lookup_join_both_ways(spark):
    big = spark.range(2000).select(F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id") % 7).cast("int").alias("k"), "id")
    small = spark.createDataFrame([(i, i * 10) for i in range(5)], "k int, v int")
    for how in ("inner", "left"):
        a = lookup_join(big, small, ["k"], 5, F.col("id"), how)
        b = lookup_join(big, small, ["k"], 5, F.col("id"), how, broadcast_rows=0)
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_sized_join_repeats_only_hot_keys(spark):
    big = spark.range(300).selectExpr("id", "if(id < 200, 0, id % 11) as k", "'own' as size")
    small = spark.range(12).selectExpr("id as k", "id * 10 as v").join(big.groupBy("k").agg(F.count("*").alias("size")), "k")
    expected = [(i, k, k * 10) for i in range(300) for k in [0 if i < 200 else i % 11]]
    for broadcast_rows, hot_rows, repeats in ((50, 1000, False), (0, 1000, False), (0, 99, True), (0, 5, True)):
        got = sized_join(big, small, ["k"], 11, F.col("id"), "size", 209, 300, broadcast_rows, hot_rows)
        assert got.columns == ["k", "id", "size", "v", "size"]
        assert sorted(map(tuple, got.select("id", "k", "v").collect())) == expected
        assert ("Generate" in got._jdf.queryExecution().executedPlan().toString()) == repeats


def test_fallback_join_keeps_rows(spark):
    left = spark.createDataFrame([("a", "x"), ("b", "y"), (None, "x"), ("c", None)], "k string, p string")
    right = spark.createDataFrame([("a", "q", 1), ("a", "q", 2), (None, "x", 3), ("z", "y", 4)], "rk string, rp string, v int")
    out = fallback_join(left, right, ("k", "rk"), ("p", "rp"), ["v"], [F.desc("v")]).collect()
    assert sorted((r.k or "", r.v, r.matched_by) for r in out if r.v) == [("", 3, "second"), ("a", 2, "key"), ("b", 4, "second")] and len(out) == 4


def test_pairs(spark):
    rng = random.Random(2)
    rows = [(g, i, round(rng.random(), 2), rng.random() < 0.4) for g in "abc" for i in range(30)] + [("one", 0, 0.5, True), ("none", 0, None, True)]
    df = spark.createDataFrame(rows, "g string, i int, s double, ok boolean")
    got = {(r.g, r.winner, r.loser) for r in best_against_rest(df, "g", "i", "s", F.col("ok"), 0.1, 4).collect()}
    want = set()
    for g in "abc":
        own = [r for r in rows if r[0] == g]
        w = min((r for r in own if r[3]), key=lambda r: (-r[2], r[1]))
        lose = sorted((r for r in own if r[1] != w[1] and w[2] - r[2] >= 0.1), key=lambda r: (-r[2], r[1]))[:4]
        want |= {(g, w[1], r[1]) for r in lose}
    assert got == want
    assert hardest_pairs(df, "g", "i", "s", F.col("ok"), ~F.col("ok"), 3).count() == 27


def test_sign_neighbours_lose_no_pair(spark):
    rng = random.Random(3)
    base = [[rng.choice([-1.0, 1.0]) for _ in range(64)] for _ in range(30)]
    rows = [(i, [x if rng.random() > 0.06 else -x for x in rng.choice(base)]) for i in range(200)] + [(500, base[0]), (501, base[0])]
    got = {(r.a, r.b): r.bits for r in sign_neighbours(spark.createDataFrame(rows, "k int, v array<double>"), "k", "v", 64, 8, 7).collect()}
    reps = {}
    for k, v in rows:
        reps.setdefault(tuple(x > 0 for x in v), k)
    want = {}
    for p, a in reps.items():
        for q, b in reps.items():
            d = sum(x != y for x, y in zip(p, q))
            if a < b and d <= 7:
                want[(a, b)] = d
    assert got == want


def test_selection(spark):
    rows = spark.createDataFrame([(i, f"s{i % 4}", f"g{i % 11}", float(i * 7919 % 101), i * 31) for i in range(300)], "k int, s string, g string, x double, bits long")
    assert [r["rank"] for r in ranked_whole(rows.select("k", F.xxhash64("k").alias("h")), F.col("h"), "k").orderBy("h").collect()] == list(range(1, 301))
    one, two = (seeded_sample(rows, "k", 20, s).select("k").collect() for s in (1, 2))
    assert len(one) == 20 and one != two and sorted(one) == sorted(seeded_sample(rows.repartition(7), "k", 20, 1).select("k").collect())
    picked = quota_then_backfill(rows, "s", "k", "x", 5, 30).collect()
    assert len(picked) == 30 and sum(r.within_quota for r in picked) == 20
    got = greedy_selection(rows, "k", [F.desc("x"), F.col("k")], "g", 2, 5, "s", "bits", 2, 15).collect()
    seen, by_g, by_s, want = [], {}, {}, []
    for r in sorted(rows.collect(), key=lambda r: (-r.x, r.k)):
        if len(want) >= 15 or by_g.get(r.g, 0) >= 2 or by_s.get(r.s, 0) >= 5 or any((r.bits ^ b).bit_count() < 2 for b in seen):
            continue
        seen.append(r.bits)
        by_g[r.g], by_s[r.s] = by_g.get(r.g, 0) + 1, by_s.get(r.s, 0) + 1
        want.append(r.k)
    assert sorted(r.k for r in got) == sorted(want)
    assert greedy_selection(rows.limit(0), "k", [F.col("k")], "g", 2, 5, "s", None, 0, 15).count() == 0


def greedy_by_hand(rows, per_group, per_stratum, least_distance, total):
    seen, by_g, by_s, want = [], Counter(), Counter(), []
    for r in sorted(rows, key=lambda r: (-r[3], r[0])):
        k, s, g, _, bits = r
        if len(want) >= total or by_g[g] >= per_group or by_s[s] >= per_stratum:
            continue
        if bits is not None:
            if any(((bits ^ b) & (1 << 64) - 1).bit_count() < least_distance for b in seen):
                continue
            seen.append(bits)
        by_g[g] += 1
        by_s[s] += 1
        want.append(k)
    return want


def test_greedy_selection_reaches_past_a_dominant_source(spark):
    rng = random.Random(4)
    schema = "k int, s string, g string, x double, bits long"
    # one source, and one pattern with its neighbours, holds the best rows of every stratum
    table = []
    for i in range(900):
        best = i < 400
        table.append((i, f"s{i % 3}", "hot" if best else rng.choice([None, *(f"g{j}" for j in range(60))]), float(1000 - i), 1 << i % 2 if best else rng.choice([None, rng.getrandbits(64) - (1 << 63)])))
    rows = spark.createDataFrame(table, schema).repartition(5)
    for bits, over_fetch in ((None, 8), ("bits", 8), ("bits", 1)):
        got = greedy_selection(rows, "k", [F.desc("x"), F.col("k")], "g", 2, 5, "s", bits, 6, 14, over_fetch).collect()
        want = greedy_by_hand([r if bits else (*r[:4], None) for r in table], 2, 5, 6, 14)
        assert sorted(r.k for r in got) == sorted(want) and len(want) == 14
    one_each = spark.createDataFrame([(k, s, f"own{k}", x, b) for k, s, _, x, b in table], schema)
    got = greedy_selection(one_each, "k", [F.desc("x"), F.col("k")], "g", 1, 5, "s", "bits", 6, 14, 1).collect()
    assert sorted(r.k for r in got) == sorted(greedy_by_hand([(k, s, k, x, b) for k, s, _, x, b in table], 1, 5, 6, 14)) and len(got) == 14


def test_folds(spark):
    rows = spark.createDataFrame([("a", 2, 20.0), ("a", 1, 10.0), ("a", 3, 0.0), ("b", 1, None), ("c", 1, 5.0)], "g string, o int, v double")
    out = {r.g: (r.e, r.l) for r in ordered_values(rows, ["g"], "o", "v").select("g", smoothed(F.col("rounds"), 0.4).alias("e"), stepped_level(F.col("rounds"), 2, 5.0, 10.0, 1, 3).alias("l")).collect()}
    assert out["a"] == (8.4, 2) and out["b"] == (None, 2) and out["c"] == (5.0, 2)
    rel = {(r.g, r.o): r.relative for r in relative_scores(rows, "g", "v").collect()}
    assert rel[("a", 1)] == 0.5 and rel[("a", 2)] == 1.0 and rel[("c", 1)] == 0.5 and rel[("b", 1)] is None
    assert [r.c for r in spark.range(1, 6).select(cycled(["x", "y"], F.col("id")).alias("c")).collect()] == ["x", "y", "x", "y", "x"]


def test_sets(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "s string")
    assert sorted((r.s, r.turn) for r in replay(rows, "s", 5).collect()) == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1)]
    assert replay(rows.limit(0), "s", 5).count() == 0
    a, b = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double"), spark.createDataFrame([(2, None), (3, 9.0), (1, 5.0)], "k int, v double")
    assert sorted((r.k, r.v) for r in overlay(a, b, ["k"], "v").collect()) == [(1, 5.0), (2, 2.0), (3, 9.0)]
    assert spark.range(1).select(ordered_distinct(F.array(F.lit("B"), F.lit("a"), F.lit("b"), F.lit(None), F.lit("A"), F.lit("c")), 2).alias("x")).first().x == ["B", "a"]


def test_statistics(spark):
    rows = spark.createDataFrame([("g", x, p) for x, p in ((1.0, True), (2.0, False), (2.0, True), (4.0, False), (10.0, True), (float("nan"), True))] + [("h", 1.0, True), ("e", None, None)], "g string, x double, p boolean")
    d = {r.g: r for r in describe(rows, ["g"], "x").collect()}
    assert (d["g"]["count"], d["g"].p50, d["h"]["std"], d["e"]["count"], d["e"].mean) == (5, 2.0, 0.0, 0, None)
    a = {r.g: r.auc for r in auc(rows, ["g"], "x", "p").collect()}
    assert a["g"] == (0 + 0 + 0.5 + 0 + 1 + 1) / 6 and a["h"] is None
    m = spark.createDataFrame([("g", "x", 3), ("g", "y", 1), ("g", "y", 4), ("g", "x", 2)], "g string, v string, pos int")
    assert first_mode(m, ["g"], "v", [F.col("pos")]).first().v == "y"


def test_latest_table_repeats_nothing(spark, tmp_path):
    for i, rows in enumerate(([(1, "new", 2), (2, "a", 1)], [(1, "old", 1), (3, "c", 5)])):
        spark.createDataFrame(rows, "k int, s string, at int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    table = LatestTable(spark, ["k"], ["at"])
    run_available("test", stream_of(spark, str(tmp_path / "in"), 1), table)
    want = [(1, "new"), (2, "a"), (3, "c")]
    assert sorted((r.k, r.s) for r in table.read().collect()) == want
    table(spark.createDataFrame([(1, "again", 99)], "k int, s string, at int"), 0)
    assert sorted((r.k, r.s) for r in table.read().collect()) == want


def test_hot_join_keeps_every_row(spark):
    from millrace.operators.lookup import hot_join

    big = spark.createDataFrame([("hot" if i % 3 else f"k{i % 7}" if i % 2 else None, i) for i in range(500)], "k string, i int")
    small = spark.createDataFrame([("hot", 1), ("k1", 2), ("k3", 3)], "k string, v int")
    for how in ("inner", "left"):
        want = sorted(map(tuple, big.join(small, "k", how).collect()), key=repr)
        for broadcast_rows, hot_rows in ((10, 10), (0, 100), (0, 10_000)):
            got = hot_join(big, small, "k", 500, 3, how, broadcast_rows, hot_rows)
            assert sorted(map(tuple, got.collect()), key=repr) == want


def test_ranks_by_value_in_a_hot_group(spark):
    import random

    from millrace.operators.ranking import ranked_by_value

    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"g{i % 5}", i, rng.choice([None, 0.0, 0.5, -1e300, 1e300, rng.random(), rng.random()])) for i in range(2000)] + [("one", 5000, 1.0), ("none", 5001, None)]
    df = spark.createDataFrame(rows, "g string, i int, v double")
    got = {r.i: r.rank for r in ranked_by_value(df, ["g"], "v", [F.col("i")]).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[2] is None, -(r[2] or 0.0), r[1]))
        want |= {r[1]: n + 1 for n, r in enumerate(own)}
    assert got == want
