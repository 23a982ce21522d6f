from __future__ import annotations

import math
import random
import struct

from pyspark.sql import functions as F

from millrace.functions import exprs as X
from millrace.functions import kernels as K
from millrace.functions.ordered import ordered_bits
from millrace.functions.text import base_key, token_count
from millrace.operators.latest import latest_by
from millrace.operators.ranking import bin_offsets, binned_rank, hash_bin
from millrace.operators.selection import largest_remainder


def ieee(x: float) -> int:
    bits = struct.unpack(">q", struct.pack(">d", abs(x)))[0]
    return -bits if x < 0 else bits


def test_ordered_bits(spark):
    rng = random.Random(1)
    xs = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308, 1.0, 2.0, 0.5, 1 - 2**-53, 1 + 2**-52, 1024.0, 1023.9999999999999]
    xs += [rng.uniform(-1, 1) * 10.0 ** rng.uniform(-320, 308) for _ in range(5000)] + [2.0**e for e in range(-1074, 1024, 7)]
    rows = spark.createDataFrame([(x,) for x in [*xs, math.nan, math.inf, -math.inf, None]], "x double").select("x", ordered_bits(F.col("x")).alias("b")).collect()
    for r in rows:
        assert r.b == (ieee(r.x) if r.x is not None and math.isfinite(r.x) else None), r


def test_tokens_and_base(spark):
    rows = spark.createDataFrame([("Ein Wert: 0.33 – ok_1!", "a__reward_pool__t__1__reward_pool__x"), (None, None), ("", ""), (" \t\n", "__reward_pool__y")], "t string, k string")
    out = rows.select(token_count(F.col("t")).alias("n"), base_key(F.col("k")).alias("b")).collect()
    assert [(r.n, r.b) for r in out] == [(9, "a"), (0, None), (0, ""), (0, "")]


def test_numbers(spark):
    rows = spark.createDataFrame([(None,), (math.nan,), (math.inf,), (0.0,), (0.3,), (7.0,)], "x double")
    x = F.col("x")
    out = rows.select(X.finite_or(x, 9.0).alias("f"), X.clamp(x).alias("c"), X.or_else(x, F.lit(5.0)).alias("o"), X.gate_passes(x, 0.5).alias("g"), X.gmean([x]).alias("m"), X.weighted_mean([(x, 1.0), (F.lit(1.0), 1.0)]).alias("w")).collect()
    assert [r.f for r in out] == [9.0, 9.0, 9.0, 0.0, 0.3, 7.0]
    assert [r.c for r in out] == [None, None, 1.0, 0.0, 0.3, 1.0]
    assert out[0].o == 5.0 and out[3].o == 5.0 and out[4].o == 0.3
    assert [r.g for r in out] == [True, True, True, False, False, True]
    assert [round(r.m, 6) for r in out] == [0.0, 0.0, 0.0, 1e-6, 0.3, 1.0]
    assert [r.w for r in out] == [1.0, 1.0, 1.0, 0.5, 0.65, 4.0]


def test_reasons_and_roles(spark):
    rows = spark.createDataFrame([("policy", 1), ("policy:a", None), ("policyx", 3), (None, 2)], "r string, n int")
    tests = [("low", F.col("n") < 2), ("odd", F.col("n") % 2 == 1)]
    out = rows.select(X.reasons(tests).alias("all"), X.first_reason(tests, "none").alias("first"), X.role_matches(F.col("r"), ["policy"]).alias("m"), X.role_matches(F.col("r"), ["pol*"]).alias("s")).collect()
    assert [r["all"] for r in out] == [["low", "odd"], [], ["odd"], []]
    assert [r["first"] for r in out] == ["low", "none", "odd", "none"]
    assert [r.m for r in out] == [True, True, False, False] and [r.s for r in out] == [True, True, True, False]


def test_latest(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), (None, None, "n"), (None, 5, "m"), ("b", None, "z")], "k string, at int, v string")
    assert sorted((r.k or "", r.v) for r in latest_by(rows, ["k"], "at").collect()) == [("", "m"), ("a", "y"), ("b", "z")]
    assert latest_by(rows.limit(0), ["k"], "at").count() == 0


def test_binned_rank(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("g"), "id", F.xxhash64("id").alias("h")).withColumn("b", hash_bin(F.col("h"), 16))
    out = binned_rank(rows, bin_offsets(rows, ["g"], "b"), ["g"], "b", [F.col("h")]).collect()
    for g in ("hot", "cold"):
        own = sorted((r.h, r["rank"]) for r in out if r.g == g)
        assert [x for _, x in own] == list(range(1, len(own) + 1))


def test_largest_remainder():
    assert largest_remainder([1, 1, 1], 10) == [4, 3, 3]
    assert largest_remainder([0, 0], 3) == [2, 1] and largest_remainder([0, 0], 3, empty="none") == [0, 0]
    assert largest_remainder([50, 30, 20], 7) == [4, 2, 1] and sum(largest_remainder([0.1, 7, 3.3, 9], 101)) == 101
    assert largest_remainder([], 4) == [] and largest_remainder([3], 0) == [0]


def test_kernels_on_a_picture(spark):
    """A clean edit recolours a box; a damaged one adds a spot outside."""
    size, box = 32, range(11, 21)
    before = [128.0] * size * size
    clean = list(before)
    for y in box:
        for x in box:
            clean[y * size + x] = 220.0
    damaged = list(clean)
    for y in range(4):
        for x in range(4):
            damaged[y * size + x] = 0.0
    rows = spark.createDataFrame([(before, clean), (before, damaged)], "a array<double>, b array<double>")
    mask = K.box_mask(size * size, size, 11, 11, 21, 21)
    diff = K.difference(F.col("a"), F.col("b"))
    out = rows.select(
        K.mean(K.within(diff, mask)).alias("inside"), K.mean(K.within(diff, mask, False)).alias("outside"), K.changed_share(F.col("a"), F.col("b"), 1.0).alias("changed"), K.box_share(K.change_mask(F.col("a"), F.col("b"), 1.0), size).alias("box"),
        K.signal_to_noise(F.col("a"), F.col("a"), 255.0).alias("same"), F.size(F.filter(K.dilated(mask, size), lambda x: x)).alias("grown"),
    ).collect()
    assert out[0].inside == 92.0 and out[0].outside == 0.0 < out[1].outside
    assert abs(out[0].changed - 100 / 1024) < 1e-9 and abs(out[0].box - 100 / 1024) < 1e-9 and abs(out[1].box - 21 * 21 / 1024) < 1e-9
    assert out[0].same == 60.0 and out[0].grown == 144


def test_number_map(spark):
    row = spark.createDataFrame([("a:1.5, b:nan, c:-1, d, e:2",)], "t string").select(X.number_map(F.col("t")).alias("m"), X.text_list(F.lit(" a,, b ")).alias("l")).first()
    assert row.m == {"a": 1.5, "e": 2.0} and row.l == ["a", "b"]
