from __future__ import annotations

import random
from collections import Counter

import pytest

from millrace.llm.quota_sample import divisor_seats, quota_sample


def brute_seats(counts, targets, floors, size):
    records = []
    for c, n in enumerate(counts):
        for r in range(1, n + 1):
            if r <= floors[c]:
                records.append((0, (r - 0.5) / targets[c] if targets[c] else float("inf"), c))
            elif targets[c]:
                records.append((1, (r - 0.5) / targets[c], c))
    seats = Counter(c for *_, c in sorted(records)[:size])
    return [seats[c] for c in range(len(counts))]


def test_seats_are_the_smallest_priorities():
    rng = random.Random(3)
    for _ in range(400):
        k = rng.randint(1, 8)
        case = [rng.choice([0, 1, rng.randint(0, 60)]) for _ in range(k)], [rng.choice([0, 1, 10, 10, 33, 7]) for _ in range(k)], [rng.randint(0, 5) for _ in range(k)], rng.randint(0, 150)
        assert divisor_seats(*case) == brute_seats(*case), case


def test_large_counts_are_fast():
    seats = divisor_seats([10**9, 5 * 10**8, 10], [50, 30, 20], [3, 3, 3], 10**8)
    assert sum(seats) == 10**8 and seats[2] == 10 and abs(seats[0] / seats[1] - 5 / 3) < 1e-6


SCHEMA = "axis string, batch string, category string, record string, rank string, offset string"
TARGETS = [("t", "a", 60, 2), ("t", "b", 30, 2), ("t", "c", 10, 4), ("u", "a", 100, 1)]


def run(spark, rows, pct=20, seed=0):
    targets = spark.createDataFrame(TARGETS, "axis string, category string, target_pct int, min_keep int")
    return quota_sample(spark.createDataFrame(rows, SCHEMA).drop("rank", "offset"), targets, "axis", "batch", "category", "record", pct, seed)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    return [("t", rng.choice(["b1", "b1", "b1", "b2", None]), rng.choice(["a", "b", "b", None, "other"]), f"r{i}", None, None) for i in range(900)] + [("t", "b1", "c", "only", None, None)]


def test_sample_and_report(spark, rows):
    found = run(spark, rows)
    sample, report = found.sample.collect(), found.report.collect()
    size = Counter(r[1] for r in rows)
    drawn = Counter((r.batch, r.category) for r in sample)
    for r in report:
        have = sum(1 for x in rows if x[1] == r.stratum and x[2] == r.category)
        assert (r.n, r.sample_size, r.available) == (size[r.stratum], size[r.stratum] * 20 // 100, have)
        assert r.required == max(r.min_keep, (r.sample_size * r.target_pct + 99) // 100) and r.is_short == (have < r.required)
        assert drawn[(r.stratum, r.category)] == r.seats
    for batch in size:
        own = sorted((r for r in report if r.stratum == batch), key=lambda r: r.category)
        assert [r.seats for r in own] == brute_seats([r.available for r in own], [60, 30, 10], [2, 2, 4], size[batch] * 20 // 100)
    assert len({r.record for r in sample}) == len(sample)


def test_seed_changes_the_draw_only(spark, rows):
    one, two = ({r.record for r in run(spark, rows, seed=s).sample.collect()} for s in (1, 2))
    assert one != two and len(one) == len(two)
    assert one == {r.record for r in run(spark, rows[::-1], seed=1).sample.collect()}


def test_empty(spark):
    found = run(spark, [])
    assert found.sample.count() == 0 and found.report.count() == 0
