from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from millrace.llm.packing import pack, plan_containers


def contents(steps):
    held = defaultdict(list)
    for size, first, n, start, each in steps:
        for i in range(n):
            held[start + i // each].append(size)
    return held


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_whole_and_tight(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 100, 512, 2048])
    counts = Counter(min(capacity, max(1, int(rng.lognormvariate(4, 1.2)))) for _ in range(rng.choice([1, 50, 4000])))
    steps, n = plan_containers(dict(counts), capacity)
    held = contents(steps)
    assert Counter(s for x in held.values() for s in x) == counts
    assert sorted(held) == list(range(n)) and max(map(sum, held.values())) <= capacity
    assert all(sum(3 * s > capacity for s in x) <= 2 for x in held.values())
    least = max(-(-sum(s * c for s, c in counts.items()) // capacity), sum(c for s, c in counts.items() if 2 * s > capacity))
    assert n <= least * 1.25 + 1


def test_plan_bounds():
    assert plan_containers({}, 10) == ([], 0)
    assert plan_containers({10: 3}, 10)[1] == 3 and plan_containers({5: 5}, 10)[1] == 3
    with pytest.raises(ValueError):
        plan_containers({11: 1}, 10)
    steps, n = plan_containers({3: 10**12, 7: 10**12}, 10)
    assert n == 10**12 and len(steps) == 2


def test_every_item_has_its_container(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([None, 0, 1, 40, 40, 40, rng.randint(1, 350), 100, 200, 1000]), "x", "y") for i in range(1500)]
    limits = spark.createDataFrame([("small", 100, "x"), ("large", 300, "x")], "limit_name string, capacity int, piece string")
    out = pack(spark.createDataFrame(rows, "id long, n int, container string, piece string"), limits, "id", "n").collect()
    for name, capacity in (("small", 100), ("large", 300)):
        room, parts = Counter(), defaultdict(list)
        for r in out:
            if r.limit_name == name:
                room[r.container] += r.piece_size
                parts[r.id].append(r)
        assert max(room.values()) <= capacity and sorted(room) == list(range(len(room)))
        for i, n, *_ in rows:
            own = parts[i]
            assert sum(r.piece_size for r in own) == (n or 0) and sorted(r.piece for r in own) == list(range(own[0].pieces))
            assert len(own) == max(1, -(-(n or 0) // capacity))
        assert len(room) <= sum(n or 0 for _, n, *_ in rows) / capacity * 1.1 + 1


def test_nothing_to_pack(spark):
    limits = spark.createDataFrame([("l", 10)], "limit_name string, capacity int")
    assert pack(spark.createDataFrame([], "id long, n int"), limits, "id", "n").count() == 0
    out = pack(spark.createDataFrame([(1, 0), (2, None)], "id long, n int"), limits, "id", "n").collect()
    assert [(r.container, r.piece_size) for r in out] == [(0, 0), (0, 0)]


def test_a_large_capacity_with_every_size():
    capacity = 131_072
    steps, n = plan_containers({s: 1 + s % 3 for s in range(1, capacity + 1)}, capacity)
    total = sum(s * (1 + s % 3) for s in range(1, capacity + 1))
    assert sum(k for _, _, k, _, _ in steps) == sum(1 + s % 3 for s in range(1, capacity + 1))
    assert n <= 1.01 * max(-(-total // capacity), sum(1 + s % 3 for s in range(capacity // 2 + 1, capacity + 1)))
