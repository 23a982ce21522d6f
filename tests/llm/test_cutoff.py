from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest

from millrace.llm.cutoff import cutoff_report, kept_rows, share_cutoffs

SCHEMA = "id long, g string, h string, score double, pct int, n string, cutoff string"


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        if r[3] is not None and math.isfinite(r[3]) and r[4] is not None:
            groups[(r[1], r[2])].append(r)
    cuts, kept = {}, set()
    for g, own in groups.items():
        k = (len(own) * own[0][4] + 99) // 100
        scores = sorted((r[3] for r in own), reverse=True)
        cuts[g] = (len(own), k, scores[k - 1] if k else None)
        kept |= {r[0] for r in own if k and r[3] >= scores[k - 1]}
    return cuts, kept


def run(spark, rows):
    found = share_cutoffs(spark.createDataFrame(rows, SCHEMA), ["g", "h"], "score", "pct")
    kept = {r.id for r in kept_rows(found, ["g", "h"], "id").select("id").collect()}
    report = {(r.g, r.h): (r.n, r.target_kept, r.cutoff) for r in cutoff_report(found, ["g", "h"], "id").collect()}
    return report, kept


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_sorting(spark, seed):
    rng = random.Random(seed)
    makers = [
        lambda: rng.random(), lambda: round(rng.random(), 1), lambda: 0.5, lambda: rng.uniform(-1, 1), lambda: rng.choice([-1, 1]) * 10.0 ** rng.uniform(-320, 308),
        lambda: rng.choice([0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308]), lambda: rng.choice([None, math.nan, math.inf, -math.inf, 0.25]),
    ]
    rows = []
    for i in range(3000):
        g = rng.choice([None, "a", "a", "a", "b", "c", "null", ""])
        pct = {"a": 30, "b": 0, "c": 100}.get(g, 7)
        h = rng.choice([None, "x", "y", "z"])
        rows.append((i, g, h, makers[hash((g, h, seed)) % len(makers)](), None if g == "" else pct, "clash", "clash"))
    assert run(spark, rows) == brute(rows)


def test_hot_group_of_close_scores(spark):
    rows = [(i, "hot", "x", 1.0 + (i * 7919 % 5000) * 2.0**-52, 13, None, None) for i in range(5000)]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == ({}, set())


def test_many_groups_are_not_broadcast(spark):
    """Spark takes the table of 60,000 groups for small enough to broadcast; none is hot, so none is repeated for salts."""
    groups = 60_000
    rows = spark.range(groups * 3).selectExpr("id", f"concat('g', id % {groups}) as g", "'x' as h", f"double((id * 7919) % {groups * 3}) as score", "34 as pct")
    found = share_cutoffs(rows, ["g", "h"], "score", "pct")
    kept, report = kept_rows(found, ["g", "h"], "id"), cutoff_report(found, ["g", "h"], "id")
    for result in (kept, report):
        plan = result._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "Generate" not in plan
    assert found.count == groups
    assert report.where("n = 3 and target_kept = 2 and kept = 2").count() == groups
    assert kept.groupBy("g").count().where("count = 2").count() == groups
