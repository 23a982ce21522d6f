from __future__ import annotations

import random

import pyarrow as pa

import millrace.llm.top_items as top_items_module
from millrace.llm.top_items import LoserTree, top_items


def test_loser_tree_merges_and_seeks():
    rng = random.Random(1)
    for _ in range(200):
        runs = [sorted((rng.randint(0, 5), rng.randint(0, 50)) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 7))]
        firsts = [[next((j for j in range(i, len(run)) if run[j][0] != run[i][0]), len(run)) for i in range(len(run))] for run in runs]
        tree, out = LoserTree(runs, firsts), []
        while (step := tree.pop()) is not None:
            out.append(runs[step[0]][step[1]])
        assert out == sorted(x for run in runs for x in run)
        tree, out, seen = LoserTree(runs, firsts), [], {}
        while (step := tree.pop()) is not None:
            item = runs[step[0]][step[1]]
            out.append(item)
            seen[item[0]] = seen.get(item[0], 0) + 1
            if seen[item[0]] == 2:
                tree.seek(item[0])
        everything = sorted(x for run in runs for x in run)
        assert out == [x for g in range(6) for x in [y for y in everything if y[0] == g][:2]]


SCHEMA = "axis string, g string, worst long, tie string, no long, rank string"


def brute(rows, top):
    best = {}
    null_first = lambda x: (x is not None, x if x is not None else 0)
    for r in rows:
        best.setdefault((r[0], r[1]), []).append(r)
    out = []
    for own in best.values():
        own.sort(key=lambda r: (null_first(r[2]), (r[3] is not None, (r[3] or "").encode()), r[4]))
        out += [(*r[:5], i + 1) for i, r in enumerate(own[:top])]
    return sorted(out, key=repr)


def test_matches_sorting(spark):
    rng = random.Random(2)
    groups = ["hot"] * 6 + [None, "", "é", "z", "Z", "ab", "a"]
    rows = [(rng.choice(["x", "y", None]), rng.choice(groups), rng.choice([None, rng.randint(-5, 5), rng.randint(-(2**62), 2**62)]), rng.choice([None, "t", "é", "Z"]), i, "clash") for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).drop("rank").repartition(7)
    got = top_items(df, ["axis", "g"], ["worst", "tie", "no"], 3).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, 3)


def test_many_batches_in_a_run(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        rows = [("x", f"g{i % 9}" if i % 3 else "hot", -(i * 7919 % 997), "t", i, None) for i in range(4000)]
        df = spark.createDataFrame(rows, SCHEMA).drop("rank").coalesce(2)
        got = top_items(df, ["axis", "g"], ["worst", "no"], 3).collect()
        assert sorted((tuple(r) for r in got), key=repr) == brute([(*r[:3], "t", *r[4:]) for r in rows], 3)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty(spark):
    assert top_items(spark.createDataFrame([], SCHEMA).drop("rank"), ["axis", "g"], ["worst"], 3).count() == 0


def test_merge_holds_one_batch_and_one_group():
    """A bucket of many batches, with one group far larger than what is held."""
    rng = random.Random(5)
    rows = []
    for g, n in (("a", 3), ("hot", 4000), ("z", 200)):
        for run in range(n):
            rows += [(g, run, x, f"{g}{run}") for x in sorted(rng.sample(range(-(10**6), 10**6), 2))]
    seen: list[int] = []

    def batches():
        for i in range(0, len(rows), 50):
            columns = list(zip(*rows[i : i + 50], strict=True))
            seen.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(columns[3])], names=["g", "__run", "x", "other"])

    held, top_items_module.HELD = top_items_module.HELD, 100
    try:
        got = []
        for part in top_items_module.merge_stream(batches(), "__run", ["g"], ["x"], 3):
            assert part.num_rows <= 60
            got += [(r["g"], r["x"], r["other"], r["rank"]) for r in part.to_pylist()]
    finally:
        top_items_module.HELD = held
    want = []
    for g in ("a", "hot", "z"):
        own = sorted((x, other) for h, _, x, other in rows if h == g)[:3]
        want += [(g, x, other, i + 1) for i, (x, other) in enumerate(own)]
    assert got == want and len(seen) == len(range(0, len(rows), 50))
