from __future__ import annotations

import os
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.functions.text import TOKEN
from millrace.llm import queries
from millrace.llm.first_fit import first_fit, taken
from millrace.llm.mixing import domain_model, mix_sources
from millrace.operators.ranking import hash_bin, hash_order

SF = "/root/testdata/sf0.001"

WORDS = {"log": ["error", "trace", "exit", "stack"], "note": ["maybe", "later", "today", "plan"], "report": ["total", "rate", "figure", "round"]}
TARGETS = [("even", "log", 34, 2), ("even", "note", 33, 2), ("even", "report", 33, 2), ("logs", "log", 80, 3), ("logs", "note", 20, 1)]
SCHEMA = "doc long, text string, snap string, src string, n int, rate string, total string"


def documents(n=1500, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rng.choice(["log", "note", "note", "report"])
        size = rng.randint(1, 40)
        text = " ".join(rng.choice([*WORDS[kind], "the", "and"]) for _ in range(size))
        rows.append((i, text, rng.choice(["s1", "s1", "s2", None]), rng.choice([kind] * 9 + [None]), size, kind, None))
    return rows + [(n, None, "s1", None, None, "log", None), (n + 1, "", "s1", "note", 0, "note", None), (n + 2, "x", "s3", "foreign", 1, "log", None)]


def run(spark, rows):
    targets = spark.createDataFrame(TARGETS, "mix string, source string, weight_pct int, max_repeat int")
    return mix_sources(spark.createDataFrame(rows, SCHEMA), targets, "snap", "doc", "text", "src", "n")


@pytest.fixture(scope="module")
def mixed(spark):
    rows = documents()
    found = run(spark, rows)
    return rows, found.repeats.collect(), found.shares.collect()


def test_shares_and_limits(mixed):
    rows, repeats, shares = mixed
    by_doc = {r[0]: r for r in rows}
    most = {(m, s): k for m, s, _, k in TARGETS}
    used = Counter()
    for r in repeats:
        doc = by_doc[r.doc]
        assert doc[2] == r.snapshot and (r.source is None or r.source == doc[3])
        assert 1 <= r.repeats <= (most[(r.mix, r.source)] if r.source else 3)
        used[(r.mix, r.snapshot, r.source)] += r.repeats * doc[4]
    assert len({(r.mix, r.snapshot, r.doc) for r in repeats}) == len(repeats)
    totals, tokens = Counter(), Counter()
    for r in rows:
        totals[r[2]] += r[4] or 0
        tokens[(r[2], r[3])] += r[4] or 0
    assert len(shares) == len(TARGETS) * len(totals)
    for r in shares:
        assert (r.total_tokens, r.source_tokens, r.used_tokens) == (totals[r.snapshot], tokens[(r.snapshot, r.source)], used[(r.mix, r.snapshot, r.source)])
        assert r.is_short == (r.source_tokens * r.max_repeat * 100 < r.weight_pct * r.total_tokens)
        if not r.is_short and r.snapshot != "s3":
            # posteriors of the others may take a little of a source that isn't short
            assert abs(r.used_tokens + r.soft_tokens - r.target_tokens) <= 0.03 * r.target_tokens + 40, r
            assert r.gap_pct <= 0.1 + 1e-9
        if r.is_short:
            assert r.used_tokens == r.source_tokens * r.max_repeat


def test_classifier_on_held_out_rows(spark):
    rows = [r for r in documents(3000, 7) if r[1] and r[3] in WORDS and r[4] >= 5]
    model = domain_model(spark.createDataFrame(rows, SCHEMA), sorted(WORDS), "doc", "text", "src")
    quality = model.quality().first()
    assert quality.n > 200 and quality.accuracy > 0.9
    out = model.posterior(model.held_out).collect()
    assert len(out) == quality.n and all(abs(sum(r.posterior) - 1) < 1e-6 for r in out)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_classifier_on_the_documents_with_labels_withheld(spark):
    """Sources share most of their sentences: what counts is that posteriors are as sure as they are right."""
    quality = queries.p7_classifier(spark, "/root/testdata/sf0.1").first()
    assert quality.n > 1000 and quality.accuracy > quality.largest_share + 0.25
    assert abs(quality.accuracy - quality.confidence) < 0.1


def test_withheld_labels_reach_the_targets(spark):
    """A third of the tokens unlabelled, one source wholly so: the fit must supply that source from them."""
    rows = [(r[0], r[1], "s", None if r[5] == "log" or r[0] % 5 == 0 else r[5], r[4], r[5], None) for r in documents(3000, 3) if r[1] and r[4] >= 12]
    rows += [(10_000 + r[0], r[1], "other", r[5], r[4], r[5], None) for r in documents(1500, 4) if r[1] and r[4] >= 12]
    found = run(spark, rows)
    own = {r[0]: r for r in rows}
    really = Counter()
    for r in found.repeats.where("mix = 'even' and snapshot = 's'").collect():
        really[own[r.doc][5]] += r.repeats * own[r.doc][4]
    shares = [r for r in found.shares.where("mix = 'even' and snapshot = 's'").collect()]
    assert len(shares) == 3
    for r in shares:
        assert r.gap_pct <= 0.1 + 1e-9
        assert abs(r.reached_pct - r.weight_pct) < 2, r
        assert abs(really[r.source] / r.total_tokens * 100 - r.weight_pct) < 6, (r, really)


def sequential(rows, goal):
    left, got = goal, []
    for order, doc, n in sorted(rows):
        if 0 < n <= left:
            left -= n
            got.append(doc)
    over = [(n, order, doc) for order, doc, n in rows if doc not in set(got) and left < n < 2 * left]
    return set(got) | ({min(over)[2]} if over else set())


def test_first_fit_is_the_sequential_one(spark):
    rng = random.Random(9)
    rows = []
    for g, sizes in (("even", [10] * 400), ("giant", [5000] + [10] * 500), ("mixed", [rng.choice([0, 1, 3, 17, 200, 1500]) for _ in range(900)]), ("ties", [7] * 50), ("none", [9, 9])):
        for i, n in enumerate(sizes):
            rows.append((g, f"{g}{i}", n, rng.choice([-(2**63), 5]) if g == "ties" else rng.randint(-(2**63), 2**63 - 1)))
    goals = [(p, g, goal) for p, share in (("a", 0.8), ("b", 0.33), ("c", 1.5), ("d", 0.0)) for g, goal in {(g, int(share * sum(r[2] for r in rows if r[0] == g))) for g in ("even", "giant", "mixed", "ties")}] + [("a", "none", 4), ("b", "none", 5), ("e", "giant", 4000)]
    df = spark.createDataFrame(rows, "g string, doc string, n bigint, at bigint").withColumn("bin", hash_bin(F.col("at")))
    found = first_fit(df, spark.createDataFrame(goals, "plan string, g string, goal bigint"), ["g"], "plan", "doc", "n", "at", "bin", len(goals)).df
    assert found.count() == len(goals)
    picked = df.join(found, "g").where(taken(F.col("rounds"), "n", "at", "doc") & (F.col("n") > 0) | (F.col("doc") == F.col("extra")))
    got = defaultdict(set)
    for r in picked.collect():
        got[(r.plan, r.g)].add(r.doc)
    for plan, g, goal in goals:
        assert got[(plan, g)] == sequential([(r[3], r[1], r[2]) for r in rows if r[0] == g], goal), (plan, g)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_repeats_on_the_whole_documents_table(spark):
    """Every labelled document of the table against a walk in order, from the rates reported."""
    mix = queries._mixed(spark, SF)
    shares = mix.shares.collect()
    docs = queries._sourced(spark, SF).select("doc_id", "snapshot", "source", F.regexp_count("text", F.lit(TOKEN)).alias("n"), hash_order(0, F.col("doc_id").cast("string")).alias("at")).collect()
    cells = defaultdict(list)
    for d in docs:
        cells[(d.snapshot, d.source)].append((d["at"], d.doc_id, d.n or 0))
    want = {}
    for r in shares:
        own = cells[(r.snapshot, r.source)]
        whole = int(r.rate)
        more = sequential(own, int((r.rate - whole) * r.source_tokens + 1e-6))
        for _, doc, n in own:
            if n > 0 and whole + (doc in more):
                want[(r.mix, doc)] = whole + (doc in more)
    got = {(r.mix, r.doc_id): r.repeats for r in mix.repeats.where("source is not null").collect()}
    assert got == want
    assert all(r.used_tokens == sum(n * got.get((r.mix, doc), 0) for _, doc, n in cells[(r.snapshot, r.source)]) for r in shares)


def test_fractional_targets(spark):
    rows = [(i, "a b c d e f g h i j", "s", "log" if i % 2 else "note", 10, None, None) for i in range(2000)]
    targets = spark.createDataFrame([("m", "log", 33.5, 1), ("m", "note", 50.01, 1)], "mix string, source string, weight_pct double, max_repeat int")
    found = {r.source: r for r in mix_sources(spark.createDataFrame(rows, SCHEMA), targets, "snap", "doc", "text", "src").shares.collect()}
    assert found["log"].used_tokens == 6700 and not found["log"].is_short and found["note"].is_short


def test_soft_documents_fill_what_is_lacking(spark):
    rows = [(i, "error trace exit stack", "s", "log", 4, None, None) for i in range(5)] + [(100 + i, "maybe later today plan", "s", "note", 4, None, None) for i in range(40)]
    rows += [(200 + i, "error trace stack exit", "s", None, 4, None, None) for i in range(40)]
    found = run(spark, rows)
    soft = defaultdict(int)
    for r in found.repeats.where("mix = 'even' and source is null").collect():
        soft[r.doc] = r.repeats
    share = {r.source: r for r in found.shares.where("mix = 'even'").collect()}
    assert soft and share["log"].is_short and share["log"].soft_tokens > 0.5 * (share["log"].target_tokens - share["log"].used_tokens)


def test_degenerate_tables(spark):
    assert run(spark, []).shares.count() == 0 and run(spark, []).repeats.count() == 0
    only = run(spark, [(1, "a b", None, None, 2, None, None), (2, None, None, None, None, None, None)])
    assert {(r.snapshot, r.total_tokens, r.source_tokens) for r in only.shares.collect()} == {(None, 2, 0)}
