"""Mixing sources to target shares of the total size."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import TOKEN, token_count
from millrace.llm.domains import FOLDS, DomainModel, fit_domains, layout
from millrace.llm.first_fit import first_fit, taken
from millrace.operators.lookup import lookup_join
from millrace.operators.ranking import hash_bin, hash_order
from millrace.scratch import Kept, keep

#: The mixes are a table written by people; more rows than this is an error.
TARGET_ROWS = 2_000
#: Steps after which the rates are written, so that a row's fold stays short.
STEPS_A_WRITE = 20
ROWS_A_TASK = 50_000
#: The first steps are so much longer than the bound on the curvature allows for certain.
FIRST_STEP = 64
#: Mixes times snapshots that are fitted at once; more are fitted chunk by chunk.
CELLS = 4_096


@dataclass
class Mix:
    """``repeats``: mix, snapshot, doc, source, repeats.  ``shares``: a row per mix, snapshot and source.  ``model``: the classifier, if one was needed."""

    repeats: DataFrame
    shares: DataFrame
    model: DomainModel | None


def _minus(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def _hard_rate(soft: Column | str) -> Column:
    """The best rates of the labelled sources, given what the others supply."""
    wanted = F.zip_with(_minus("goal", soft), "have", lambda g, h: F.when(h > 0, F.greatest(g, F.lit(0.0)) / h).otherwise(0.0))
    return F.zip_with(wanted, "cap", lambda r, c: F.least(r, c))


def domain_model(documents: DataFrame, domains: list[str], doc: str, text: str, source: str, train_rows: int = 1_000, seed: int = 0, pattern: str = TOKEN) -> DomainModel:
    """The classifier alone, fitted as in ``mix_sources``."""
    base, counts = _tokenised(documents, domains, F.lit(None).cast("string"), doc, text, source, None, train_rows, seed, pattern)
    kept = keep(base.where("weight is not null"), "domain-rows")
    return fit_domains(kept.df, domains, _prior(counts))


def _prior(counts: dict[str, int]) -> dict[str, float]:
    whole = sum(counts.values())
    return {d: n / whole for d, n in counts.items()} if whole else {}


def _tokenised(documents: DataFrame, domains: list[str], snap: Column, doc: str, text: str, source: str, tokens: str | None, train_rows: int, seed: int, pattern: str) -> tuple[DataFrame, dict[str, int]]:
    """Every document with its size and, where the classifier needs them, its words: one pass over the texts."""
    known = F.coalesce(F.col(source).isin(domains), F.lit(False)) if domains else F.lit(False)
    counts = {r[0]: r[1] for r in documents.where(known).groupBy(source).count().collect()}  # a row per target source
    shares = F.create_map(*[x for d, n in sorted(counts.items()) for x in (F.lit(d), F.lit(min(1.0, train_rows / n)))]) if counts else F.create_map().cast("map<string,double>")
    order = hash_order(seed, F.col(doc).cast("string"))
    body = F.coalesce(F.col(text), F.lit(""))
    rows = documents.select(
        F.coalesce(F.concat(F.lit("s"), snap), F.lit("null")).alias("snap"), F.col(doc).alias("doc"), F.when(known, F.col(source)).alias("domain"), order.alias("order"), hash_bin(order).alias("bin"), F.col(text).alias("__text"), (F.col(tokens) if tokens else F.lit(None)).cast("bigint").alias("__given"),
        F.pmod(F.xxhash64(body, F.lit(seed)), F.lit(FOLDS)).cast("int").alias("fold"), (F.pmod(hash_order(seed + 2, F.col(doc).cast("string")), F.lit(1 << 30)) / float(1 << 30)).alias("__draw"), shares[F.col(source)].alias("__share")
    )
    # labelled rows in the bounded sample and all unlabelled ones show their words to the classifier
    rows = rows.withColumn("weight", F.when(F.col("domain").isNotNull() & (F.col("__draw") < F.col("__share")), 1.0 / F.col("__share")))
    words = F.when(F.col("domain").isNull() | F.col("weight").isNotNull(), F.regexp_extract_all(F.coalesce("__text", F.lit("")), F.lit(pattern), F.lit(0)))
    rows = rows.withColumn("words", words)
    counted = F.when(F.col("words").isNotNull(), F.size("words")).otherwise(token_count(F.col("__text"), pattern)).cast("bigint")
    rows = rows.withColumn("tokens", F.coalesce("__given", F.lit(0).cast("bigint")) if tokens else counted)
    marks = F.when(F.col("words").isNotNull(), layout(F.col("__text"), F.size("words")))
    return rows.withColumn("layout", marks).drop("__text", "__given", "__draw", "__share"), counts


def mix_sources(documents: DataFrame, targets: DataFrame, snapshot: str, doc: str, text: str, source: str, tokens: str | None = None, tolerance: float = 1e-3, train_rows: int = 1_000, max_steps: int = 2_000, seed: int = 0, pattern: str = TOKEN) -> Mix:
    """How often each document goes into each mix, so that sources supply their target shares.

    ``documents``: one row per document with its text and its ``source``,
    already in the targets' spelling or null; its size is the column ``tokens``
    or, without one, the number of matches of ``pattern``.  ``targets``: mix,
    source, weight_pct (may be fractional), max_repeat.  Every (mix, snapshot)
    is fitted on its own; a source is to supply ``weight_pct`` percent of the
    snapshot's total tokens.

    Membership is soft: a labelled document belongs to its source, any other
    (null source, or one no mix names) to all by the posterior of a classifier.
    That is fitted on a sample of about ``train_rows`` labelled rows a source
    (``domains.fit_domains``); everything else covers all rows.  Rates r
    between 0 and the repeat limit minimise the squared distance of the expected
    tokens per source from their targets by accelerated projected gradient
    steps; where a step overshoots, its momentum restarts and steps shorten, down
    to what the largest token mass of a source among the unlabelled allows.
    Documents with the same membership share a rate, so labelled ones are one
    variable per source and snapshot and always at their optimum; the others are
    updated row by row where they lie, and only vectors per mix and snapshot
    move.  Unlabelled documents start at 0 and so are used for what labelled
    ones can't supply; if those meet every target nothing is left to fit.
    Steps end when the linearised gap proves that the tokens per source are
    within ``tolerance`` of the snapshot's total from the optimum (Euclidean);
    ``gap_pct`` tells what was proved, and is above the tolerance only if
    ``max_steps`` came first.  A document's limit is ``max_repeat`` of its
    source, or of the most probable one.

    Rates become whole repeats in seeded hash order: all documents of a source
    get floor(r), and one more goes to each that still fits into what is then
    missing, plus one that fits best on top if that is nearer (``first_fit``).
    An unlabelled document gets the extra one with the probability of its
    fraction.  Repeats never exceed the limit.

    ``repeats``: rows with at least one repeat.  ``shares``: mix, snapshot,
    source, weight_pct, max_repeat, total_tokens (of all documents in the
    snapshot), source_tokens, target_tokens, rate, used_tokens (whole repeats
    of labelled documents), soft_tokens (expected of the others by their
    rates), soft_used_tokens (expected of the others by the repeats drawn),
    used_pct and reached_pct (used_tokens, without and with soft_used_tokens, to
    the total), mixed_pct (share of what was mixed), gap_pct and is_short:
    source_tokens * max_repeat * 100 < weight_pct * total_tokens, so that the
    target can't be met from the source.  A null snapshot is a snapshot;
    documents of size 0 or null size add nothing and are not used; no
    documents give no rows.
    """
    spark = documents.sparkSession
    rows = targets.select("mix", "source", F.col("weight_pct").cast("double"), F.col("max_repeat").cast("int")).orderBy("mix", "source").limit(TARGET_ROWS + 1).collect()
    if len(rows) > TARGET_ROWS:
        raise ValueError(f"more than {TARGET_ROWS} target rows")
    domains = sorted({r.source for r in rows})
    mixes = sorted({r.mix for r in rows})
    if not rows:
        raise ValueError("no targets")
    by_mix = {m: {r.source: r for r in rows if r.mix == m} for m in mixes}
    base, counts = _tokenised(documents, domains, F.col(snapshot), doc, text, source, tokens, train_rows, seed, pattern)
    kept = keep(base, "mix-docs")
    hard_rows = kept.df.where("domain is not null").select("snap", "domain", "doc", "tokens", "order", "bin")
    soft_rows = kept.df.where("domain is null and tokens > 0")
    by_domain = kept.df.groupBy("snap", "domain").agg(F.sum("tokens").alias("t"))
    by_snap = by_domain.groupBy("snap").agg(F.sum("t").alias("total"), F.coalesce(F.sum(F.when(F.col("domain").isNull(), F.col("t"))), F.lit(0)).alias("soft_total"), F.map_from_entries(F.collect_list(F.when(F.col("domain").isNotNull(), F.struct("domain", "t")))).alias("by_domain"))  # a row per domain
    weights = F.array(*[F.array(*[F.lit(float(by_mix[m][d].weight_pct) if d in by_mix[m] else 0.0) for d in domains]) for m in mixes])
    caps = F.array(*[F.array(*[F.lit(float(by_mix[m][d].max_repeat) if d in by_mix[m] else 0.0) for d in domains]) for m in mixes])
    names = F.array(*[F.lit(m) for m in mixes])
    state = by_snap.select("snap", "total", "soft_total", "by_domain", F.posexplode(names).alias("i", "mix"))
    state = state.withColumn("goal", F.transform(weights[F.col("i")], lambda w: w * F.col("total") / 100.0)).withColumn("cap", caps[F.col("i")])
    state = state.withColumn("have", F.array(*[F.coalesce(F.col("by_domain")[d], F.lit(0)).cast("double") for d in domains])).drop("by_domain", "i")
    state = keep(state.withColumn("cell", F.monotonically_increasing_id()), "mix-state")
    cells = state.count()
    model, soft_kept, fitted_soft = None, [], []
    if state.df.where(F.col("soft_total") > 0).where(F.exists(_minus("goal", F.zip_with(_hard_rate(F.array(*[F.lit(0.0) for _ in domains])), "have", lambda r, h: r * h)), lambda x: x > 0)).limit(1).count():
        soft_count = soft_rows.count()
        model = fit_domains(kept.df.where("weight is not null"), domains, _prior(counts))
        top = (F.array_position("posterior", F.array_max("posterior")) - 1).cast("int")
        slim = model.posterior(soft_rows).select("snap", "doc", "tokens", "order", "posterior", F.explode(names).alias("mix"))  # every mix sees every such document
        slim = lookup_join(slim, state.df.select("mix", "snap", "cell", "cap"), ["mix", "snap"], cells, F.col("order"), broadcast_rows=CELLS)
        zero = F.lit(0.0)
        # every step is a pass over these rows: as few tasks as their number needs
        slim = slim.coalesce(1 + soft_count * len(mixes) // ROWS_A_TASK)
        slim = keep(slim.select("cell", "mix", "snap", "doc", "tokens", "order", "posterior", F.get("cap", top).alias("limit"), zero.alias("r"), zero.alias("y")), "mix-soft")
        ids = sorted(r[0] for r in state.df.where(F.col("soft_total") > 0).select("cell").collect())  # a number per mix and snapshot
        for at in range(0, len(ids), CELLS):
            low, high = ids[at], ids[min(at + CELLS, len(ids)) - 1]
            chunk = _Cells(state.df.where(F.col("soft_total") > 0).where(F.col("cell").between(low, high)).orderBy("cell").collect())
            part = keep(slim.df.where(F.col("cell").between(low, high)), "mix-soft") if len(ids) > CELLS else slim
            part, gap = _descend(part, chunk, tolerance, max_steps)
            soft_kept.append(part)
            rows_found = [(int(c), [float(x) for x in v], float(g)) for c, v, g in zip(chunk.ids, chunk.soft, gap, strict=True)]
            fitted_soft.append(keep(spark.createDataFrame(rows_found, "cell bigint, soft array<double>, gap double"), "mix-fitted").df)
    fitted_rates = reduce(DataFrame.unionByName, fitted_soft) if fitted_soft else spark.createDataFrame([], "cell bigint, soft array<double>, gap double")
    none = F.array(*[F.lit(0.0) for _ in domains])
    final = keep(state.df.join(fitted_rates, "cell", "left").withColumn("soft", F.coalesce("soft", none)).withColumn("gap", F.coalesce("gap", F.lit(0.0))).withColumn("rate", _hard_rate("soft")), "mix-rates")

    zipped = F.explode(F.arrays_zip(F.array(*[F.lit(d) for d in domains]).alias("d"), F.col("rate").alias("r"), F.col("have").alias("h"))).alias("z")
    rates = final.df.select("mix", "snap", zipped).select("mix", "snap", F.col("z.d").alias("domain"), F.floor("z.r").cast("int").alias("whole"), F.floor((F.col("z.r") - F.floor("z.r")) * F.col("z.h") + 1e-6).cast("bigint").alias("goal"), "z.h").where("h > 0")
    places = ["snap", "domain"]
    many = cells * len(domains)
    fitted = first_fit(hard_rows, rates.select("mix", *places, "goal"), places, "mix", "doc", "tokens", "order", "bin", many)
    per_domain = rates.join(fitted.df, ["mix", *places]).groupBy(*places).agg(F.collect_list(F.struct("mix", "whole", "rounds", "extra")).alias("mixes"))  # a row per mix
    chosen = lookup_join(hard_rows.where("tokens > 0"), per_domain, places, many, F.col("order")).withColumn("m", F.explode("mixes")).select("*", "m.*")
    one_more = taken(F.col("rounds"), "tokens", "order", "doc") | F.coalesce(F.col("doc") == F.col("extra"), F.lit(False))
    no_posterior = F.lit(None).cast("array<double>")
    used = chosen.select("mix", "snap", "doc", F.col("domain").alias("source"), "tokens", (F.col("whole") + one_more.cast("int")).alias("repeats"), no_posterior.alias("posterior")).where("repeats > 0")
    for part in soft_kept:
        draw = F.pmod(hash_order(seed + 1, F.col("doc").cast("string"), F.col("mix")), F.lit(1 << 30)) / float(1 << 30)
        rate = F.col("r")
        used = used.unionByName(part.df.select("mix", "snap", "doc", F.lit(None).cast("string").alias("source"), "tokens", (F.floor(rate) + (draw < rate - F.floor(rate)).cast("int")).cast("int").alias("repeats"), "posterior").where("repeats > 0"))
    out = keep(used, "mix-repeats")
    amount = F.col("tokens") * F.col("repeats")
    sums = [F.coalesce(F.sum(amount * F.col("posterior")[i]), F.lit(0.0)).alias(f"s{i}") for i in range(len(domains))]
    spent = out.df.groupBy("mix", "snap", F.col("source").alias("domain")).agg(F.sum(amount).alias("used_tokens"), *sums)
    spent = keep(spent, "mix-spent")
    mixed = spent.df.groupBy("mix", "snap").agg(F.sum("used_tokens").alias("mixed"), F.array(*[F.sum(f"s{i}") for i in range(len(domains))]).alias("soft_used"))
    plan = spark.createDataFrame([(r.mix, r.source, r.weight_pct, r.max_repeat, domains.index(r.source)) for r in rows], "mix string, domain string, weight_pct double, max_repeat int, k int")
    shares = final.df.join(F.broadcast(plan), "mix").join(spent.df.where("domain is not null").select("mix", "snap", "domain", "used_tokens"), ["mix", "snap", "domain"], "left").join(mixed, ["mix", "snap"], "left")
    at = lambda x: F.element_at(x, F.col("k") + 1)
    tokens_of = at("have").cast("bigint")
    used_tokens = F.coalesce("used_tokens", F.lit(0))
    soft_used = F.coalesce(at("soft_used"), F.lit(0.0))
    exact = lambda x: x.cast("decimal(20,0)")
    short = exact(tokens_of) * F.col("max_repeat") * 100 < F.col("weight_pct").cast("decimal(10,5)") * exact(F.col("total"))
    shares = shares.select(
        "mix", _snapshot(), F.col("domain").alias("source"), "weight_pct", "max_repeat", F.col("total").alias("total_tokens"), tokens_of.alias("source_tokens"), at("goal").alias("target_tokens"), at("rate").alias("rate"),
        used_tokens.alias("used_tokens"), at("soft").alias("soft_tokens"), soft_used.alias("soft_used_tokens"), F.try_divide(used_tokens * 100.0, F.col("total")).alias("used_pct"), F.try_divide((used_tokens + soft_used) * 100.0, F.col("total")).alias("reached_pct"),
        F.try_divide(used_tokens * 100.0, F.coalesce("mixed", F.lit(0))).alias("mixed_pct"), F.coalesce(F.try_divide(F.col("gap") * 100.0, F.col("total")), F.lit(0.0)).alias("gap_pct"), short.alias("is_short"),
    )
    return Mix(out.df.select("mix", _snapshot(), F.col("doc").alias(doc), "source", "repeats"), shares, model)


class _Cells:
    """A chunk of mixes and snapshots while their unlabelled documents are fitted; a row per cell, a column per source."""

    def __init__(self, rows: list):
        self.ids = np.array([r.cell for r in rows], dtype=np.int64)  # ascending
        self.goal, self.cap, self.have = (np.array([r[c] for r in rows], dtype=np.float64) for c in ("goal", "cap", "have"))
        self.total = np.array([float(r.total or 0) for r in rows])
        self.soft = np.zeros_like(self.goal)

    def lacking(self, soft: np.ndarray) -> np.ndarray:
        wanted = self.goal - soft
        given = np.minimum(np.divide(np.maximum(wanted, 0.0), self.have, out=np.zeros_like(wanted), where=self.have > 0), self.cap) * self.have
        return wanted - given


def _walk(posterior: np.ndarray, limit: np.ndarray, r: np.ndarray, y: np.ndarray, at: np.ndarray, steps: list) -> tuple[np.ndarray, np.ndarray]:
    """Rates and extrapolated rates after the steps, each (direction, momentum, whether it moves, whether it drops its momentum) per cell."""
    for direction, momentum, live, restart in steps:
        y = np.where(restart[at], r, y)
        after = np.clip(y + np.einsum("ij,ij->i", posterior, direction[at]), 0.0, limit)
        ahead = after + momentum[at] * (after - r)
        r, y = np.where(live[at], after, r), np.where(live[at], ahead, y)
    return r, y


def _columns(batch: pa.RecordBatch, ids: np.ndarray, n: int) -> tuple:
    number = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
    posterior = batch.column("posterior").flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
    return posterior, number("limit"), number("r"), number("y"), np.searchsorted(ids, number("cell")), number("tokens").astype(np.float64)


def _descend(soft: Kept, cells: _Cells, tolerance: float, max_steps: int) -> tuple[Kept, np.ndarray]:
    """Fits the unlabelled documents of a chunk: their rates, and the gap proved for each cell; ``cells.soft`` are their expected tokens."""
    n = cells.goal.shape[1]

    def total(step: Callable, width: int) -> np.ndarray:
        """Sums per cell of what ``step`` gives for a batch, combined before the shuffle."""

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((len(cells.ids), width))
            for batch in batches:
                at, values = step(batch)
                for c in range(width):
                    out[:, c] += np.bincount(at, weights=values[:, c], minlength=len(cells.ids))
            some = np.flatnonzero(out.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(out[some, c]) for c in range(width))], names=["at", *[f"v{c}" for c in range(width)]])

        schema = "at int, " + ", ".join(f"v{c} double" for c in range(width))
        found = soft.df.select("cell", "posterior", "limit", "r", "y", "tokens").mapInArrow(sums, schema).groupBy("at").agg(*[F.sum(f"v{c}").alias(f"v{c}") for c in range(width)])
        out = np.zeros((len(cells.ids), width))
        for row in found.collect():  # a row per cell of the chunk
            out[row[0]] = row[1:]
        return out

    def masses(batch: pa.RecordBatch) -> tuple:
        posterior, _, _, _, at, tokens = _columns(batch, cells.ids, n)
        return at, posterior * tokens[:, None]

    # a bound on the curvature: the largest token mass that the unlabelled rows have in a source
    scale = total(masses, n).max(axis=1)
    gap, done = np.zeros(len(scale)), scale <= 0
    # most of that mass is absorbed by the labelled rates, so steps start longer and shorten where they overshoot
    curve = scale / FIRST_STEP
    lack = cells.lacking(cells.soft)
    lack_ahead, pace, restart, steps = lack, np.ones(len(scale)), np.zeros(len(scale), dtype=bool), []
    for k in range(max_steps):
        following = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        momentum, pace = (pace - 1) / following, following
        towards = np.where(restart[:, None], lack, lack_ahead)
        direction = np.divide(towards, curve[:, None], out=np.zeros_like(lack), where=scale[:, None] > 0)
        given, one = list(steps), (direction, momentum, ~done, restart)

        def step(batch: pa.RecordBatch, given: list = given, one: tuple = one, lack: np.ndarray = lack) -> tuple:
            posterior, limit, r, y, at, tokens = _columns(batch, cells.ids, n)
            r, y = _walk(posterior, limit, r, y, at, given)
            slope = np.einsum("ij,ij->i", posterior, lack[at])
            room = tokens * np.where(slope > 0, slope * (limit - r), -slope * r)
            r, y = _walk(posterior, limit, r, y, at, [one])
            mass = posterior * tokens[:, None]
            return at, np.column_stack([room, mass * r[:, None], mass * y[:, None]])

        sums = total(step, 1 + 2 * n)
        gap = np.where(done, gap, np.sqrt(2.0 * np.maximum(sums[:, 0], 0.0)))
        reached = done | (gap <= tolerance * cells.total)
        steps.append((direction, momentum, ~reached, restart))
        done = reached
        cells.soft = np.where(done[:, None], cells.soft, sums[:, 1 : 1 + n])
        before, lack, lack_ahead = (lack**2).sum(axis=1), cells.lacking(cells.soft), cells.lacking(sums[:, 1 + n :])
        restart = (lack**2).sum(axis=1) > before  # the momentum has carried a cell too far
        pace = np.where(restart, 1.0, pace)
        curve = np.where(restart, np.minimum(4 * curve, scale), curve)
        if done.all() or k + 1 == max_steps or len(steps) == STEPS_A_WRITE:
            walked = list(steps)

            def move(batches: Iterator[pa.RecordBatch], walked: list = walked) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    posterior, limit, r, y, at, _ = _columns(batch, cells.ids, n)
                    r, y = _walk(posterior, limit, r, y, at, walked)
                    yield batch.set_column(batch.schema.get_field_index("r"), "r", pa.array(r)).set_column(batch.schema.get_field_index("y"), "y", pa.array(y))

            spent, soft = soft, keep(soft.df.mapInArrow(move, soft.df.schema), "mix-soft")
            spent.drop()
            steps = []
        if done.all():
            break
    return soft, gap


def _snapshot() -> Column:
    return F.expr("if(snap = 'null', null, substring(snap, 2))").alias("snapshot")
