"""Window, group-relative and fold queries (WIN)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.exprs import finite, finite_or, reasons
from millrace.operators.folds import cycled, ordered_values, relative_scores, smoothed, stepped_level
from millrace.operators.ranking import ranked_by_value
from millrace.operators.selection import capped
from millrace.plans.aggregates import GATES, SQL_GATES, gates
from millrace.plans.base import CAND, POOL, Registry, candidates, pool, r6, read
from millrace.scratch import keep

R = Registry()
QUERIES, SQL = R.QUERIES, R.SQL

GROUPED = "trim(group_id) != ''"


@R.query(
    "win_1_relative_rank",
    f"""with {CAND}, r as (select group_id, candidate_index, score, min(score) over g as lo, max(score) over g as hi, coalesce(preservation, 0.0) as preservation from cand where trim(group_id) <> '' and score is not null window g as (partition by group_id)),
    q as (select *, case when hi = lo then 0.5 else (score - lo) / (hi - lo) end as relative from r), s as (select *, round(0.7 * relative + 0.3 * preservation, 6) as quality from q)
    select group_id, candidate_index, round(relative, 6) as relative, quality, place::int as place, place <= 2 and quality >= 0.5 as taken from (select *, row_number() over (partition by group_id order by quality desc, candidate_index) as place from s)""",
)
def relative_rank(spark: SparkSession, sf: str) -> DataFrame:
    """The cut at the top comes first, the threshold after it."""
    rows = relative_scores(keep(candidates(spark, sf).where(GROUPED).where("score is not null").select("group_id", "candidate_index", "score", "preservation"), "group-scores").df, "group_id", "score")
    rows = rows.withColumn("quality", r6(0.7 * F.col("relative") + 0.3 * F.coalesce("preservation", F.lit(0.0))))
    rows = ranked_by_value(rows, ["group_id"], "quality", [F.col("candidate_index")], "place")
    return rows.select("group_id", "candidate_index", r6(F.col("relative")).alias("relative"), "quality", F.col("place").cast("int").alias("place"), ((F.col("place") <= 2) & (F.col("quality") >= 0.5)).alias("taken"))


@R.query(
    "win_2_gated_rank",
    f"""with {CAND}, f as (select *, {SQL_GATES} as ok, abs(coalesce(global_score, 0.0) - coalesce(local_score, 0.0)) as apart from cand where trim(group_id) <> ''),
    k as (select *, case when ok then row_number() over (partition by group_id, ok order by raw desc nulls last, candidate_index) else 0 end as place from f)
    select group_id, candidate_index, place::int as place, ok and place <= 2 and apart <= 0.3 as taken from k""",
)
def gated_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked among the feasible only; a top row that fails the agreement test is not replaced."""
    rows = candidates(spark, sf).where(GROUPED).withColumn("ok", F.size(reasons(gates(GATES))) == 0)
    apart = F.abs(finite_or(F.col("global_score"), 0.0) - finite_or(F.col("local_score"), 0.0))
    rows = keep(rows.select("group_id", "candidate_index", "ok", "raw", "global_score", "local_score"), "gated-rows").df
    placed = ranked_by_value(rows.where("ok"), ["group_id"], "raw", [F.col("candidate_index")], "place")
    return placed.unionByName(rows.where("not ok").withColumn("place", F.lit(0).cast("bigint"))).select("group_id", "candidate_index", F.col("place").cast("int").alias("place"), (F.col("ok") & (F.col("place") <= 2) & (apart <= 0.3)).alias("taken"))


@R.query("win_3_top_feasible", f"with {CAND}, f as (select * from cand where trim(group_id) <> '' and {SQL_GATES}) select group_id, candidate_index from (select *, row_number() over (partition by group_id order by raw desc nulls last, candidate_index) as r from f) where r <= 2")
def top_feasible(spark: SparkSession, sf: str) -> DataFrame:
    rows = candidates(spark, sf).where(GROUPED).where(F.size(reasons(gates(GATES))) == 0)
    return capped(rows, ["group_id"], [F.desc_nulls_last("raw"), F.col("candidate_index")], 2).select("group_id", "candidate_index")


@R.query("win_4_to_judge", f"with {CAND}, f as (select *, {SQL_GATES} as ok from cand where trim(group_id) <> '') select group_id, candidate_index, place::int as place from (select *, row_number() over (partition by group_id order by ok desc, raw desc nulls last, score desc nulls last, candidate_index) as place from f) where place <= 3")
def to_judge(spark: SparkSession, sf: str) -> DataFrame:
    rows = candidates(spark, sf).where(GROUPED).withColumn("ok", F.size(reasons(gates(GATES))) == 0)
    return capped(rows, ["group_id"], [F.desc("ok"), F.desc_nulls_last("raw"), F.desc_nulls_last("score"), F.col("candidate_index")], 3).select("group_id", "candidate_index", "place")


_TUPLE = "coalesce(score, 0.0) desc, coalesce(raw, 0.0) desc, coalesce(edit, 0.0) desc, coalesce(preservation, 0.0) desc, coalesce(validity, 0.0) desc, coalesce(judge, 0.0) desc, coalesce(group_id, ''), candidate_index"


@R.query("win_5_balance_cap", f"with {CAND} select family, group_id, candidate_index from (select *, row_number() over (partition by family order by {_TUPLE}) as r from cand where accepted) where r <= 25 order by group_id, candidate_index")
def balance_cap(spark: SparkSession, sf: str) -> DataFrame:
    return capped(candidates(spark, sf).where("accepted"), ["family"], score_tuple(), 25).select("family", "group_id", "candidate_index").orderBy("group_id", "candidate_index")


def score_tuple() -> list:
    """Six scores, best first, then the position."""
    return [*[finite_or(F.col(c), 0.0).desc() for c in ("score", "raw", "edit", "preservation", "validity", "judge")], F.coalesce("group_id", F.lit("")), F.col("candidate_index")]


@R.query("win_6_score_tuple", f"with {CAND} select group_id, candidate_index, (row_number() over (partition by edit_type order by {_TUPLE}))::int as place from cand")
def score_places(spark: SparkSession, sf: str) -> DataFrame:
    return candidates(spark, sf).select("group_id", "candidate_index", F.row_number().over(Window.partitionBy("edit_type").orderBy(*score_tuple())).alias("place"))


@R.query("win_7_round_robin", f"with {POOL} select pool_id, turn::int as turn from (select *, row_number() over (partition by coalesce(known_type, 'unknown'), source_id order by pool_id) as turn from pool) order by turn, pool_id")
def round_robin(spark: SparkSession, sf: str) -> DataFrame:
    """Strata take turns: rows are ordered by their place in the stratum."""
    turn = F.row_number().over(Window.partitionBy(F.coalesce("known_type", F.lit("unknown")), "source_id").orderBy("pool_id"))
    return pool(spark, sf).select("pool_id", turn.alias("turn")).orderBy("turn", "pool_id")


@R.query(
    "win_8_hard_negatives",
    f"""with {CAND}, t as (select group_id, candidate_index, raw, case when changed < 0.1 then 'no_op' when drift > 0.6 then 'drift' when judge < 0.5 then 'judge' else 'near_miss' end as tag from cand where trim(group_id) <> '' and not accepted),
    p as (select *, row_number() over (partition by group_id, tag order by raw desc nulls last, candidate_index) as in_tag from t)
    select group_id, candidate_index, tag, place::int as place from (select *, row_number() over (partition by group_id order by (in_tag > 1), raw desc nulls last, candidate_index) as place from p) where place <= 4""",
)
def hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """The best of every tag first, then the rest."""
    tag = F.when(F.col("changed") < 0.1, "no_op").when(F.col("drift") > 0.6, "drift").when(F.col("judge") < 0.5, "judge").otherwise("near_miss")
    rows = candidates(spark, sf).where(GROUPED).where("not accepted").withColumn("tag", tag)
    # behind four better rows of its tag that aren't its best, a row can't be among the first four: cut before the shuffle
    rows = capped(rows, ["group_id", "tag"], [F.desc_nulls_last("raw"), F.col("candidate_index")], 5, "in_tag")
    return capped(rows, ["group_id"], [F.col("in_tag") > 1, F.desc_nulls_last("raw"), F.col("candidate_index")], 4).select("group_id", "candidate_index", "tag", "place")


def _health(spark: SparkSession, sf: str) -> DataFrame:
    rounds = read(spark, sf, "round_metrics").where(finite(F.col("health_score")).isNotNull()).groupBy(F.pmod("round_index", F.lit(3)).alias("run"), "round_index")
    return rounds.agg(F.max("health_score").alias("h")).withColumn("round_index", F.col("round_index").cast("int"))


_HEALTH = """with recursive h as (select (round_index % 3)::int as run, round_index, max(health_score) as h from round_metrics where isfinite(health_score) group by all),
    o as (select *, row_number() over (partition by run order by round_index) as k from h)"""


@R.query("win_9_ema", f"{_HEALTH}, e as (select run, k, h as ema from o where k = 1 union all select o.run, o.k, 0.4 * o.h + 0.6 * e.ema from e join o on o.run = e.run and o.k = e.k + 1) select run, round(arg_max(ema, k), 6) as ema from e group by run")
def ema(spark: SparkSession, sf: str) -> DataFrame:
    return ordered_values(_health(spark, sf), ["run"], "round_index", "h").select("run", r6(smoothed(F.col("rounds"), 0.4)).alias("ema"))


@R.query("win_10_level", f"{_HEALTH}, e as (select run, 0::bigint as k, 3 as level from (select distinct run from o) union all select o.run, o.k, least(greatest(e.level + case when o.h >= 50 then 1 when o.h < 30 then -1 else 0 end, 1), 5) from e join o on o.run = e.run and o.k = e.k + 1) select run, arg_max(level, k)::int as level from e group by run")
def level(spark: SparkSession, sf: str) -> DataFrame:
    return ordered_values(_health(spark, sf), ["run"], "round_index", "h").select("run", stepped_level(F.col("rounds"), 3, 30.0, 50.0, 1, 5).alias("level"))


@R.query("win_11_equal_scores", f"with {POOL} select known_type, pool_id, (row_number() over (partition by known_type order by round(case when isfinite(total_score) then total_score end, 6) desc nulls last, pool_id))::int as place from pool")
def equal_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores that are equal to six digits form a bucket; within it the key decides (or a seeded hash of it)."""
    order = Window.partitionBy("known_type").orderBy(F.desc_nulls_last(F.round(finite(F.col("total_score")), 6)), "pool_id")
    return pool(spark, sf).select("known_type", "pool_id", F.row_number().over(order).alias("place"))


_CYCLE = ("train", "train", "train", "audit")


@R.query("win_12_cycle_in_stratum", f"with {POOL} select pool_id, (['train', 'train', 'train', 'audit'])[((row_number() over (partition by known_type, source_id order by pool_id) - 1) % 4 + 1)::int] as role from pool")
def cycle_in_stratum(spark: SparkSession, sf: str) -> DataFrame:
    return pool(spark, sf).select("pool_id", cycled(_CYCLE, F.row_number().over(Window.partitionBy("known_type", "source_id").orderBy("pool_id"))).alias("role"))


@R.query("win_13_cycle_modes", "select doc_id, (['train', 'train', 'train', 'audit'])[(doc_id % 4 + 1)::int] as by_key, (['train', 'train', 'train', 'audit'])[((n_chars + doc_id) % 4 + 1)::int] as by_both from documents")
def cycle_modes(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", cycled(_CYCLE, F.col("doc_id") + 1).alias("by_key"), cycled(_CYCLE, F.col("n_chars") + F.col("doc_id") + 1).alias("by_both"))


@R.query("win_14_shard_slice", f"with {POOL}, p as (select source_id, pool_id, row_number() over (partition by source_id order by pool_id) - 1 as pos, count(*) over (partition by source_id) as n from pool) select source_id, pool_id from p where ((pos - 7) % n + n) % n < 5")
def shard_slice(spark: SparkSession, sf: str) -> DataFrame:
    """Five rows of each source from the eighth on, going round at the end."""
    w = Window.partitionBy("source_id")
    rows = pool(spark, sf).select("source_id", "pool_id", (F.row_number().over(w.orderBy("pool_id")) - 1).alias("pos"), F.count("*").over(w).alias("n"))
    return rows.where(F.pmod(F.col("pos") - 7, F.col("n")) < 5).select("source_id", "pool_id")


@R.query("win_15_unique_names", "select doc_id, case when r = 1 then name else name || '_' || r end as name from (select doc_id, coalesce(lang, 'none') || '-' || n_chars as name, row_number() over (partition by coalesce(lang, 'none') || '-' || n_chars order by doc_id) as r from documents)")
def unique_names(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat_ws("-", F.coalesce("lang", F.lit("none")), "n_chars")
    rows = read(spark, sf, "documents").select("doc_id", name.alias("name"))
    r = F.row_number().over(Window.partitionBy("name").orderBy("doc_id"))
    return rows.withColumn("r", r).select("doc_id", F.when(F.col("r") == 1, F.col("name")).otherwise(F.concat_ws("_", "name", "r")).alias("name"))


@R.query(
    "win_16_forward_fill",
    "select snapshot_no, round_index, last_value(case when isfinite(health_score) then health_score end ignore nulls) over (partition by round_index order by snapshot_no rows between unbounded preceding and current row) as health from (select distinct snapshot_no, round_index, health_score from round_metrics)",
)
def forward_fill(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "round_metrics").select("snapshot_no", "round_index", finite(F.col("health_score")).alias("h")).distinct()
    w = Window.partitionBy("round_index").orderBy("snapshot_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("snapshot_no", "round_index", F.last("h", True).over(w).alias("health"))


@R.query("win_17_circular_lead", f"with {POOL} select pool_id, coalesce(lead(pool_id, 2) over w, first_value(pool_id) over w) as other from pool window w as (partition by source_id, known_type order by pool_id rows between unbounded preceding and unbounded following)")
def circular_lead(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("source_id", "known_type").orderBy("pool_id")
    return pool(spark, sf).select("pool_id", F.coalesce(F.lead("pool_id", 2).over(w), F.first("pool_id").over(w)).alias("other"))
