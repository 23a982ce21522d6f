"""Aggregation queries (AGG)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.exprs import bell, clamp, finite, finite_or, first_reason, or_else, reasons, role_matches, row_spread
from millrace.operators.stats import auc, describe, entropy_bucket, first_mode, geometric_mean, pearson, weighted_average
from millrace.plans.base import CAND, POOL, REC, Registry, candidates, pool, r6, read, records

R = Registry()
QUERIES, SQL = R.QUERIES, R.SQL

GATES = {"edit": 0.35, "preservation": 0.4, "validity": 0.45, "raw": 0.3}
TOP = 2


def gates(bounds: dict[str, float] = GATES) -> list[tuple[str, Column]]:
    return [(name, finite_or(F.col(name), 0.0) < least) for name, least in bounds.items()]


SQL_GATES = " and ".join(f"coalesce({n}, 0.0) >= {v}" for n, v in GATES.items())
_D = "round({0}, 6) as {1}"


@R.query(
    "agg_1_describe",
    f"""with {CAND} select edit_type, count(score) as count, min(score) as min, round(quantile_cont(score, 0.1), 6) as p10, round(quantile_cont(score, 0.25), 6) as p25, round(quantile_cont(score, 0.5), 6) as p50,
    round(quantile_cont(score, 0.75), 6) as p75, round(quantile_cont(score, 0.9), 6) as p90, round(avg(score), 6) as mean, max(score) as max, round(stddev_pop(score), 6) as std from cand group by edit_type""",
)
def describe_scores(spark: SparkSession, sf: str) -> DataFrame:
    out = describe(candidates(spark, sf), ["edit_type"], "score")
    return out.select("edit_type", "count", "min", "max", *[r6(F.col(c)).alias(c) for c in ("p10", "p25", "p50", "p75", "p90", "mean", "std")])


@R.query(
    "agg_2_finite_scores",
    "select source_id, count(*) as n, count(*) filter (isfinite(total_score)) as finite, count(*) filter (total_score is null) as missing, round(avg(total_score) filter (isfinite(total_score)), 6) as mean from pool_candidates group by source_id",
)
def finite_scores(spark: SparkSession, sf: str) -> DataFrame:
    x = finite(F.col("total_score"))
    return read(spark, sf, "pool_candidates").groupBy("source_id").agg(F.count("*").alias("n"), F.count(x).alias("finite"), F.count_if(F.col("total_score").isNull()).alias("missing"), r6(F.avg(x)).alias("mean"))


_CORR = "case when count({x}) filter (score is not null) >= 2 then round(covar_pop({x}, score) / nullif(stddev_pop({x}) filter (score is not null) * stddev_pop(score) filter ({x} is not null), 0), 6) end as {x}"


@R.query("agg_3_correlation", f"with {CAND} select edit_type, {', '.join(_CORR.format(x=x) for x in ('edit', 'preservation', 'validity', 'raw'))} from cand group by edit_type")
def correlation(spark: SparkSession, sf: str) -> DataFrame:
    return candidates(spark, sf).groupBy("edit_type").agg(*[r6(pearson(F.col(x), F.col("score"))).alias(x) for x in ("edit", "preservation", "validity", "raw")])


def accepted_by_threshold(rows: DataFrame, bounds: dict[str, float], top: int) -> DataFrame:
    """Rows with ``feasible`` and ``taken``: the ``top`` best feasible rows of each group."""
    ok = rows.withColumn("feasible", F.size(reasons(gates(bounds))) == 0)
    rank = Window.partitionBy("group_id", "feasible").orderBy(F.desc_nulls_last("raw"), "candidate_index")
    return ok.withColumn("taken", F.col("feasible") & (F.row_number().over(rank) <= top))


@R.query(
    "agg_4_threshold_acceptance",
    f"""with {CAND}, ok as (select *, {SQL_GATES} as feasible from cand where trim(group_id) <> ''),
    ranked as (select *, feasible and row_number() over (partition by group_id, feasible order by raw desc nulls last, candidate_index) <= {TOP} as taken from ok)
    select count(distinct group_id) as groups, count(*) as candidates, count(*) filter (feasible) as feasible, count(*) filter (taken) as accepted, count(distinct case when taken then group_id end) as groups_with_one,
    round(count(*) filter (taken) / greatest(count(*), 1), 6) as accept_rate, round(count(distinct case when taken then group_id end) / greatest(count(distinct group_id), 1), 6) as group_rate from ranked""",
)
def threshold_acceptance(spark: SparkSession, sf: str) -> DataFrame:
    taken = accepted_by_threshold(candidates(spark, sf).where("trim(group_id) != ''"), GATES, TOP)
    by_group = taken.groupBy("group_id").agg(F.count("*").alias("n"), F.count_if(F.col("feasible")).alias("f"), F.count_if(F.col("taken")).alias("t"))
    return by_group.agg(
        F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("candidates"), F.coalesce(F.sum("f"), F.lit(0)).alias("feasible"), F.coalesce(F.sum("t"), F.lit(0)).alias("accepted"), F.count_if(F.expr("t > 0")).alias("groups_with_one"),
        r6(F.try_divide(F.coalesce(F.sum("t"), F.lit(0)).cast("double"), F.greatest(F.coalesce(F.sum("n"), F.lit(0)), F.lit(1)))).alias("accept_rate"), r6(F.count_if(F.expr("t > 0")) / F.greatest(F.count("*"), F.lit(1))).alias("group_rate"),
    )


GRID = {"edit": (0.2, 0.35, 0.5), "preservation": (0.3, 0.5), "raw": (0.2, 0.4, 0.6)}


@R.query(
    "agg_5_threshold_sweep",
    f"""with {CAND}, grid as (select * from (values {", ".join(f"({x}::double)" for x in GRID["edit"])}) a(min_edit), (values {", ".join(f"({x}::double)" for x in GRID["preservation"])}) b(min_preservation), (values {", ".join(f"({x}::double)" for x in GRID["raw"])}) c(min_raw)),
    hit as (select min_edit, min_preservation, min_raw, group_id, count(*) filter (coalesce(edit, 0) >= min_edit and coalesce(preservation, 0) >= min_preservation and coalesce(raw, 0) >= min_raw) as f
      from cand, grid where trim(group_id) <> '' group by all)
    select min_edit, min_preservation, min_raw, count(*) as groups, sum(f)::bigint as feasible, count(*) filter (f > 0) as groups_with_one from hit group by all""",
)
def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Every setting of the grid in one pass: a candidate is expanded to settings, counted per group before the shuffle."""
    points = [F.struct(F.lit(a).alias("min_edit"), F.lit(b).alias("min_preservation"), F.lit(c).alias("min_raw")) for a in GRID["edit"] for b in GRID["preservation"] for c in GRID["raw"]]
    rows = candidates(spark, sf).where("trim(group_id) != ''").select("group_id", *[finite_or(F.col(x), 0.0).alias(x) for x in GRID], F.explode(F.array(*points)).alias("g"))
    ok = (F.col("edit") >= F.col("g.min_edit")) & (F.col("preservation") >= F.col("g.min_preservation")) & (F.col("raw") >= F.col("g.min_raw"))
    by_group = rows.groupBy("g", "group_id").agg(F.count_if(ok).alias("f"))
    return by_group.groupBy("g").agg(F.count("*").alias("groups"), F.sum("f").alias("feasible"), F.count_if(F.expr("f > 0")).alias("groups_with_one")).select("g.*", "groups", "feasible", "groups_with_one")


_FAIL = "list_filter([" + ", ".join(f"case when coalesce({n}, 0.0) < {v} then '{n}' end" for n, v in GATES.items()) + "], lambda x: x is not null)"


@R.query(
    "agg_6_counters",
    f"""with {CAND}, f as (select *, {_FAIL} as failed from cand)
    select 'status' as axis, status as value, count(*) as n from f group by all union all select 'family', family, count(*) from f group by all
    union all select 'failure', unnest(failed) as v, count(*) from f group by v union all select 'first_failure', failed[1] as v, count(*) from f where len(failed) > 0 group by v""",
)
def counters(spark: SparkSession, sf: str) -> DataFrame:
    """All counters in one shuffle: each row is expanded to (axis, value), counted before the shuffle."""
    failed = reasons(gates())
    tag = lambda axis, x: F.struct(F.lit(axis).alias("axis"), x.alias("value"))
    several = F.concat(F.array(tag("status", F.col("status")), tag("family", F.col("family"))), F.transform(failed, lambda x: tag("failure", x)), F.transform(F.slice(failed, 1, 1), lambda x: tag("first_failure", x)))
    return candidates(spark, sf).select(F.explode(several).alias("c")).groupBy("c").agg(F.count("*").alias("n")).select("c.*", "n")


@R.query("agg_7_group_stats", f"with {CAND} select group_id, round(avg(raw), 6) as mean, round(median(raw), 6) as median, case when count(raw) <= 1 then 0.0 else round(stddev_pop(raw), 6) end as std from cand where trim(group_id) <> '' group by group_id")
def group_stats(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("raw")
    return candidates(spark, sf).where("trim(group_id) != ''").groupBy("group_id").agg(r6(F.avg(x)).alias("mean"), r6(F.median(x)).alias("median"), F.when(F.count(x) <= 1, 0.0).otherwise(r6(F.stddev_pop(x))).alias("std"))


@R.query("agg_8_median", f"with {POOL} select known_type, round(median(total_score) filter (isfinite(total_score)), 6) as median from pool group by known_type")
def medians(spark: SparkSession, sf: str) -> DataFrame:
    return pool(spark, sf).groupBy("known_type").agg(r6(F.median(finite(F.col("total_score")))).alias("median"))


@R.query(
    "agg_9_auc",
    f"""with {CAND}, r as (select edit_type, accepted as pos, rank() over (partition by edit_type order by raw) + (count(*) over (partition by edit_type, raw) - 1) / 2.0 as rk from cand where raw is not null)
    select edit_type, sum(pos::int)::bigint as positives, sum((not pos)::int)::bigint as negatives,
    round((sum(rk) filter (pos) - sum(pos::int) * (sum(pos::int) + 1) / 2.0) / nullif(sum(pos::int) * sum((not pos)::int), 0), 6) as auc from r group by edit_type""",
)
def auc_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return auc(candidates(spark, sf), ["edit_type"], "raw", "accepted").withColumn("auc", r6(F.col("auc")))


@R.query("agg_10_mean_or_zero", f"with {CAND} select group_id, round(coalesce(avg(drift), 0.0), 6) as drift from cand group by group_id")
def mean_or_zero(spark: SparkSession, sf: str) -> DataFrame:
    return candidates(spark, sf).groupBy("group_id").agg(r6(F.coalesce(F.avg("drift"), F.lit(0.0))).alias("drift"))


@R.query("agg_11_geometric_mean", f"with {CAND} select edit_type, round(coalesce(exp(avg(ln(least(greatest(raw, 1e-6), 1.0))) filter (raw is not null)), 0.0), 6) as gmean from cand group by edit_type")
def geometric_means(spark: SparkSession, sf: str) -> DataFrame:
    return candidates(spark, sf).groupBy("edit_type").agg(r6(geometric_mean(F.col("raw"))).alias("gmean"))


@R.query("agg_12_product_mean", f"with {CAND} select group_id, round(coalesce(exp(avg(ln(least(greatest(judge, 1e-6), 1.0))) filter (judge is not null)), 1.0), 6) as judge from cand group by group_id")
def product_means(spark: SparkSession, sf: str) -> DataFrame:
    """The product form: an empty group is neutral (1)."""
    x = geometric_mean(F.col("judge"))
    return candidates(spark, sf).groupBy("group_id").agg(r6(F.when(F.count("judge") == 0, 1.0).otherwise(x)).alias("judge"))


@R.query("agg_13_weighted_mean", f"with {CAND} select edit_type, round(coalesce(sum(score * level) filter (level > 0 and score is not null) / nullif(sum(level) filter (level > 0 and score is not null), 0), 0.0), 6) as mean from cand group by edit_type")
def weighted_means(spark: SparkSession, sf: str) -> DataFrame:
    return candidates(spark, sf).groupBy("edit_type").agg(r6(F.coalesce(weighted_average(F.col("score"), F.col("level")), F.lit(0.0))).alias("mean"))


@R.query("agg_14_row_spread", f"with {CAND} select group_id, candidate_index, case when len(list_filter([edit, preservation, validity], lambda x: x is not null)) <= 1 then 0.0 else round(list_stddev_pop(list_filter([edit, preservation, validity], lambda x: x is not null)), 6) end as spread from cand")
def row_spreads(spark: SparkSession, sf: str) -> DataFrame:
    return candidates(spark, sf).select("group_id", "candidate_index", r6(row_spread([F.col("edit"), F.col("preservation"), F.col("validity")])).alias("spread"))


@R.query(
    "agg_15_alignment",
    f"""with {CAND}, j as (select * from cand where trim(group_id) <> '' and judge is not null and raw is not null),
    t as (select group_id, arg_max(candidate_index, (raw, -candidate_index)) as by_raw, arg_max(candidate_index, (judge, -candidate_index)) as by_judge, arg_max(judge, (raw, -candidate_index)) as label from j group by group_id)
    select count(*) as groups, count(*) filter (by_raw = by_judge) as agree, round(sum(label), 6) as label_sum, count(*) filter (label < 0.5) as low_labels, round(avg((by_raw = by_judge)::int), 6) as agreement from t""",
)
def alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Does the score's first choice agree with the judge's, group by group?"""
    rows = candidates(spark, sf).where("trim(group_id) != '' and judge is not null and raw is not null")
    best = lambda x: F.struct(F.col(x), -F.col("candidate_index"))
    tops = rows.groupBy("group_id").agg(F.max_by("candidate_index", best("raw")).alias("by_raw"), F.max_by("candidate_index", best("judge")).alias("by_judge"), F.max_by("judge", best("raw")).alias("label"))
    same = F.col("by_raw") == F.col("by_judge")
    return tops.agg(F.count("*").alias("groups"), F.count_if(same).alias("agree"), r6(F.sum("label")).alias("label_sum"), F.count_if(F.expr("label < 0.5")).alias("low_labels"), r6(F.avg(same.cast("int"))).alias("agreement"))


@R.query(
    "agg_16_accepted_failures",
    f"""with {CAND} select count(*) as accepted, count(*) filter (changed < 0.1) as no_op, count(*) filter (drift > 0.6) as drifted, count(*) filter (judge < 0.5) as low_judge,
    round(count(*) filter (changed < 0.1) / greatest(count(*), 1), 6) as no_op_rate, round(count(*) filter (drift > 0.6) / greatest(count(*), 1), 6) as drift_rate from cand where accepted""",
)
def accepted_failures(spark: SparkSession, sf: str) -> DataFrame:
    n = F.greatest(F.count("*"), F.lit(1))
    no_op, drifted = F.count_if(F.expr("changed < 0.1")), F.count_if(F.expr("drift > 0.6"))
    return candidates(spark, sf).where("accepted").agg(F.count("*").alias("accepted"), no_op.alias("no_op"), drifted.alias("drifted"), F.count_if(F.expr("judge < 0.5")).alias("low_judge"), r6(no_op / n).alias("no_op_rate"), r6(drifted / n).alias("drift_rate"))


@R.query(
    "agg_17_entropy_buckets",
    f"""with {CAND}, g as (select group_id, avg(accepted::int) as rate, arg_min(edit_type, candidate_index) as edit_type from cand where trim(group_id) <> '' group by group_id)
    select edit_type, case when rate <= 0 then 'all_fail' when rate >= 1 then 'all_pass' when rate between 0.25 and 0.75 then 'productive' else 'edge' end as bucket, count(*) as n from g group by all""",
)
def entropy_buckets(spark: SparkSession, sf: str) -> DataFrame:
    groups = candidates(spark, sf).where("trim(group_id) != ''").groupBy("group_id").agg(F.avg(F.col("accepted").cast("int")).alias("rate"), F.min_by("edit_type", "candidate_index").alias("edit_type"))
    return groups.groupBy("edit_type", entropy_bucket(F.col("rate"), 0.25, 0.75).alias("bucket")).agg(F.count("*").alias("n"))


_FEEDBACK = "count(*) as candidates, count(*) filter (accepted) as accepted, round(coalesce(sum(raw), 0.0), 6) as quality_sum, round(count(*) filter (accepted) / count(*), 6) as accept_rate"


@R.query("agg_18_feedback", f"with {CAND} select base, edit_type, {_FEEDBACK}, round(0.5 + (count(*) filter (accepted) + 1) / (count(*) + 2), 6) as multiplier from cand where base is not null group by base, edit_type")
def feedback(spark: SparkSession, sf: str) -> DataFrame:
    return feedback_of(candidates(spark, sf).where("base is not null"))


def feedback_of(rows: DataFrame) -> DataFrame:
    """What earlier candidates say about a source and an edit type, with a smoothed utility multiplier."""
    hit = F.count_if(F.col("accepted"))
    return rows.groupBy("base", "edit_type").agg(
        F.count("*").alias("candidates"), hit.alias("accepted"), r6(F.coalesce(F.sum("raw"), F.lit(0.0))).alias("quality_sum"), r6(hit / F.count("*")).alias("accept_rate"), r6(0.5 + (hit + 1) / (F.count("*") + 2)).alias("multiplier")
    )


@R.query("agg_19_policy_feedback", f"with {CAND} select base, edit_type, {_FEEDBACK}, round(0.5 + (count(*) filter (accepted) + 1) / (count(*) + 2), 6) as multiplier from cand where base is not null and (candidate_role = 'policy' or candidate_role like 'policy:%') group by base, edit_type")
def policy_feedback(spark: SparkSession, sf: str) -> DataFrame:
    return feedback_of(candidates(spark, sf).where("base is not null").where(role_matches(F.col("candidate_role"), ["policy"])))


@R.query(
    "agg_20_round_metrics",
    """select round_index, max(groups_total) as groups_total, max(candidates_total) as candidates_total, round(avg(coalesce(nullif(group_acceptance_rate, 0), accepted_groups / nullif(groups_evaluated, 0))) filter (isfinite(coalesce(nullif(group_acceptance_rate, 0), accepted_groups / nullif(groups_evaluated, 0)))), 6) as rate
    from (select distinct * from round_metrics) group by round_index""",
)
def round_report(spark: SparkSession, sf: str) -> DataFrame:
    rate = or_else(F.col("group_acceptance_rate"), F.try_divide(F.col("accepted_groups").cast("double"), F.nullif(F.col("groups_evaluated"), F.lit(0))))
    return read(spark, sf, "round_metrics").distinct().groupBy("round_index").agg(F.max("groups_total").alias("groups_total"), F.max("candidates_total").alias("candidates_total"), r6(F.avg(finite(rate))).alias("rate"))


@R.query("agg_21_group_status", f"with {CAND}, g as (select group_id, bool_or(status = 'accepted') as hit, bool_and(status in ('accepted', 'rejected')) as finished from cand where trim(group_id) <> '' group by group_id) select count(*) as groups, count(*) filter (hit) as accepted_groups, count(*) filter (finished) as finished_groups from g")
def group_status(spark: SparkSession, sf: str) -> DataFrame:
    groups = candidates(spark, sf).where("trim(group_id) != ''").groupBy("group_id").agg(F.bool_or(F.col("status") == "accepted").alias("hit"), F.bool_and(F.col("status").isin("accepted", "rejected")).alias("finished"))
    return groups.agg(F.count("*").alias("groups"), F.count_if(F.col("hit")).alias("accepted_groups"), F.count_if(F.col("finished")).alias("finished_groups"))


@R.query(
    "agg_22_balance_counts",
    f"""with {POOL}, b as (select coalesce(known_type, 'unknown') as edit_type, count(*) as before from pool group by all)
    select edit_type, before, least(before, 40) as after, greatest(60 - before, 0) as missing from b""",
)
def balance_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts per type before and after a cap of 40, and what lacks to a minimum of 60."""
    counts = pool(spark, sf).groupBy(F.coalesce("known_type", F.lit("unknown")).alias("edit_type")).agg(F.count("*").alias("before"))
    return counts.select("edit_type", "before", F.least("before", F.lit(40).cast("bigint")).alias("after"), F.greatest(60 - F.col("before"), F.lit(0).cast("bigint")).alias("missing"))


@R.query("agg_23_training_summary", f"with {CAND} select family, edit_type, count(*) as samples, round(sum(coalesce(score, 0.0)), 6) as weight_sum, round(sum(coalesce(score, 0.0)) / greatest(count(distinct group_id), 1), 6) as weight_per_group from cand where accepted group by family, edit_type")
def training_summary(spark: SparkSession, sf: str) -> DataFrame:
    w = F.sum(F.coalesce("score", F.lit(0.0)))
    return candidates(spark, sf).where("accepted").groupBy("family", "edit_type").agg(F.count("*").alias("samples"), r6(w).alias("weight_sum"), r6(w / F.greatest(F.count_distinct("group_id"), F.lit(1))).alias("weight_per_group"))


@R.query(
    "agg_24_group_reward",
    f"""with {CAND}, g as (select group_id, count(*) as n, avg(accepted::int) as rate, max(raw) as best, avg(coalesce(drift, 0.0)) as drift from cand where trim(group_id) <> '' group by group_id)
    select group_id, n, round(least(greatest(0.5 * exp(-power(rate - 0.5, 2) / (2 * 0.25 * 0.25)) + 0.5 * coalesce(best, 0.0) - 0.2 * drift, 0.0), 1.0), 6) as reward from g""",
)
def group_reward(spark: SparkSession, sf: str) -> DataFrame:
    """Groups that are neither all failed nor all passed are worth most."""
    groups = candidates(spark, sf).where("trim(group_id) != ''").groupBy("group_id").agg(F.count("*").alias("n"), F.avg(F.col("accepted").cast("int")).alias("rate"), F.max("raw").alias("best"), F.avg(F.coalesce("drift", F.lit(0.0))).alias("drift"))
    value = 0.5 * bell(F.col("rate"), 0.5, 0.25) + 0.5 * F.coalesce("best", F.lit(0.0)) - 0.2 * F.col("drift")
    return groups.select("group_id", "n", r6(clamp(value)).alias("reward"))


@R.query(
    "agg_25_map_average",
    "with e as (select proposal.round_index as round, unnest(map_entries(evaluator.component_scores)) as c from candidate_log) select round, c.key as name, count(*) as n, round(avg(c.value) filter (isfinite(c.value)), 6) as mean from e group by all",
)
def map_average(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "candidate_log").select(F.col("proposal.round_index").alias("round"), F.explode("evaluator.component_scores").alias("name", "value"))
    return rows.groupBy("round", "name").agg(F.count("*").alias("n"), r6(F.avg(finite(F.col("value")))).alias("mean"))


@R.query("agg_26_micro_average", f"with {CAND} select edit_type, count(score) as n, round(avg(score), 6) as mean from cand group by grouping sets ((edit_type), ())")
def micro_average(spark: SparkSession, sf: str) -> DataFrame:
    return candidates(spark, sf).rollup("edit_type").agg(F.count("score").alias("n"), r6(F.avg("score")).alias("mean"))


@R.query("agg_27_mean_of_values", "select pool_id, scored_at, round(list_avg(map_values(opportunities)), 6) as mean from pool_candidates")
def mean_of_values(spark: SparkSession, sf: str) -> DataFrame:
    values = F.map_values("opportunities")
    return read(spark, sf, "pool_candidates").select("pool_id", "scored_at", r6(F.try_divide(F.aggregate(values, F.lit(0.0), lambda s, x: s + x), F.size(values))).alias("mean"))


@R.query(
    "agg_28_macro_average",
    f"""with {CAND}, p as (select family, group_id, bool_or(accepted) as hit, avg(accepted::int) as rate, count(*) as n, count(*) filter (accepted) as k from cand where trim(group_id) <> '' group by all),
    f as (select family, avg(hit::int) as prompt_rate, sum(k) / sum(n) as image_rate from p group by family)
    select round((select sum(k) / sum(n) from p), 6) as image_rate, round((select avg(hit::int) from p), 6) as any_rate, round(avg(image_rate), 6) as macro_image_rate, round(avg(prompt_rate), 6) as macro_any_rate from f""",
)
def macro_average(spark: SparkSession, sf: str) -> DataFrame:
    """Image rate, any-correct rate per prompt, and both as averages over families."""
    groups = candidates(spark, sf).where("trim(group_id) != ''").groupBy("family", "group_id").agg(F.count("*").alias("n"), F.count_if(F.col("accepted")).alias("k"))
    families = groups.groupBy("family").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count("*").alias("g"), F.count_if(F.expr("k > 0")).alias("h"))
    return families.agg(r6(F.sum("k") / F.sum("n")).alias("image_rate"), r6(F.sum("h") / F.sum("g")).alias("any_rate"), r6(F.avg(F.col("k") / F.col("n"))).alias("macro_image_rate"), r6(F.avg(F.col("h") / F.col("g"))).alias("macro_any_rate"))


@R.query("agg_29_core_average", f"with {CAND} select round((coalesce(avg(edit), 0) + coalesce(avg(preservation), 0) + coalesce(avg(validity), 0) + coalesce(avg(rubric), 0) + coalesce(avg(judge), 0)) / 5, 6) as core from cand")
def core_average(spark: SparkSession, sf: str) -> DataFrame:
    return candidates(spark, sf).agg(r6(sum((F.coalesce(F.avg(c), F.lit(0.0)) for c in ("edit", "preservation", "validity", "rubric", "judge")), F.lit(0.0)) / 5).alias("core"))


_PAIRED = f"with {POOL}, o as (select source_id, avg(sort_score) filter (isfinite(sort_score)) as a, avg(total_score) filter (isfinite(total_score)) as b from pool group by source_id)"


@R.query("agg_30_win_tie_loss", f"{_PAIRED} select count(*) as n, round(avg(a), 6) as mean_a, round(avg(b), 6) as mean_b, round(avg(b - a), 6) as delta, count(*) filter (b > a) as wins, count(*) filter (a = b) as ties, count(*) filter (b < a) as losses from o where a is not null and b is not null")
def win_tie_loss(spark: SparkSession, sf: str) -> DataFrame:
    two = pool(spark, sf).groupBy("source_id").agg(F.avg(finite(F.col("sort_score"))).alias("a"), F.avg(finite(F.col("total_score"))).alias("b")).where("a is not null and b is not null")
    return two.agg(F.count("*").alias("n"), r6(F.avg("a")).alias("mean_a"), r6(F.avg("b")).alias("mean_b"), r6(F.avg(F.col("b") - F.col("a"))).alias("delta"), F.count_if(F.expr("b > a")).alias("wins"), F.count_if(F.expr("a = b")).alias("ties"), F.count_if(F.expr("b < a")).alias("losses"))


@R.query("agg_31_ablation", f"with {CAND} select family, count(*) filter (status = 'accepted') as accepted, count(*) filter (status = 'rejected') as rejected, count(*) filter (status = 'generated') as generated, count(*) filter (status = 'accepted' and (changed < 0.1 or drift > 0.6)) as false_accepts from cand group by family")
def ablation(spark: SparkSession, sf: str) -> DataFrame:
    return candidates(spark, sf).groupBy("family").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("accepted", "rejected", "generated")], F.count_if(F.expr("status = 'accepted' and (changed < 0.1 or drift > 0.6)")).alias("false_accepts"))


_REASON = "case " + " ".join(f"when coalesce({n}, 0.0) < {v} then '{n}'" for n, v in GATES.items()) + " end"


@R.query("agg_32_reasons_by_type", f"with {CAND}, f as (select edit_type, {_REASON} as reason from cand) select edit_type, reason, grouping(edit_type)::int as overall, count(*) as n from f where reason is not null group by grouping sets ((reason), (edit_type, reason))")
def reasons_by_type(spark: SparkSession, sf: str) -> DataFrame:
    found = candidates(spark, sf).select("edit_type", first_reason(gates()).alias("reason")).where("reason is not null")
    found.createOrReplaceTempView("__reasons")
    return spark.sql("select edit_type, reason, cast(grouping(edit_type) as int) as overall, count(*) as n from __reasons group by grouping sets ((reason), (edit_type, reason))")


@R.query("agg_33_type_audit", f"with {CAND} select edit_type, count(*) as n, count(*) filter (accepted) as accepted, count(*) filter (judge < 0.5) as low_judge, round(avg(edit), 6) as edit, round(avg(preservation), 6) as preservation from cand group by edit_type order by n desc, edit_type")
def type_audit(spark: SparkSession, sf: str) -> DataFrame:
    out = candidates(spark, sf).groupBy("edit_type").agg(F.count("*").alias("n"), F.count_if(F.col("accepted")).alias("accepted"), F.count_if(F.expr("judge < 0.5")).alias("low_judge"), r6(F.avg("edit")).alias("edit"), r6(F.avg("preservation")).alias("preservation"))
    return out.orderBy(F.desc("n"), "edit_type")


@R.query("agg_34_family_counts", f"with {REC}, f as (select lower(trim(unnest(edit_families))) as family from rec where len(edit_families) > 0) select family, count(*) as n from f where family <> '' group by family order by n desc, family limit 12")
def family_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = records(spark, sf).select(F.explode("edit_families").alias("f")).select(F.lower(F.trim("f")).alias("family")).where("family != ''")
    return rows.groupBy("family").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "family").limit(12)


@R.query("agg_35_status_shares", f"with {CAND} select status, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from cand group by status")
def status_shares(spark: SparkSession, sf: str) -> DataFrame:
    counts = candidates(spark, sf).groupBy("status").agg(F.count("*").alias("n"))  # a row per status
    return counts.withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy())))


@R.query("agg_36_gate_breakdown", f"with {CAND}, f as (select {_REASON} as reason from cand) select coalesce(reason, 'passed') as reason, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from f group by all")
def gate_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    counts = candidates(spark, sf).groupBy(first_reason(gates(), "passed").alias("reason")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy())))


@R.query("agg_37_type_deltas", f"with {POOL}, {CAND}, a as (select known_type as edit_type, avg(total_score) filter (isfinite(total_score)) as x from pool group by all), b as (select edit_type, avg(score) as y from cand group by all) select edit_type, round(y - x, 6) as delta from a join b using (edit_type) order by delta")
def type_deltas(spark: SparkSession, sf: str) -> DataFrame:
    a = pool(spark, sf).groupBy(F.col("known_type").alias("edit_type")).agg(F.avg(finite(F.col("total_score"))).alias("x"))
    b = candidates(spark, sf).groupBy("edit_type").agg(F.avg("score").alias("y"))
    return a.join(b, "edit_type").select("edit_type", r6(F.col("y") - F.col("x")).alias("delta")).orderBy("delta")


@R.query("agg_38_gate_redundancy", f"with {CAND} select len({_FAIL})::int as failed, count(*) as candidates from cand group by all")
def gate_redundancy(spark: SparkSession, sf: str) -> DataFrame:
    return candidates(spark, sf).groupBy(F.size(reasons(gates())).alias("failed")).agg(F.count("*").alias("candidates"))


@R.query(
    "agg_39_headroom",
    f"""with {CAND}, t as (select max(raw) filter (not accepted and changed < 0.1) as worst from cand)
    select round(worst, 6) as max_negative, round(worst + 0.01, 6) as safe_floor, (select count(*) from cand where raw >= 0.6) as passing_now, (select count(*) from cand, t where raw >= t.worst + 0.01) as passing_at_floor from t""",
)
def headroom(spark: SparkSession, sf: str) -> DataFrame:
    """How far a threshold could fall before the best known failure passed; scores are counted by value, so it is one pass."""
    rows = candidates(spark, sf)
    bad = F.max(F.when(~F.col("accepted") & (F.col("changed") < 0.1), F.col("raw")))
    levels = rows.groupBy("raw").agg(F.count("*").alias("n"), bad.alias("bad"))
    worst = levels.agg(F.max("bad").alias("worst"))  # one row
    joined = levels.crossJoin(F.broadcast(worst))
    return joined.groupBy("worst").agg(F.coalesce(F.sum(F.when(F.col("raw") >= 0.6, F.col("n"))), F.lit(0)).alias("passing_now"), F.coalesce(F.sum(F.when(F.col("raw") >= F.col("worst") + 0.01, F.col("n"))), F.lit(0)).alias("passing_at_floor")).select(
        r6(F.col("worst")).alias("max_negative"), r6(F.col("worst") + 0.01).alias("safe_floor"), "passing_now", "passing_at_floor"
    )


@R.query("agg_40_class_by_type", f"with {CAND} select edit_type, status, count(*) as n, round(avg(raw), 6) as mean_reward, round(avg(accepted::int), 6) as accept_rate from cand where status is not null group by grouping sets ((edit_type, status), (status))")
def class_by_type(spark: SparkSession, sf: str) -> DataFrame:
    candidates(spark, sf).where("status is not null").createOrReplaceTempView("__classes")
    return spark.sql("select edit_type, status, count(*) as n, round(avg(raw), 6) as mean_reward, round(avg(cast(accepted as int)), 6) as accept_rate from __classes group by grouping sets ((edit_type, status), (status))")


@R.query("agg_41_histogram_of_histogram", f"with {POOL}, c as (select source_key, count(*) as per_source from pool group by source_key) select per_source, count(*) as sources from c group by per_source")
def histogram_of_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return pool(spark, sf).groupBy("source_key").agg(F.count("*").alias("per_source")).groupBy("per_source").agg(F.count("*").alias("sources"))


@R.query("agg_42_reject_counts", f"with {REC}, r as (select unnest(reject_reasons) as reason from rec) select reason, count(*) as n from r group by reason")
def reject_counts(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).select(F.explode("reject_reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@R.query(
    "agg_43_first_mode",
    f"with {CAND}, c as (select base, edit_type, count(*) as n, min((coalesce(group_id, ''), candidate_index)) as first from cand group by all) select base, edit_type, n from (select *, row_number() over (partition by base order by n desc, first) as r from c) where r = 1",
)
def mode_by_base(spark: SparkSession, sf: str) -> DataFrame:
    return first_mode(candidates(spark, sf), ["base"], "edit_type", [F.coalesce("group_id", F.lit("")).alias("g"), F.col("candidate_index")])


@R.query(
    "agg_44_digits_average",
    r"""with d as (select doc_id, list_transform(regexp_extract_all(text, '\b[01]\.[0-9]+\b'), lambda x: x::double) as v from documents) select doc_id, len(v)::int as n, round(list_avg(v), 6) as mean from d where len(v) > 0""",
)
def digits_average(spark: SparkSession, sf: str) -> DataFrame:
    v = F.transform(F.regexp_extract_all("text", F.lit(r"\b[01]\.[0-9]+\b"), F.lit(0)), lambda x: x.cast("double"))
    return read(spark, sf, "documents").select("doc_id", v.alias("v")).where("size(v) > 0").select("doc_id", F.size("v").alias("n"), r6(F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / F.size("v")).alias("mean"))

