"""Set, dedupe, union and replay queries (SET)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.exprs import finite, finite_or
from millrace.operators.sets import first_by, ordered_distinct, overlay, replay
from millrace.plans.base import CAND, POOL, REC, Registry, candidates, pool, read, records

R = Registry()
QUERIES, SQL = R.QUERIES, R.SQL


@R.query("set_1_dedupe_best", f"with {POOL} select source_key, known_type, pool_id from (select *, row_number() over (partition by source_key, known_type order by case when isfinite(total_score) then total_score end desc nulls last, pool_id) as r from pool) where r = 1")
def dedupe_best(spark: SparkSession, sf: str) -> DataFrame:
    return first_by(pool(spark, sf), ["source_key", "known_type"], [F.desc_nulls_last(finite(F.col("total_score"))), F.col("pool_id")]).select("source_key", "known_type", "pool_id")


@R.query("set_2_compaction", f"with {CAND} select group_id, candidate_index, status, score from cand order by group_id, candidate_index")
def compaction(spark: SparkSession, sf: str) -> DataFrame:
    """The log's last row per candidate."""
    return candidates(spark, sf).select("group_id", "candidate_index", "status", "score").orderBy("group_id", "candidate_index")


@R.query("set_3_first_accepted", "select group_id, candidate_index, logged_at from (select *, row_number() over (partition by group_id, candidate_index order by logged_at, log_seq) as r from candidate_log where status = 'accepted') where r = 1")
def first_accepted(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "candidate_log").where("status = 'accepted'").select("group_id", "candidate_index", "logged_at", "log_seq")
    return first_by(rows, ["group_id", "candidate_index"], [F.col("logged_at"), F.col("log_seq")]).drop("log_seq")


@R.query("set_4_max_score", f"with {POOL} select source_key, max(coalesce(case when isfinite(total_score) then total_score end, 0.0)) as score from pool group by source_key")
def max_score(spark: SparkSession, sf: str) -> DataFrame:
    return pool(spark, sf).groupBy("source_key").agg(F.max(finite_or(F.col("total_score"), 0.0)).alias("score"))


_REPLAY = "d as (select distinct base from cand where accepted and base is not null order by base limit {n}), p as (select base, row_number() over (order by base) - 1 as pos, count(*) over () as n from d) select base, g.turn::int as turn from p, range(0, {n}) g(turn) where pos + g.turn * n < {n}"


@R.query("set_5_replay", f"with {CAND}, {_REPLAY.format(n=300)}")
def replay_rows(spark: SparkSession, sf: str) -> DataFrame:
    return replay(candidates(spark, sf).where("accepted"), "base", 300)


@R.query("set_6_anchors", f"with {CAND} select base, group_id, candidate_index from (select *, row_number() over (partition by base order by score, coalesce(group_id, ''), candidate_index) as r from cand where status = 'rejected' and score is not null and base is not null) where r = 1 order by base limit 60")
def anchors(spark: SparkSession, sf: str) -> DataFrame:
    rows = candidates(spark, sf).where("status = 'rejected' and score is not null and base is not null")
    return first_by(rows, ["base"], [F.col("score"), F.coalesce("group_id", F.lit("")), F.col("candidate_index")]).select("base", "group_id", "candidate_index").orderBy("base").limit(60)


@R.query("set_7_even_replay", f"with {CAND}, {_REPLAY.format(n=12)}")
def even_replay(spark: SparkSession, sf: str) -> DataFrame:
    return replay(candidates(spark, sf).where("accepted"), "base", 12)


@R.query("set_8_intersection", f"with {REC} select key from rec intersect select record_key from candidate_log")
def intersection(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).select("key").join(read(spark, sf, "candidate_log").select(F.col("record_key").alias("key")), "key", "left_semi")


@R.query("set_9_distinct_pairs", f"with {CAND} select base, edit_type, status, accepted, min(group_id) as group_id from cand where trim(group_id) <> '' group by all")
def distinct_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return candidates(spark, sf).where("trim(group_id) != ''").groupBy("base", "edit_type", "status", "accepted").agg(F.min("group_id").alias("group_id"))


@R.query("set_10_tagged_union", f"with {POOL}, {REC} select 'pool' as origin, pool_id::varchar as id, batch, null::varchar as caption from pool union all select 'record', key, batch, caption from rec")
def tagged_union(spark: SparkSession, sf: str) -> DataFrame:
    a = pool(spark, sf).select(F.lit("pool").alias("origin"), F.col("pool_id").cast("string").alias("id"), "batch")
    b = records(spark, sf).select(F.lit("record").alias("origin"), F.col("key").alias("id"), "batch", "caption")
    return a.unionByName(b, allowMissingColumns=True)


@R.query("set_11_repeat", "select t.category, g.k::int as k from sample_targets t, range(0, 9) g(k) where g.k < t.min_keep")
def repeat(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "sample_targets").where("min_keep > 0").select("category", F.explode(F.sequence(F.lit(0), F.col("min_keep") - 1)).alias("k"))


@R.query("set_12_variants", f"with {CAND} select group_id, candidate_index, unnest(['plain', 'strict']) as variant from cand where accepted")
def variants(spark: SparkSession, sf: str) -> DataFrame:
    return candidates(spark, sf).where("accepted").select("group_id", "candidate_index", F.explode(F.array(F.lit("plain"), F.lit("strict"))).alias("variant"))


@R.query("set_13_contract_variants", f"with {CAND} select group_id, candidate_index, unnest(case when edit_type = 'unknown' then ['plain'] else ['plain', 'contract:' || edit_type] end) as variant from cand where accepted")
def contract_variants(spark: SparkSession, sf: str) -> DataFrame:
    both = F.when(F.col("edit_type") == "unknown", F.array(F.lit("plain"))).otherwise(F.array(F.lit("plain"), F.concat(F.lit("contract:"), "edit_type")))
    return candidates(spark, sf).where("accepted").select("group_id", "candidate_index", F.explode(both).alias("variant"))


@R.query(
    "set_14_ordered_distinct",
    f"with {REC}, e as (select key, unnest(entities) as e, generate_subscripts(entities, 1) as pos from rec), f as (select key, lower(e) as l, min(pos) as pos, arg_min(e, pos) as e from e where e is not null group by key, lower(e)) select key, string_agg(e, '|' order by pos) as entities from f group by key",
)
def distinct_entities(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).select("key", ordered_distinct(F.col("entities")).alias("e")).where("size(e) > 0").select("key", F.array_join("e", "|").alias("entities"))


@R.query(
    "set_15_capped_distinct",
    f"with {REC}, e as (select key, unnest(entities) as e, generate_subscripts(entities, 1) as pos from rec), f as (select key, lower(e) as l, min(pos) as pos, arg_min(e, pos) as e from e where e is not null group by key, lower(e)), g as (select *, row_number() over (partition by key order by pos) as r from f) select key, string_agg(e, '|' order by pos) as entities from g where r <= 2 group by key",
)
def capped_entities(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).select("key", ordered_distinct(F.col("entities"), 2).alias("e")).where("size(e) > 0").select("key", F.array_join("e", "|").alias("entities"))


@R.query("set_16_content_hash", "select sha256(coalesce(text, '')) as digest, min(doc_id) as doc_id, count(*) as copies from documents group by all")
def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@R.query("set_17_overlay", f"with {CAND}, a as (select base, edit_type, max(score) as score from cand where round = 0 group by all), b as (select base, edit_type, max(score) as score from cand where round <> 0 group by all) select base, edit_type, coalesce(b.score, a.score) as score from a full join b using (base, edit_type)")
def overlaid(spark: SparkSession, sf: str) -> DataFrame:
    rows = candidates(spark, sf)
    best = lambda where: rows.where(where).groupBy("base", "edit_type").agg(F.max("score").alias("score"))
    return overlay(best("round = 0"), best("round != 0"), ["base", "edit_type"], "score")


@R.query("set_18_cumulative", f"with {CAND}, r as (select round, count(*) filter (accepted) as accepted from cand where round is not null group by round) select round, accepted, (sum(accepted) over (order by round))::bigint as so_far from r")
def cumulative(spark: SparkSession, sf: str) -> DataFrame:


    counts = candidates(spark, sf).where("round is not null").groupBy("round").agg(F.count_if(F.col("accepted")).alias("accepted"))  # a row per round
    return counts.withColumn("so_far", F.sum("accepted").over(Window.orderBy("round").rowsBetween(Window.unboundedPreceding, 0)))


