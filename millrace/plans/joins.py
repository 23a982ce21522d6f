"""Join queries (JOIN)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.exprs import filled, finite
from millrace.functions.text import base_key
from millrace.operators.joins import best_against_rest, best_rows, fallback_join, hardest_pairs, sign_neighbours
from millrace.operators.stats import auc, label_pair_accuracy
from millrace.plans.aggregates import feedback_of
from millrace.plans.base import CAND, POOL, REC, Registry, candidates, pool, r6, read, records, whole_list

R = Registry()
QUERIES, SQL = R.QUERIES, R.SQL
C = F.col


@R.query("join_1_sidecar", f"with {REC} select d.doc_id, r.batch, r.score from documents d left join rec r on r.key = d.record_key")
def sidecar(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with the metadata of their record."""
    side = records(spark, sf).select(F.col("key").alias("record_key"), "batch", "score")
    return read(spark, sf, "documents").select("doc_id", "record_key").join(side, "record_key", "left").select("doc_id", "batch", "score")


@R.query(
    "join_2_fallback",
    f"""with {POOL}, {REC}, k as (select key, caption, image from rec),
    b as (select split_part(key, '__reward_pool__', 1) as base, arg_max(caption, key) as caption from rec where caption is not null group by all)
    select p.pool_id, coalesce(k.caption, b.caption) as caption, case when k.key is not null then 'key' when b.base is not null then 'second' end as matched_by
    from pool p left join (select key, caption from rec where caption is not null) k on k.key = p.source_key left join b on b.base = split_part(p.source_key, '__reward_pool__', 1)""",
)
def fallback(spark: SparkSession, sf: str) -> DataFrame:
    left = pool(spark, sf).select("pool_id", "source_key", base_key(F.col("source_key")).alias("base"))
    right = records(spark, sf).where("caption is not null").select("key", base_key(F.col("key")).alias("rbase"), "caption")
    return fallback_join(left, right, ("source_key", "key"), ("base", "rbase"), ["caption"], [F.desc("key")]).select("pool_id", "caption", "matched_by")


@R.query(
    "join_3_feedback",
    f"""with {POOL}, {CAND}, f as (select base, edit_type, round(0.5 + (count(*) filter (accepted) + 1) / (count(*) + 2), 6) as multiplier from cand where base is not null group by all)
    select p.pool_id, coalesce(f.multiplier, 1.0) as multiplier from pool p left join f on f.base = p.source_key and f.edit_type = p.known_type""",
)
def feedback_join(spark: SparkSession, sf: str) -> DataFrame:
    known = feedback_of(candidates(spark, sf).where("base is not null")).select(F.col("base").alias("source_key"), F.col("edit_type").alias("known_type"), "multiplier")
    return pool(spark, sf).join(known, ["source_key", "known_type"], "left").select("pool_id", F.coalesce("multiplier", F.lit(1.0)).alias("multiplier"))


@R.query("join_4_source_by_type", f"with {REC} select key, t.edit_type, round(coalesce(case when isfinite(score) then score end, 0.0) * t.keep_pct / 100, 6) as prior from rec, keep_targets t")
def source_by_type(spark: SparkSession, sf: str) -> DataFrame:
    """Each source with every edit type: an expansion by a fixed list, not a join of two tables."""
    types = whole_list(read(spark, sf, "keep_targets").orderBy("edit_type"), "edit types")
    each = F.explode(F.array(*[F.struct(F.lit(t.edit_type).alias("edit_type"), F.lit(t.keep_pct).alias("pct")) for t in types]))
    return records(spark, sf).select("key", F.coalesce(finite(F.col("score")), F.lit(0.0)).alias("s"), each.alias("t")).select("key", "t.edit_type", r6(F.col("s") * F.col("t.pct") / 100).alias("prior"))


_TWO = f"with {POOL}, a as (select source_key, max(total_score) as x from pool where known_type = 'object_removal' and isfinite(total_score) group by all), b as (select source_key, max(total_score) as y from pool where known_type = 'color_change' and isfinite(total_score) group by all)"


@R.query("join_5_matching_scores", f"{_TWO} select source_key, x, y, round(y - x, 6) as delta from a join b using (source_key)")
def matching_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = pool(spark, sf).where(finite(F.col("total_score")).isNotNull())
    a = rows.where("known_type = 'object_removal'").groupBy("source_key").agg(F.max("total_score").alias("x"))
    b = rows.where("known_type = 'color_change'").groupBy("source_key").agg(F.max("total_score").alias("y"))
    return a.join(b, "source_key").select("source_key", "x", "y", r6(F.col("y") - F.col("x")).alias("delta"))


@R.query("join_6_score_maps", "with m as (select source_key, unnest(map_entries(opportunities)) as e, pool_id from pool_candidates) select e.key as name, count(*) as n, count(t.edit_type) as known from m left join keep_targets t on t.edit_type = e.key group by e.key order by try_cast(e.key as int), e.key")
def score_maps(spark: SparkSession, sf: str) -> DataFrame:
    entries = read(spark, sf, "pool_candidates").select(F.explode("opportunities").alias("name", "value")).groupBy("name").agg(F.count("*").alias("n"))
    known = read(spark, sf, "keep_targets").select(F.col("edit_type").alias("name"), F.lit(1).alias("hit"))
    return entries.join(F.broadcast(known), "name", "left").select("name", "n", F.when(F.col("hit") == 1, F.col("n")).otherwise(0).alias("known")).orderBy(F.col("name").try_cast("int"), "name")


@R.query(
    "join_7_hardest_pairs",
    f"""with {CAND}, a as (select * from (select *, row_number() over (partition by group_id order by score, candidate_index) as r from cand where trim(group_id) <> '' and status = 'accepted' and score is not null) where r <= 3),
    b as (select * from (select *, row_number() over (partition by group_id order by score desc, candidate_index) as r from cand where trim(group_id) <> '' and status = 'rejected' and score is not null) where r <= 3)
    select a.group_id, a.candidate_index as winner, b.candidate_index as loser, a.score as winner_score, b.score as loser_score from a join b using (group_id)""",
)
def hard_pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows = candidates(spark, sf).where("trim(group_id) != ''")
    return hardest_pairs(rows, "group_id", "candidate_index", "score", F.col("status") == "accepted", F.col("status") == "rejected", 3).select("group_id", "winner", "loser", "winner_score", "loser_score")


@R.query(
    "join_8_pair_accuracy",
    f"""with {CAND}, c as (select group_id, round(judge * 100)::int as l, round(score * 1000)::int as s from cand where trim(group_id) <> '' and judge is not null and score is not null),
    p as (select a.group_id, b.s - a.s as d from c a join c b on b.group_id = a.group_id and b.l >= a.l + 5), g as (select distinct group_id from c)
    select g.group_id, count(*) filter (d <> 0) as pairs, count(*) filter (d > 0) as hits, round(count(*) filter (d > 0) / nullif(count(*) filter (d <> 0), 0), 6) as accuracy from g left join p using (group_id) group by g.group_id""",
)
def pair_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    rows = candidates(spark, sf).where("trim(group_id) != ''").select("group_id", "judge", "score")
    return label_pair_accuracy(rows, "group_id", "judge", "score").withColumn("accuracy", r6(C("accuracy")))


_BEST = f"""with {CAND}, c as (select * from cand where trim(group_id) <> '' and score is not null),
    w as (select * from (select *, row_number() over (partition by group_id order by score desc, candidate_index) as r from c where accepted) where r = 1),
    p as (select c.group_id, w.candidate_index as winner, c.candidate_index as loser, w.score as winner_score, c.score as loser_score from c join w using (group_id) where c.candidate_index <> w.candidate_index"""


@R.query("join_9_margin_pairs", f"{_BEST} and w.score - c.score >= 0.1) select group_id, winner, loser, winner_score, loser_score from (select *, row_number() over (partition by group_id order by loser_score desc, loser) as r from p) where r <= 4")
def margin_pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows = candidates(spark, sf).where("trim(group_id) != ''")
    return best_against_rest(rows, "group_id", "candidate_index", "score", F.col("accepted"), 0.1, 4).select("group_id", "winner", "loser", "winner_score", "loser_score")


@R.query("join_10_strict_pairs", f"{_BEST} and (w.score - c.score >= 0.2 or coalesce(w.judge, 0) - coalesce(c.judge, 0) >= 0.3)) select group_id, winner, loser from p")
def strict_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The best of a group against all that it beats by either margin."""
    rows = candidates(spark, sf).where("trim(group_id) != '' and score is not null")
    winner = best_rows(rows.where("accepted"), ["group_id"], [F.desc("score"), F.col("candidate_index")], 1).select("group_id", F.col("candidate_index").alias("winner"), F.col("score").alias("ws"), F.coalesce("judge", F.lit(0.0)).alias("wj"))
    pairs = rows.join(winner, "group_id").where("candidate_index != winner and (ws - score >= 0.2 or wj - coalesce(judge, 0) >= 0.3)")
    return pairs.select("group_id", "winner", F.col("candidate_index").alias("loser"))


@R.query(
    "join_11_policy_reference",
    f"""with {CAND}, c as (select * from cand where trim(group_id) <> '' and score is not null),
    g as (select group_id, max(score) filter (candidate_role = 'policy' or starts_with(candidate_role, 'policy:')) as policy, max(score) filter (starts_with(candidate_role, 'reference')) as reference from c group by group_id)
    select group_id, policy, reference, round(policy - reference, 6) as delta from g where policy is not null and reference is not null""",
)
def policy_reference(spark: SparkSession, sf: str) -> DataFrame:
    """The best of each side, both in one aggregation instead of a join."""
    role = F.col("candidate_role")
    best = candidates(spark, sf).where("trim(group_id) != ''").groupBy("group_id").agg(F.max(F.when((role == "policy") | role.startswith("policy:"), F.col("score"))).alias("policy"), F.max(F.when(role.startswith("reference"), F.col("score"))).alias("reference"))
    return best.where("policy is not null and reference is not null").withColumn("delta", r6(F.col("policy") - F.col("reference")))


@R.query(
    "join_12_argmax",
    f"""with {CAND}, l as (select group_id, candidate_index, unnest(['edit', 'preservation', 'validity']) as axis, unnest([edit, preservation, validity]) as value, unnest([1, 2, 3]) as ord from cand where trim(group_id) <> '')
    select group_id, candidate_index, axis, value from (select *, row_number() over (partition by group_id, candidate_index order by value desc nulls last, ord) as r from l) where r = 1 and value is not null""",
)
def argmax_axis(spark: SparkSession, sf: str) -> DataFrame:
    """The strongest of several scores of a row; ties go to the earlier one.  No shuffle: it is an expression."""
    best = F.array_max(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("value"), F.lit(-i).alias("ord"), F.lit(c).alias("axis"))) for i, c in enumerate(("edit", "preservation", "validity"))]))
    return candidates(spark, sf).where("trim(group_id) != ''").select("group_id", "candidate_index", best.alias("b")).where("b is not null").select("group_id", "candidate_index", "b.axis", "b.value")


@R.query("join_13_routing", f"with {CAND} select c.group_id, c.candidate_index, coalesce('route:' || t.category, 'default') as route from cand c left join (select * from sample_targets where axis = 'edit_type') t on t.category = c.edit_type")
def routing(spark: SparkSession, sf: str) -> DataFrame:
    routes = read(spark, sf, "sample_targets").where("axis = 'edit_type'").select(F.col("category").alias("edit_type"), F.concat(F.lit("route:"), "category").alias("route"))
    return candidates(spark, sf).join(F.broadcast(routes), "edit_type", "left").select("group_id", "candidate_index", F.coalesce("route", F.lit("default")).alias("route"))


@R.query("join_14_decision", f"with {CAND}, d as (select group_id, max(judge) as judge from cand where trim(group_id) <> '' group by all) select c.group_id, c.candidate_index, case when d.judge is null then 'none' when c.judge >= d.judge - 0.05 then 'keep' else 'drop' end as decision from cand c left join d on d.group_id = c.group_id")
def decision(spark: SparkSession, sf: str) -> DataFrame:
    rows = candidates(spark, sf)
    best = rows.where("trim(group_id) != ''").groupBy("group_id").agg(F.max("judge").alias("best"))
    word = F.when(F.col("best").isNull(), "none").when(F.col("judge") >= F.col("best") - 0.05, "keep").otherwise("drop")
    return rows.join(best, "group_id", "left").select("group_id", "candidate_index", word.alias("decision"))


@R.query("join_15_pending", f"with {CAND}, {POOL} select p.source_key, count(*) as pending from pool p where not exists (select 1 from cand c where c.base = p.source_key and c.edit_type = p.known_type and c.status in ('accepted', 'rejected')) group by all")
def pending(spark: SparkSession, sf: str) -> DataFrame:
    done = candidates(spark, sf).where("status in ('accepted', 'rejected')").select(F.col("base").alias("source_key"), F.col("edit_type").alias("known_type")).distinct()
    return pool(spark, sf).join(done, ["source_key", "known_type"], "left_anti").groupBy("source_key").agg(F.count("*").alias("pending"))


@R.query("join_16_anti_resume", f"with {REC} select key from rec where not exists (select 1 from candidate_log c where c.record_key = rec.key)")
def anti_resume(spark: SparkSession, sf: str) -> DataFrame:
    seen = read(spark, sf, "candidate_log").select(F.col("record_key").alias("key"))
    return records(spark, sf).select("key").join(seen, "key", "left_anti")


@R.query("join_17_backfill", f"with {POOL} select pool_id from pool p where not exists (select 1 from pool q where q.source_key = p.source_key and q.feedback.accepted > 0)")
def backfill(spark: SparkSession, sf: str) -> DataFrame:
    rows = pool(spark, sf)
    used = rows.where("feedback.accepted > 0").select("source_key").distinct()
    return rows.join(used, "source_key", "left_anti").select("pool_id")


@R.query("join_18_retained", f"with {CAND}, {POOL}, k as (select distinct source_key, known_type from pool where total_score >= 0.6 and isfinite(total_score)) select c.group_id, c.candidate_index, k.source_key is not null as kept, case when k.source_key is null then 0.0 else c.score end as weight from cand c left join k on k.source_key = c.base and k.known_type = c.edit_type")
def retained(spark: SparkSession, sf: str) -> DataFrame:
    """Rows not retained stay, with weight 0."""
    good = pool(spark, sf).where(finite(F.col("total_score")) >= 0.6).select(F.col("source_key").alias("base"), F.col("known_type").alias("edit_type"), F.lit(True).alias("kept")).distinct()
    rows = candidates(spark, sf).join(good, ["base", "edit_type"], "left")
    return rows.select("group_id", "candidate_index", F.coalesce("kept", F.lit(False)).alias("kept"), F.when(F.col("kept"), F.col("score")).otherwise(0.0).alias("weight"))


@R.query("join_19_circular", "select doc_id, coalesce(lead(doc_id) over w, first_value(doc_id) over w) as negative from documents window w as (partition by snapshot, lang order by doc_id rows between unbounded preceding and unbounded following)")
def circular(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's next neighbour, the last one's being the first."""
    order = Window.partitionBy("snapshot", "lang").orderBy("doc_id")
    return read(spark, sf, "documents").select("doc_id", F.coalesce(F.lead("doc_id").over(order), F.first("doc_id").over(order)).alias("negative"))


_SIGNS = "list_transform(embedding, lambda x: case when x > 0 then 1 else 0 end)"


@R.query(
    "join_20_sign_neighbours",
    f"""with c as (select {_SIGNS} as s, min(vec_id) as rep, count(*) as copies from embeddings group by s)
    select a.rep as a, b.rep as b, list_sum(list_transform(list_zip(a.s, b.s), lambda z: case when z[1] <> z[2] then 1 else 0 end))::int as bits, a.copies as a_copies, b.copies as b_copies
    from c a join c b on a.rep < b.rep where list_sum(list_transform(list_zip(a.s, b.s), lambda z: case when z[1] <> z[2] then 1 else 0 end)) <= 15""",
)
def near_signs(spark: SparkSession, sf: str) -> DataFrame:
    return sign_neighbours(read(spark, sf, "embeddings"), "vec_id", "embedding", 64, 16, 15)


@R.query("join_21_first_use", f"with {POOL} select source_key, pool_id from (select *, row_number() over (partition by source_key order by total_score desc nulls last, pool_id) as r from pool where isfinite(total_score)) where r = 1")
def first_use(spark: SparkSession, sf: str) -> DataFrame:
    """The row with which a source is used for the first time; only that one needs the near-duplicate check."""
    return best_rows(pool(spark, sf).where(finite(F.col("total_score")).isNotNull()), ["source_key"], [F.desc_nulls_last("total_score"), F.col("pool_id")], 1).select("source_key", "pool_id")


@R.query(
    "join_22_positive_negative",
    f"""with {CAND}, r as (select group_id, accepted as pos, rank() over (partition by group_id order by score) + (count(*) over (partition by group_id, score) - 1) / 2.0 as rk from cand where score is not null and trim(group_id) <> '')
    select group_id, sum(pos::int)::bigint as positives, sum((not pos)::int)::bigint as negatives, round((sum(rk) filter (pos) - sum(pos::int) * (sum(pos::int) + 1) / 2.0) / nullif(sum(pos::int) * sum((not pos)::int), 0), 6) as auc from r group by group_id""",
)
def positive_negative(spark: SparkSession, sf: str) -> DataFrame:
    """All positives against all negatives of a group by rank sums; no pair is formed."""
    return auc(candidates(spark, sf).where("trim(group_id) != ''"), ["group_id"], "score", "accepted").withColumn("auc", r6(F.col("auc")))


@R.query("join_23_proposal_lookup", "with p as (select group_id, max(proposal.operation_id) as operation_id from candidate_log where trim(group_id) <> '' group by all) select distinct c.record_key, p.operation_id from candidate_log c join p using (group_id)")
def proposal_lookup(spark: SparkSession, sf: str) -> DataFrame:
    log = read(spark, sf, "candidate_log").where("trim(group_id) != ''").select("group_id", "record_key", F.col("proposal.operation_id").alias("operation_id"))
    plan = log.groupBy("group_id").agg(F.max("operation_id").alias("operation_id"))
    return log.select("group_id", "record_key").distinct().join(plan, "group_id").select("record_key", "operation_id").distinct()


@R.query("join_24_back_to_source", f"with {CAND}, {REC} select c.group_id, c.candidate_index, coalesce(nullif(trim(r.caption), ''), nullif(trim(b.caption), ''), 'none') as caption from cand c left join rec r on r.key = c.record_key left join rec b on b.key = c.base where c.accepted")
def back_to_source(spark: SparkSession, sf: str) -> DataFrame:
    source = records(spark, sf).select("key", filled(F.col("caption")).alias("caption"))
    rows = candidates(spark, sf).where("accepted").select("group_id", "candidate_index", "record_key", "base")
    first = rows.join(source.select(F.col("key").alias("record_key"), F.col("caption").alias("own")), "record_key", "left")
    both = first.join(source.select(F.col("key").alias("base"), F.col("caption").alias("theirs")), "base", "left")
    return both.select("group_id", "candidate_index", F.coalesce("own", "theirs", F.lit("none")).alias("caption"))


