"""Sort, limit, quota and sampling queries (LIM)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.exprs import finite, looked_up
from millrace.operators.joins import best_rows
from millrace.operators.selection import capped, greedy_selection, quota_then_backfill, ranked_whole, remainder_seats, seeded_sample
from millrace.plans.base import CAND, POOL, REC, Registry, candidates, pool, r6, read, records

R = Registry()
QUERIES, SQL = R.QUERIES, R.SQL

_FIN = "case when isfinite(total_score) then total_score end"


@R.query("lim_1_budget", f"with {POOL} select pool_id, case when place <= 100 then null else 'over_budget' end as reason from (select *, row_number() over (order by {_FIN} desc nulls last, pool_id) as place from pool)")
def budget(spark: SparkSession, sf: str) -> DataFrame:
    """The best 100 within the budget; the others are kept as rejects with a reason.  A top-n and an anti join: no global sort."""
    rows = pool(spark, sf)
    best = rows.orderBy(F.desc_nulls_last(finite(F.col("total_score"))), "pool_id").limit(100).select("pool_id", F.lit(True).alias("__in"))
    return rows.join(best, "pool_id", "left").select("pool_id", F.when(F.col("__in").isNull(), "over_budget").alias("reason"))


def _remainder_sql(weights: str, seats: int, ties: str) -> str:
    return f"""{weights}, x as (select key, w, w * {seats}.0 / sum(w) over () as exact from weights), b as (select *, floor(exact) as base from x)
    select key, w, (base + (row_number() over (order by exact - base desc, {ties}) <= {seats} - sum(base) over ())::int)::bigint as seats from b"""


def _remainder(spark: SparkSession, sf: str, name: str, key: str, weight: str, seats: int) -> DataFrame:
    table = read(spark, sf, name).select(F.col(key).alias("key"), F.col(weight).cast("double").alias("w"))
    return remainder_seats(table, "key", "w", seats)


@R.query("lim_2_largest_remainder", _remainder_sql("with weights as (select edit_type as key, keep_pct::double as w from keep_targets)", 97, "w desc, key"))
def remainder_keep(spark: SparkSession, sf: str) -> DataFrame:
    return _remainder(spark, sf, "keep_targets", "edit_type", "keep_pct", 97)


@R.query("lim_3_remainder_first", _remainder_sql("with weights as (select split_name as key, target_pct::double as w from split_targets)", 31, "w desc, key"))
def remainder_split(spark: SparkSession, sf: str) -> DataFrame:
    return _remainder(spark, sf, "split_targets", "split_name", "target_pct", 31)


@R.query("lim_4_remainder_schedule", _remainder_sql("with weights as (select source as key, weight_pct::double as w from mix_targets where mix = 'balanced')", 53, "w desc, key"))
def remainder_schedule(spark: SparkSession, sf: str) -> DataFrame:
    table = read(spark, sf, "mix_targets").where("mix = 'balanced'").select(F.col("source").alias("key"), F.col("weight_pct").cast("double").alias("w"))
    return remainder_seats(table, "key", "w", 53)


@R.query("lim_5_remainder_counts", f"with {POOL}, weights as (select known_type as key, count(*)::double as w from pool where known_type is not null group by all), x as (select key, w, w * 200.0 / sum(w) over () as exact from weights), b as (select *, floor(exact) as base from x) select key, w, (base + (row_number() over (order by exact - base desc, w desc, key) <= 200 - sum(base) over ())::int)::bigint as seats from b")
def remainder_counts(spark: SparkSession, sf: str) -> DataFrame:
    counts = pool(spark, sf).where("known_type is not null").groupBy(F.col("known_type").alias("key")).agg(F.count("*").cast("double").alias("w"))
    return remainder_seats(counts, "key", "w", 200)


@R.query(
    "lim_6_quota_backfill",
    f"""with {POOL}, p as (select *, {_FIN} as s from pool where known_type is not null), r as (select *, row_number() over (partition by known_type order by s desc nulls last, pool_id) as place from p)
    select pool_id, known_type, place <= 9 as within_quota from r order by (place <= 9) desc, s desc nulls last, pool_id limit 150""",
)
def quota_backfill(spark: SparkSession, sf: str) -> DataFrame:
    rows = pool(spark, sf).where("known_type is not null").withColumn("s", finite(F.col("total_score")))
    return quota_then_backfill(rows, "known_type", "pool_id", "s", 9, 150).select("pool_id", "known_type", "within_quota")


@R.query("lim_7_rotating", f"with {POOL}, p as (select pool_id, known_type, row_number() over (partition by known_type order by pool_id) - 1 as pos, count(*) over (partition by known_type) as n from pool where known_type is not null) select pool_id, known_type from p where ((pos - 14) % n + n) % n < 6")
def rotating(spark: SparkSession, sf: str) -> DataFrame:
    """Each round takes the next six of a stratum, going round at the end."""
    w = Window.partitionBy("known_type")
    rows = pool(spark, sf).where("known_type is not null").select("pool_id", "known_type", (F.row_number().over(w.orderBy("pool_id")) - 1).alias("pos"), F.count("*").over(w).alias("n"))
    return rows.where(F.pmod(F.col("pos") - 14, F.col("n")) < 6).select("pool_id", "known_type")


@R.query("lim_8_greedy")
def greedy(spark: SparkSession, sf: str) -> DataFrame:
    rows = pool(spark, sf).where("known_type is not null").withColumn("s", finite(F.col("total_score")))
    return greedy_selection(rows, "pool_id", [F.desc_nulls_last("s"), F.col("pool_id")], "source_key", 2, 20, "known_type", None, 0, 150)


@R.query("lim_9_greedy_near")
def greedy_near(spark: SparkSession, sf: str) -> DataFrame:
    signs = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(62)), lambda i: F.when(F.get("embedding", i) > 0, F.pow(F.lit(2.0), i).cast("bigint")).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda s, x: s + x)
    rows = read(spark, sf, "embeddings").select("vec_id", "label", signs.alias("bits"), F.col("vec_id").alias("own"))
    return greedy_selection(rows, "vec_id", [F.col("vec_id")], "own", 1, 15, "label", "bits", 14, 100)


@R.query("lim_10_object_first", f"with {REC} select key from rec order by (list_contains(list_transform(coalesce(edit_families, []), lambda x: lower(trim(x))), 'object')) desc, case when isfinite(score) then score end desc nulls last, key limit 80")
def object_first(spark: SparkSession, sf: str) -> DataFrame:
    has = F.coalesce(F.exists("edit_families", lambda x: F.lower(F.trim(x)) == "object"), F.lit(False))
    return records(spark, sf).select("key", has.alias("o"), finite(F.col("score")).alias("s")).orderBy(F.desc("o"), F.desc_nulls_last("s"), "key").limit(80).select("key")


def _per_type(name: str, per: int, total: int):
    @R.query(name, f"with {POOL}, p as (select pool_id, {_FIN} as s, known_type, row_number() over (partition by known_type order by {_FIN} desc nulls last, pool_id) as r from pool where known_type is not null) select pool_id, known_type from p where r <= {per} order by s desc nulls last, pool_id limit {total}")
    def query(spark: SparkSession, sf: str) -> DataFrame:
        rows = pool(spark, sf).where("known_type is not null").withColumn("s", finite(F.col("total_score")))
        return capped(rows, ["known_type"], [F.desc_nulls_last("s"), F.col("pool_id")], per).orderBy(F.desc_nulls_last("s"), "pool_id").limit(total).select("pool_id", "known_type")

    return query


_per_type("lim_11_type_then_global", 12, 60)
_per_type("lim_12_balanced", 5, 40)
_per_type("lim_13_preference_cap", 25, 200)


@R.query("lim_14_family_margin", f"with {CAND}, p as (select family, group_id, max(score) - min(score) as margin from cand where trim(group_id) <> '' group by all) select family, group_id from (select *, row_number() over (partition by family order by margin desc nulls last, group_id) as r from p) where r <= 20")
def family_margin(spark: SparkSession, sf: str) -> DataFrame:
    margins = candidates(spark, sf).where("trim(group_id) != ''").groupBy("family", "group_id").agg((F.max("score") - F.min("score")).alias("margin"))
    return capped(margins, ["family"], [F.desc_nulls_last("margin"), F.col("group_id")], 20).select("family", "group_id")


@R.query("lim_15_ratio_cap", f"with {CAND}, n as (select floor(count(*) filter (accepted) * 0.25) as cap from cand), r as (select group_id, candidate_index, row_number() over (order by score desc nulls last, coalesce(group_id, ''), candidate_index) as place from cand where status = 'rejected') select group_id, candidate_index from r, n where place <= cap")
def ratio_cap(spark: SparkSession, sf: str) -> DataFrame:
    """As many of one outcome as a quarter of the other: the cap is one number, the rows a top-n."""
    rows = candidates(spark, sf)
    cap = rows.where("accepted").count() // 4
    return rows.where("status = 'rejected'").orderBy(F.desc_nulls_last("score"), F.coalesce("group_id", F.lit("")), "candidate_index").limit(cap).select("group_id", "candidate_index")


@R.query("lim_16_seeded_sample", "select doc_id, lang from documents order by md5(doc_id || ':7'), doc_id limit 200")
def sample(spark: SparkSession, sf: str) -> DataFrame:
    return seeded_sample(read(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 200, 7)


@R.query("lim_17_seeded_metadata", f"with {REC} select key, batch from rec order by md5(key || ':11'), key limit 100")
def sample_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return seeded_sample(records(spark, sf).select("key", "batch"), "key", 100, 11)


@R.query("lim_18_stride", "select doc_id from (select doc_id, row_number() over (order by doc_id) - 1 as pos from documents) where pos >= 10 and (pos - 10) % 7 = 0 order by doc_id limit 50")
def stride(spark: SparkSession, sf: str) -> DataFrame:
    """Every seventh key from the eleventh on: the keys needed are the first few hundred, found by a top-n."""
    first = read(spark, sf, "documents").select("doc_id").orderBy("doc_id").limit(10 + 7 * 50)
    pos = F.row_number().over(Window.orderBy("doc_id")) - 1
    return first.withColumn("pos", pos).where("pos >= 10 and (pos - 10) % 7 = 0").select("doc_id").limit(50)


@R.query("lim_19_offset", "select doc_id, n_chars from documents order by n_chars desc, doc_id limit 40 offset 25")
def offset(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").offset(25).limit(40)


@R.query("lim_20_first_per_type", f"with {CAND} select edit_type, group_id, candidate_index from (select *, row_number() over (partition by edit_type order by coalesce(group_id, ''), candidate_index) as r from cand) where r <= 5")
def first_per_type(spark: SparkSession, sf: str) -> DataFrame:
    return best_rows(candidates(spark, sf), ["edit_type"], [F.coalesce("group_id", F.lit("")), F.col("candidate_index")], 5).select("edit_type", "group_id", "candidate_index")


@R.query("lim_21_best_settings", f"with {CAND}, s as (select family, level, round(avg(accepted::int), 6) as rate, count(*) as n from cand group by all) select * from s order by rate desc, n desc, family, level limit 10")
def best_settings(spark: SparkSession, sf: str) -> DataFrame:
    s = candidates(spark, sf).groupBy("family", "level").agg(r6(F.avg(F.col("accepted").cast("int"))).alias("rate"), F.count("*").alias("n"))
    return s.orderBy(F.desc("rate"), F.desc("n"), "family", "level").limit(10)


@R.query("lim_22_first_maximum", f"with {CAND} select group_id, candidate_index, score from (select *, row_number() over (partition by group_id order by score desc, candidate_index) as r from cand where trim(group_id) <> '' and score is not null) where r = 1")
def first_maximum(spark: SparkSession, sf: str) -> DataFrame:
    rows = candidates(spark, sf).where("trim(group_id) != '' and score is not null")
    return best_rows(rows, ["group_id"], [F.desc("score"), F.col("candidate_index")], 1).select("group_id", "candidate_index", "score")


@R.query("lim_23_rounds", "select snapshot, ceil(count(*) / 16.0)::bigint as rounds from documents group by snapshot")
def rounds(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").groupBy("snapshot").agg(F.ceil(F.count("*") / 16.0).alias("rounds"))


@R.query("lim_24_template_choice", "select doc_id, (['a', 'b', 'c', 'd', 'e'])[(doc_id % 5 + 1)::int] as template from documents")
def template_choice(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", F.element_at(F.array(*[F.lit(c) for c in "abcde"]), (F.pmod("doc_id", F.lit(5)) + 1).cast("int")).alias("template"))


@R.query("lim_25_override", f"with {POOL} select known_type, case known_type when 'object_removal' then 8 when 'style_transfer' then 2 else 4 end::int as samples, count(*) as n from pool group by known_type")
def override(spark: SparkSession, sf: str) -> DataFrame:
    counts = pool(spark, sf).groupBy("known_type").agg(F.count("*").alias("n"))
    return counts.withColumn("samples", looked_up(F.col("known_type"), {"object_removal": "8", "style_transfer": "2"}, F.lit("4")).cast("int"))


@R.query("lim_26_eligible", f"with {CAND} select distinct group_id, family, level from cand where level between 2 and 4 and family in ('object', 'color', 'style')")
def eligible(spark: SparkSession, sf: str) -> DataFrame:
    return candidates(spark, sf).where("level between 2 and 4 and family in ('object', 'color', 'style')").select("group_id", "family", "level").distinct()


@R.query("lim_27_preference_classes", f"with {POOL}, p as (select source_key, pool_id, case when known_type = 'object_removal' then 0 when starts_with(known_type, 'object') then 1 else 2 end as class from pool) select source_key, pool_id, class::int as class from (select *, row_number() over (partition by source_key order by class, pool_id) as r from p) where r <= 2")
def preference_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Primary before preferred before fallback; the key, or a seeded hash of it, decides within a class."""
    kind = F.when(F.col("known_type") == "object_removal", 0).when(F.col("known_type").startswith("object"), 1).otherwise(2)
    return best_rows(pool(spark, sf).withColumn("class", kind), ["source_key"], [F.col("class"), F.col("pool_id")], 2).select("source_key", "pool_id", "class")


@R.query(
    "lim_28_distractors",
    """with bank as (select category, row_number() over (order by category) as ord from sample_targets where axis = 'edit_type'),
    p as (select k.edit_type, b.category as distractor, case when split_part(b.category, '_', 1) = split_part(k.edit_type, '_', 1) then 0 else 1 end as class, b.ord from keep_targets k join bank b on b.category <> k.edit_type)
    select edit_type, distractor from (select *, row_number() over (partition by edit_type order by class, ord) as r from p) where r <= 3""",
)
def distractors(spark: SparkSession, sf: str) -> DataFrame:
    """For each entry of a small bank the nearest others: same first word, then the rest."""
    bank = read(spark, sf, "sample_targets").where("axis = 'edit_type'").select(F.col("category").alias("distractor"))
    pairs = read(spark, sf, "keep_targets").select("edit_type").join(F.broadcast(bank), F.col("edit_type") != F.col("distractor"))
    kind = (F.split("edit_type", "_")[0] != F.split("distractor", "_")[0]).cast("int")
    return best_rows(pairs.withColumn("class", kind), ["edit_type"], [F.col("class"), F.col("distractor")], 3).select("edit_type", "distractor")


@R.query("lim_29_rotation", "select round_index, snapshot_no, seen_at from (select distinct round_index, snapshot_no, seen_at, dense_rank() over (partition by round_index order by snapshot_no desc) as r from round_metrics) where r > 3")
def rotation(spark: SparkSession, sf: str) -> DataFrame:
    """What a keep-latest-three rotation would drop."""
    rows = read(spark, sf, "round_metrics").select("round_index", "snapshot_no", "seen_at").distinct()
    r = F.dense_rank().over(Window.partitionBy("round_index").orderBy(F.desc("snapshot_no")))
    return rows.withColumn("r", r).where("r > 3").drop("r")


@R.query("lim_30_latest_step", "select round_index, max(snapshot_no) as snapshot_no, arg_max(status, snapshot_no) as status from round_metrics group by round_index")
def latest_step(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "round_metrics").groupBy("round_index").agg(F.max("snapshot_no").alias("snapshot_no"), F.max_by("status", "snapshot_no").alias("status"))


@R.query("lim_31_latest_time", "select batch, max(ingested_at) as at, arg_max(key, (ingested_at, key)) as key from source_records group by batch")
def latest_time(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "source_records").groupBy("batch").agg(F.max("ingested_at").alias("at"), F.max_by("key", F.struct("ingested_at", "key")).alias("key"))


@R.query("lim_32_whole_rank", "select doc_id, row_number() over (order by doc_id) as place from documents")
def whole_rank(spark: SparkSession, sf: str) -> DataFrame:
    """The rank over a whole table from per-bin counts: no task sees all rows."""
    order = F.shiftleft(F.col("doc_id"), 20)
    return ranked_whole(read(spark, sf, "documents").select("doc_id"), order, "doc_id").select("doc_id", F.col("rank").alias("place"))
