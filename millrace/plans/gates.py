"""Filters, predicates, gates and reject reasons (FIL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.exprs import allowed, finite, finite_or, first_reason, gate_passes, reasons, role_matches, sorted_reasons
from millrace.plans.aggregates import GATES, SQL_GATES, gates
from millrace.plans.base import CAND, POOL, REC, Registry, candidates, columns_query, pool, r6, read, records

R = Registry()
QUERIES, SQL = R.QUERIES, R.SQL

C = F.col
VLM_GATES = {"quality_score": 0.45, "natural_image_score": 0.4, "editable_content_score": 0.35, "object_region_clarity": 0.3, "removable_object_score": 0.2, "small_object_separability": 0.2, "preservation_potential": 0.4}
VLM_CEILINGS = {"clutter_penalty": 0.8, "text_watermark_penalty": 0.7}


def record_tests():
    low = [(f"low_{n}", finite(C(f"vlm.{n}")) < v) for n, v in VLM_GATES.items()]
    return low + [(f"high_{n}", finite(C(f"vlm.{n}")) > v) for n, v in VLM_CEILINGS.items()] + [("low_score", finite(C("score")) < 0.5), ("low_technical_quality", finite(C("stats_scores.technical_quality_score")) < 0.35), ("insufficient_edit_family_coverage", F.size(F.coalesce("edit_families", F.array().cast("array<string>"))) < 1)]


_TESTS = [f"case when isfinite(vlm.{n}) and vlm.{n} < {v} then 'low_{n}' end" for n, v in VLM_GATES.items()] + [f"case when isfinite(vlm.{n}) and vlm.{n} > {v} then 'high_{n}' end" for n, v in VLM_CEILINGS.items()] + ["case when isfinite(score) and score < 0.5 then 'low_score' end", "case when isfinite(stats_scores.technical_quality_score) and stats_scores.technical_quality_score < 0.35 then 'low_technical_quality' end", "case when len(coalesce(edit_families, [])) < 1 then 'insufficient_edit_family_coverage' end"]
_ALL = f"list_sort(list_distinct(list_filter(list_concat(coalesce(reject_reasons, []), [{', '.join(_TESTS)}]), lambda x: x is not null)))"
columns_query(R, "fil_1_reasons", "rec", {"reasons": (lambda: F.array_join(sorted_reasons(C("reject_reasons"), record_tests()), "|"), f"coalesce(array_to_string({_ALL}, '|'), '')")})
columns_query(R, "fil_2_accepted", "rec", {"accepted": (lambda: F.size(sorted_reasons(C("reject_reasons"), record_tests())) == 0, f"len({_ALL}) = 0")})

_F = [f"case when coalesce({n}, 0.0) < {v} then '{n}' end" for n, v in GATES.items()]
_FAILED = f"list_filter([{', '.join(_F)}], lambda x: x is not null)"
columns_query(R, "fil_3_failures", "cand", {"failed": (lambda: F.array_join(reasons(gates()), "|"), f"coalesce(array_to_string({_FAILED}, '|'), '')"), "first": (lambda: F.get(reasons(gates()), F.lit(0)), f"{_FAILED}[1]")})

ORDERED = [*GATES.items(), ("taxonomy", 0.3), ("semantic", 0.35), ("rubric", 0.4)]
columns_query(R, "fil_4_first_gate", "cand", {"reason": (lambda: first_reason([(n, finite_or(C(n), 0.0) < v) for n, v in ORDERED], "accepted"), "case " + " ".join(f"when coalesce({n}, 0.0) < {v} then '{n}'" for n, v in ORDERED) + " else 'accepted' end")})
columns_query(R, "fil_5_feasible", "cand", {"feasible": (lambda: (F.size(reasons(gates())) == 0) & (C("taxonomy").isNull() | (C("taxonomy") >= 0.3)), f"{SQL_GATES} and (taxonomy is null or taxonomy >= 0.3)")})

REGION = [("not_run", "changed is null"), ("unchanged", "changed < 0.05"), ("too_small", "changed < 0.1"), ("too_large", "changed > 0.95"), ("drift", "drift > 0.7"), ("rival", "rival > gain"), ("no_gain", "gain < 0.2"), ("low_judge", "judge < 0.4")]
_CASE = lambda tests, other: "case " + " ".join(f"when {t} then '{n}'" for n, t in tests) + f" else {other} end"
columns_query(R, "fil_6_region_gate", "cand", {"reason": (lambda: first_reason([(n, F.expr(t)) for n, t in REGION], "accepted"), _CASE(REGION, "'accepted'"))})

PRIMARY = [("low_edit", "coalesce(edit, 0.0) < level * 0.1"), ("low_preservation", "coalesce(preservation, 0.0) < 0.3"), ("low_validity", "coalesce(validity, 0.0) < 0.3"), ("low_raw", "coalesce(raw, 0.0) < 0.3"), ("low_rubric", "coalesce(rubric, 0.0) < 0.3"), ("low_judge", "coalesce(judge, 0.0) < 0.2"), ("drift", "coalesce(drift, 0.0) > 0.8")]
columns_query(R, "fil_7_primary", "cand", {"reason": (lambda: F.when(C("accepted"), F.lit(None).cast("string")).otherwise(first_reason([(n, F.expr(t)) for n, t in PRIMARY], "rank")), f"case when accepted then null else {_CASE(PRIMARY, chr(39) + 'rank' + chr(39))} end")})

STRICT = [("status", "coalesce(status, '') <> 'accepted'"), ("unknown_type", "edit_type = 'unknown'"), ("judge", "judge < 0.5"), ("no_op", "changed < 0.1"), ("drift", "drift > 0.6"), ("edit", "edit < 0.4"), ("preservation", "preservation < 0.4"), ("validity", "validity < 0.4"), ("raw", "raw < 0.35"), ("rubric", "rubric < 0.35"), ("semantic", "semantic < 0.35"), ("rival", "rival > gain")]
columns_query(R, "fil_8_strict", "cand", {"reason": (lambda: first_reason([(n, F.expr(t)) for n, t in STRICT]), _CASE(STRICT, "null"))})


@R.query("fil_9_overrides", f"with {CAND}, t as (select category as edit_type, target_pct / 30.0 as least from sample_targets where axis = 'edit_type') select group_id, candidate_index, coalesce(raw, 0.0) >= coalesce(t.least, 0.4) as passes from cand left join t using (edit_type)")
def overrides(spark: SparkSession, sf: str) -> DataFrame:
    """Thresholds per edit type where the table has one, else the default."""
    t = read(spark, sf, "sample_targets").where("axis = 'edit_type'").select(C("category").alias("edit_type"), (C("target_pct") / 30.0).alias("least"))
    return candidates(spark, sf).join(F.broadcast(t), "edit_type", "left").select("group_id", "candidate_index", (finite_or(C("raw"), 0.0) >= F.coalesce("least", F.lit(0.4))).alias("passes"))


FLOORS = {"cepr_preservation": 0.5, "cepr_validity": 0.4}


@R.query("fil_10_floors", "select log_seq, bool_and(coalesce(evaluator.component_scores['cepr_preservation'] >= 0.5, false) and coalesce(evaluator.component_scores['cepr_validity'] >= 0.4, false)) as above from candidate_log group by log_seq")
def floors(spark: SparkSession, sf: str) -> DataFrame:
    """Every named component at or above its floor; NaN counts as in the order of doubles, above all."""
    ok = [F.coalesce(C("evaluator.component_scores")[n] >= v, F.lit(False)) for n, v in FLOORS.items()]
    return read(spark, sf, "candidate_log").groupBy("log_seq").agg(F.bool_and(ok[0] & ok[1]).alias("above"))




@R.query("fil_11_contract", "select log_seq, count(*) filter (proposal.structured_edit is not null and proposal.structured_edit.edit_type not in ('style_transfer') and evaluator.total_score >= 0.4 and isfinite(evaluator.total_score)) > 0 as trains from candidate_log group by log_seq")
def contract(spark: SparkSession, sf: str) -> DataFrame:
    ok = C("proposal.structured_edit").isNotNull() & (C("proposal.structured_edit.edit_type") != "style_transfer") & (finite(C("evaluator.total_score")) >= 0.4)
    return read(spark, sf, "candidate_log").groupBy("log_seq").agg((F.count_if(ok) > 0).alias("trains"))


@R.query("fil_12_slots", "select distinct log_seq, case when proposal.structured_edit is null then 'no_edit' when proposal.structured_edit.edit_type = 'object_removal' and coalesce(proposal.structured_edit.source_object, '') = '' then 'no_source' when proposal.structured_edit.edit_type = 'object_replacement' and coalesce(proposal.structured_edit.replacement, proposal.structured_edit.target_object, '') = '' then 'no_replacement' else 'ok' end as slot from candidate_log")
def slots(spark: SparkSession, sf: str) -> DataFrame:
    """Each edit type needs its own fields."""
    e = lambda f: C(f"proposal.structured_edit.{f}")
    blank = lambda *x: F.coalesce(*x, F.lit("")) == ""
    tests = [("no_edit", C("proposal.structured_edit").isNull()), ("no_source", (e("edit_type") == "object_removal") & blank(e("source_object"))), ("no_replacement", (e("edit_type") == "object_replacement") & blank(e("replacement"), e("target_object")))]
    return read(spark, sf, "candidate_log").select("log_seq", first_reason(tests, "ok").alias("slot")).distinct()


_INS = "coalesce(proposal.instruction, '')"


@R.query("fil_13_slot_sanity", rf"select distinct log_seq, case when trim({_INS}) = '' then 'missing' when lower({_INS}) in ('object', 'thing', 'item') then 'generic' when contains(lower({_INS}), 'instead of') or contains(lower({_INS}), 'please') then 'action' when len(regexp_extract_all({_INS}, '[\w-]+')) > 8 then 'too_long' else 'ok' end as sanity from candidate_log")
def slot_sanity(spark: SparkSession, sf: str) -> DataFrame:
    x = F.coalesce("proposal.instruction", F.lit(""))
    tests = [("missing", F.trim(x) == ""), ("generic", F.lower(x).isin("object", "thing", "item")), ("action", F.lower(x).contains("instead of") | F.lower(x).contains("please")), ("too_long", F.regexp_count(x, F.lit(r"[\w-]+")) > 8)]
    return read(spark, sf, "candidate_log").select("log_seq", first_reason(tests, "ok").alias("sanity")).distinct()


columns_query(R, "fil_14_no_op", "cand", {"no_op": (lambda: F.coalesce((C("changed") < 0.1) & (F.coalesce("gain", F.lit(0.0)) < 0.3), F.lit(False)), "coalesce(changed < 0.1 and coalesce(gain, 0.0) < 0.3, false)")})
columns_query(R, "fil_15_drift", "cand", {"drift": (lambda: F.coalesce(C("drift") > 0.6, F.lit(False)) | F.coalesce(C("preservation") < 0.3, F.lit(False)), "coalesce(drift > 0.6, false) or coalesce(preservation < 0.3, false)")})
columns_query(R, "fil_16_fixed", "cand", {"no_op": (lambda: F.coalesce(C("changed") < 0.03, F.lit(False)), "coalesce(changed < 0.03, false)"), "drift": (lambda: F.coalesce(C("drift") > 0.75, F.lit(False)), "coalesce(drift > 0.75, false)")})
columns_query(R, "fil_17_drift_either", "cand", {"drift": (lambda: F.greatest(F.coalesce("drift", F.lit(0.0)), 1.0 - F.coalesce("preservation", F.lit(1.0))) > 0.65, "greatest(coalesce(drift, 0.0), 1.0 - coalesce(preservation, 1.0)) > 0.65")})
columns_query(R, "fil_18_accepted_any", "cand", {"accepted": (lambda: F.coalesce(C("status") == "accepted", F.lit(False)) | C("accepted") | (F.coalesce("rubric", F.lit(0.0)) >= 0.9), "coalesce(status = 'accepted', false) or accepted or coalesce(rubric, 0.0) >= 0.9")})
columns_query(
    R, "fil_19_roles", "cand",
    {"policy": (lambda: role_matches(C("candidate_role"), ["policy"]), "coalesce(candidate_role = 'policy' or starts_with(candidate_role, 'policy:'), false)"), "other": (lambda: role_matches(C("candidate_role"), ["ref*", "opponent"]), "coalesce(starts_with(candidate_role, 'ref') or candidate_role = 'opponent' or starts_with(candidate_role, 'opponent:'), false)")},
)


@R.query("fil_20_productive", f"with {CAND} select group_id, count(*) as n, round(avg(accepted::int), 6) as rate from cand where trim(group_id) <> '' group by group_id having count(*) >= 3 and avg(accepted::int) between 0.2 and 0.8")
def productive(spark: SparkSession, sf: str) -> DataFrame:
    g = candidates(spark, sf).where("trim(group_id) != ''").groupBy("group_id").agg(F.count("*").alias("n"), F.avg(C("accepted").cast("int")).alias("rate"))
    return g.where("n >= 3 and rate between 0.2 and 0.8").select("group_id", "n", r6(C("rate")).alias("rate"))


@R.query("fil_21_near_miss", f"with {CAND} select group_id, max(raw) as best from cand where trim(group_id) <> '' group by group_id having not bool_or(accepted) and max(raw) >= 0.6")
def near_miss(spark: SparkSession, sf: str) -> DataFrame:
    """Groups with nothing accepted but something close; one aggregation in place of a window."""
    g = candidates(spark, sf).where("trim(group_id) != ''").groupBy("group_id").agg(F.max("raw").alias("best"), F.bool_or("accepted").alias("hit"))
    return g.where("not hit and best >= 0.6").select("group_id", "best")


@R.query(
    "fil_22_pair_guard",
    f"""with {CAND}, g as (select group_id, max(judge) filter (accepted) as w, max(judge) filter (not accepted) as l from cand where trim(group_id) <> '' group by all)
    select group_id, case when w is null and l is null then 'unjudged' when w is null then 'winner_unjudged' when l is null then 'loser_unjudged' when w < 0.3 then 'winner_bad' when l > 0.9 then 'loser_good' when w < l then 'inverted' when w - l < 0.05 then 'tie' when w - l < 0.2 then 'narrow' else 'clear' end as guard,
    case when w - l >= 0.2 then 1.0 when w - l >= 0.05 then 0.6 when w is null or l is null then 0.5 else 0.0 end as multiplier from g""",
)
def pair_guard(spark: SparkSession, sf: str) -> DataFrame:
    g = candidates(spark, sf).where("trim(group_id) != ''").groupBy("group_id").agg(F.max(F.when(C("accepted"), C("judge"))).alias("w"), F.max(F.when(~C("accepted"), C("judge"))).alias("l"))
    tests = [("unjudged", "w is null and l is null"), ("winner_unjudged", "w is null"), ("loser_unjudged", "l is null"), ("winner_bad", "w < 0.3"), ("loser_good", "l > 0.9"), ("inverted", "w < l"), ("tie", "w - l < 0.05"), ("narrow", "w - l < 0.2")]
    factor = F.when(F.expr("w - l >= 0.2"), 1.0).when(F.expr("w - l >= 0.05"), 0.6).when(F.expr("w is null or l is null"), 0.5).otherwise(0.0)
    return g.select("group_id", first_reason([(n, F.expr(t)) for n, t in tests], "clear").alias("guard"), factor.alias("multiplier"))


_CONF = "(0.5 * coalesce(edit, 0.0) + 0.3 * coalesce(preservation, 0.0) + 0.2 * coalesce(judge, 0.0))"
columns_query(R, "fil_23_calibration", "cand", {"multiplier": (lambda: F.expr(f"round(case when coalesce(preservation, 0.0) < 0.2 then 0.0 else least(greatest(0.5 + {_CONF}, 0.5), 1.25) end, 6)"), f"round(case when coalesce(preservation, 0.0) < 0.2 then 0.0 else least(greatest(0.5 + {_CONF}, 0.5), 1.25) end, 6)")})


@R.query("fil_24_pairs", f"with {CAND} select group_id, candidate_index from cand where accepted and score >= 0.5 and (changed is null or changed between 0.05 and 0.9)")
def pair_quality(spark: SparkSession, sf: str) -> DataFrame:
    """A changed share that was never measured passes."""
    return candidates(spark, sf).where("accepted and score >= 0.5 and (changed is null or changed between 0.05 and 0.9)").select("group_id", "candidate_index")


PAIR_TESTS = [(f"low_{n}", f"stats_scores.{n} < {v}") for n, v in (("technical_quality_score", 0.4), ("structure_score", 0.35), ("saturation_score", 0.3), ("contrast_score", 0.3))] + [("caption_short", "length(trim(coalesce(caption, ''))) < 12"), ("caption_long", "length(caption) > 60"), ("caption_vague", "lower(caption) like '%something%'")]
columns_query(
    R, "fil_25_pair_reasons", "rec",
    {"reasons": (lambda: F.array_join(reasons([(n, F.expr(t)) for n, t in PAIR_TESTS]), "|"), "coalesce(array_to_string(list_filter([" + ", ".join(f"case when {t.replace('stats_scores', 'stats_scores')} then '{n}' end" for n, t in PAIR_TESTS) + "], lambda x: x is not null), '|'), '')")},
)


@R.query("fil_26_verdict", f"with {CAND}, g as (select group_id, max(score) filter (candidate_role = 'policy' or starts_with(candidate_role, 'policy:')) as p, max(score) filter (starts_with(candidate_role, 'reference')) as r from cand where trim(group_id) <> '' group by all) select group_id, case when p - r >= 0.05 then 'candidate_win' when r - p >= 0.05 then 'reference_win' else 'reject' end as verdict from g")
def verdict(spark: SparkSession, sf: str) -> DataFrame:
    policy = role_matches(C("candidate_role"), ["policy"])
    g = candidates(spark, sf).where("trim(group_id) != ''").groupBy("group_id").agg(F.max(F.when(policy, C("score"))).alias("p"), F.max(F.when(C("candidate_role").startswith("reference"), C("score"))).alias("r"))
    return g.select("group_id", F.when(F.expr("p - r >= 0.05"), "candidate_win").when(F.expr("r - p >= 0.05"), "reference_win").otherwise("reject").alias("verdict"))


def _counted(name: str, view: str, source, tests: list[tuple[str, str]]) -> None:
    prefix = {"cand": CAND, "rec": REC, "pool": POOL}[view]

    @R.query(name, f"with {prefix} select {_CASE(tests, chr(39) + 'kept' + chr(39))} as reason, count(*) as n from {view} group by all")
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return source(spark, sf).groupBy(first_reason([(n, F.expr(t)) for n, t in tests], "kept").alias("reason")).agg(F.count("*").alias("n"))


_counted("fil_27_candidate_filter", "cand", candidates, [("no_group", "group_id is null or trim(group_id) = ''"), ("no_record", "record_key is null"), ("status", "coalesce(status, '') <> 'accepted'"), ("no_score", "score is null"), ("low_score", "score < 0.3"), ("no_op", "changed < 0.1"), ("drift", "drift > 0.6")])
_counted("fil_28_preference_filter", "cand", candidates, [("not_rejected", "coalesce(status, '') <> 'rejected'"), ("no_score", "score is null"), ("too_good", "score > 0.85"), ("too_bad", "score < 0.1")])
_counted("fil_29_reference_filter", "cand", candidates, [("role", "coalesce(candidate_role, '') not like 'reference%'"), ("no_score", "score is null"), ("judge", "judge < 0.3")])
_counted("fil_30_builder_filter", "rec", records, [("no_image", "image is null or trim(image) = ''"), ("quality", "vlm.quality_score < 0.5"), ("not_accepted", "not accepted")])
_counted("fil_31_prefilter", "pool", pool, [("quality", "profile.source_quality < 0.4"), ("clarity", "profile.object_clarity < 0.3"), ("unknown_type", "known_type is null")])

columns_query(
    R, "fil_32_gate_pass", "cand",
    {"judge": (lambda: gate_passes(C("judge"), 0.5), "case when judge is null or judge = -1 then true else judge >= 0.5 end"), "gain": (lambda: gate_passes(C("gain"), 0.4, C("edit_type") != "style_transfer"), "case when edit_type = 'style_transfer' then true when gain is null or gain = -1 then true else gain >= 0.4 end")},
)
columns_query(R, "fil_33_failed_gates", "cand", {"failed": (lambda: F.array_join(reasons([(n, ~gate_passes(C(n), v)) for n, v in (("judge", 0.5), ("gain", 0.4), ("changed", 0.1))]), "|"), "coalesce(array_to_string(list_filter([" + ", ".join(f"case when {n} <> -1 and {n} < {v} then '{n}' end" for n, v in (("judge", 0.5), ("gain", 0.4), ("changed", 0.1))) + "], lambda x: x is not null), '|'), '')")})

CHECKS = [("no_key", "key is null or trim(key) = ''"), ("no_image", "image is null"), ("no_caption", "caption is null or trim(caption) = ''"), ("late", "ingested_at < captured_at")]


@R.query("fil_34_validation", f"with {REC} select key, unnest(list_filter([{', '.join(f'case when {t} then {chr(39)}{n}{chr(39)} end' for n, t in CHECKS)}], lambda x: x is not null)) as error from rec")
def validation(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).select("key", F.explode(reasons([(n, F.expr(t)) for n, t in CHECKS])).alias("error"))


@R.query("fil_35_contract_checks", "select 'split_targets' as contract, sum(target_pct) = 100 as holds from split_targets union all select 'sample_targets:' || axis, sum(target_pct) = 100 from sample_targets group by axis union all select 'mix_targets:' || mix, sum(weight_pct) = 100 from mix_targets group by mix")
def contract_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Targets that have to add up."""
    a = read(spark, sf, "split_targets").agg(F.lit("split_targets").alias("contract"), (F.sum("target_pct") == 100).alias("holds"))
    b = read(spark, sf, "sample_targets").groupBy("axis").agg((F.sum("target_pct") == 100).alias("holds")).select(F.concat(F.lit("sample_targets:"), "axis").alias("contract"), "holds")
    c = read(spark, sf, "mix_targets").groupBy("mix").agg((F.sum("weight_pct") == 100).alias("holds")).select(F.concat(F.lit("mix_targets:"), "mix").alias("contract"), "holds")
    return a.unionByName(b).unionByName(c)


@R.query("fil_36_invalid_scores", f"with {POOL} select pool_id from pool where total_score is null or not isfinite(total_score)")
def invalid_scores(spark: SparkSession, sf: str) -> DataFrame:
    return pool(spark, sf).where(finite(C("total_score")).isNull()).select("pool_id")


@R.query("fil_37_provenance", f"with {POOL}, {REC} select p.pool_id from pool p join rec r on r.key = p.source_key where p.batch is distinct from r.batch or p.source_id is distinct from r.source_id")
def provenance(spark: SparkSession, sf: str) -> DataFrame:
    """Pool rows whose batch or source disagrees with their record's."""
    r = records(spark, sf).select(C("key").alias("source_key"), C("batch").alias("b"), C("source_id").alias("s"))
    return pool(spark, sf).join(r, "source_key").where("not (batch <=> b) or not (source_id <=> s)").select("pool_id")


@R.query("fil_38_completeness", f"with {CAND}, {POOL} select distinct source_key from pool where source_key not in (select base from cand where base is not null)")
def completeness(spark: SparkSession, sf: str) -> DataFrame:
    have = candidates(spark, sf).select(C("base").alias("source_key")).where("source_key is not null")
    return pool(spark, sf).select("source_key").distinct().join(have, "source_key", "left_anti")


@R.query("fil_39_completed_groups", f"with {CAND}, k as (select *, row_number() over (partition by group_id order by candidate_index) as r from cand where trim(group_id) <> '') select group_id from k where r <= 4 group by group_id having count(*) >= 4 and bool_and(status in ('accepted', 'rejected'))")
def completed_groups(spark: SparkSession, sf: str) -> DataFrame:
    first = candidates(spark, sf).where("trim(group_id) != ''").withColumn("r", F.row_number().over(Window.partitionBy("group_id").orderBy("candidate_index"))).where("r <= 4")
    return first.groupBy("group_id").agg(F.count("*").alias("n"), F.bool_and(C("status").isin("accepted", "rejected")).alias("done")).where("n >= 4 and done").select("group_id")


@R.query("fil_40_allow_deny", f"with {CAND} select group_id, candidate_index from cand where edit_type in ('object_removal', 'color_change', 'style_transfer') and edit_type not in ('style_transfer')")
def allow_deny(spark: SparkSession, sf: str) -> DataFrame:
    return candidates(spark, sf).where(allowed(C("edit_type"), ["object_removal", "color_change", "style_transfer"], ["style_transfer"])).select("group_id", "candidate_index")


columns_query(R, "fil_41_target_type", "pool", {"target": (lambda: F.when(allowed(C("known_type"), [], ["global_adjustment"]), C("known_type")), "case when known_type not in ('global_adjustment') then known_type end")})
