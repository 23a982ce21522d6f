"""Scalar function queries (SCA): each is one expression over a view and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import exprs as X
from millrace.functions import instructions as I
from millrace.plans.base import CAND, Registry, candidates, columns_query, r6, read, whole_list

R = Registry()
QUERIES, SQL = R.QUERIES, R.SQL
C = F.col


def add(name: str, view: str, **columns) -> None:
    columns_query(R, name, view, columns)


def _r(sql: str) -> str:
    return f"round({sql}, 6)"


def _clamp(x: str) -> str:
    return f"case when {x} is not null and not isnan({x}) then least(greatest({x}, 0.0), 1.0) end"


_FIN = "case when isfinite(total_score) then total_score end"

add("sca_1_clamp", "pool", clamped=(lambda: X.clamp(C("total_score"), 0.2, 0.8), "case when total_score is not null and not isnan(total_score) then least(greatest(total_score, 0.2), 0.8) end"))
add("sca_2_parse", "documents", number=(lambda: X.parsed_number(F.regexp_extract("text", r"\d+\.\d+|NaN", 0), -1.0), r"coalesce(case when isfinite(try_cast(regexp_extract(text, '\d+\.\d+|NaN', 0) as double)) then try_cast(regexp_extract(text, '\d+\.\d+|NaN', 0) as double) end, -1.0)"))
add("sca_3_finite", "pool", x=(lambda: X.finite_or(C("sort_score"), 0.0), "coalesce(case when isfinite(sort_score) then sort_score end, 0.0)"))
add("sca_4_sigmoid", "cand", x=(lambda: r6(X.sigmoid((C("gain") - C("rival")) * 8)), _r("1 / (1 + exp(-(gain - rival) * 8))")))
add("sca_5_trapezoid", "cand", x=(lambda: r6(X.trapezoid(C("changed"), 0.1, 0.6)), _r("case when changed is not null then least(greatest(case when changed < 0.1 then changed / 0.1 when changed > 0.6 then 1 - (changed - 0.6) / greatest(0.4, 1e-6) else 1.0 end, 0.0), 1.0) end")))
add("sca_6_even_round", "documents", halves=(lambda: X.even_round(C("n_chars").cast("decimal(20,1)") / 2).cast("bigint"), "round_even(n_chars / 2.0, 0)::bigint"))
add("sca_7_plateau", "cand", x=(lambda: F.when(C("changed").isNull(), 0.5).when(C("changed").between(0.2, 0.5), 1.0).when(C("changed").between(0.1, 0.7), 0.6).otherwise(0.1), "case when changed is null then 0.5 when changed between 0.2 and 0.5 then 1.0 when changed between 0.1 and 0.7 then 0.6 else 0.1 end"))
add("sca_8_judge_scale", "documents", x=(lambda: r6(X.scale_judge(F.pmod("n_chars", F.lit(101)).cast("double"))), _r("least(greatest(case when n_chars % 101 > 10 then (n_chars % 101) / 100.0 when n_chars % 101 > 5 then (n_chars % 101) / 10.0 when n_chars % 101 > 1 then ((n_chars % 101) - 1) / 4.0 else n_chars % 101 end, 0.0), 1.0)::double")))
add("sca_9_blend", "cand", x=(lambda: r6(X.blend(F.coalesce("edit", F.lit(0.0)), 0.7, F.coalesce("preservation", F.lit(0.0)), 0.3)), _r("exp((0.7 * ln(greatest(coalesce(edit, 0.0), 1e-6)) + 0.3 * ln(greatest(coalesce(preservation, 0.0), 1e-6))) / 1.0)")))
add("sca_10_bell", "cand", x=(lambda: r6(X.bell(C("score"), 0.5, 0.2)), _r("exp(-power(score - 0.5, 2) / 0.08)")))


@R.query("sca_11_cosine", "with q as (select label, embedding as q from embeddings where vec_id % 100 = 0) select e.vec_id, round(list_cosine_similarity(e.embedding::double[], c.centre), 5) as x from embeddings e join (select label, [" + ", ".join(f"avg(embedding[{i + 1}]::double)" for i in range(64)) + "] as centre from embeddings group by label) c using (label)")
def cosine(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector against the mean of its label; the means are one aggregation of 64 columns."""
    rows = read(spark, sf, "embeddings")
    centres = rows.groupBy("label").agg(F.array(*[F.avg(C("embedding")[i].cast("double")) for i in range(64)]).alias("centre"))
    return rows.join(centres, "label").select("vec_id", F.round(X.cosine(C("embedding"), C("centre")), 5).alias("x"))


_TECH = [("quality_score", 0.3), ("natural_image_score", 0.2), ("editable_content_score", 0.2), ("object_region_clarity", 0.2), ("preservation_potential", 0.1)]


def _wsum(names: list[tuple[str, float]], prefix: str) -> str:
    top = " + ".join(f"case when isfinite({prefix}{n}) then {prefix}{n} * {w} else 0 end" for n, w in names)
    low = " + ".join(f"case when isfinite({prefix}{n}) then {w} else 0 end" for n, w in names)
    return f"({top}) / nullif({low}, 0)"


add("sca_12_quality", "rec", x=(lambda: r6(X.weighted_mean([(C(f"vlm.{n}"), w) for n, w in _TECH], 0.0)), f"coalesce({_r(_wsum(_TECH, 'vlm.'))}, 0.0)"))
add("sca_13_combined", "rec", x=(lambda: r6(F.coalesce(X.finite(C("score")), F.lit(0.0)) - 0.3 * X.finite_or(C("vlm.clutter_penalty"), 0.0) - 0.2 * X.finite_or(C("vlm.text_watermark_penalty"), 0.0)), _r("coalesce(case when isfinite(score) then score end, 0.0) - 0.3 * coalesce(case when isfinite(vlm.clutter_penalty) then vlm.clutter_penalty end, 0.0) - 0.2 * coalesce(case when isfinite(vlm.text_watermark_penalty) then vlm.text_watermark_penalty end, 0.0)")))
add("sca_14_heuristic", "rec", families=(lambda: F.array_join(X.reasons([("object", C("vlm.object_region_clarity") >= 0.6), ("color", C("stats_scores.saturation_score") >= 0.6), ("contrast", C("stats_scores.contrast_score") >= 0.6)]), "|"), "concat_ws('|', case when vlm.object_region_clarity >= 0.6 then 'object' end, case when stats_scores.saturation_score >= 0.6 then 'color' end, case when stats_scores.contrast_score >= 0.6 then 'contrast' end)"))
_NV = lambda a, b: f"coalesce(case when isfinite({a}) then {a} end, case when isfinite({b}) then {b} end, 0.5)"
add("sca_15_profile", "rec", removable=(lambda: F.coalesce(X.finite(C("vlm.removable_object_score")), X.finite(C("vlm.object_region_clarity")), F.lit(0.5)), _NV("vlm.removable_object_score", "vlm.object_region_clarity")), separable=(lambda: F.coalesce(X.finite(C("vlm.small_object_separability")), X.finite(C("vlm.editable_content_score")), F.lit(0.5)), _NV("vlm.small_object_separability", "vlm.editable_content_score")))


def _gm(*names: str) -> str:
    n = " + ".join(f"(isfinite({x}))::int" for x in (f"coalesce({y}, 'nan'::double)" for y in names))
    s = " + ".join(f"case when isfinite({y}) then ln(least(greatest({y}, 1e-6), 1.0)) else 0 end" for y in names)
    return f"case when {n} = 0 then 0.0 else exp(({s}) / ({n})) end"


add("sca_16_opportunity", "rec", removal=(lambda: r6(X.gmean([C("vlm.removable_object_score"), C("vlm.preservation_potential"), C("vlm.quality_score")])), _r(_gm("vlm.removable_object_score", "vlm.preservation_potential", "vlm.quality_score"))), color=(lambda: r6(X.gmean([C("stats_scores.saturation_score"), C("vlm.quality_score")])), _r(_gm("stats_scores.saturation_score", "vlm.quality_score"))))
add("sca_17_bonus", "pool", bonus=(lambda: F.when(C("known_type").startswith("object"), 1.15).when(C("known_type") == "color_change", 1.05).when(C("known_type").isNull(), 0.8).otherwise(1.0), "case when starts_with(known_type, 'object') then 1.15 when known_type = 'color_change' then 1.05 when known_type is null then 0.8 else 1.0 end"))
add("sca_18_quality", "cand", x=(lambda: r6(X.gmean([C("edit"), C("preservation"), C("validity")])), _r(_gm("edit", "preservation", "validity"))))
add("sca_19_conservative", "cand", x=(lambda: r6(X.gmean([C("preservation"), 1.0 - C("drift"), C("validity")])), _r(_gm("preservation", "(1.0 - drift)", "validity"))))


@R.query("sca_20_z_penalty", f"with {CAND}, z as (select group_id, candidate_index, raw, avg(raw) over w as m, stddev_pop(raw) over w as s, count(raw) over w as n from cand where trim(group_id) <> '' window w as (partition by group_id)) select group_id, candidate_index, round(raw - 0.1 * greatest(case when n <= 1 then 0.0 else coalesce((raw - m) / nullif(s, 0), 0.0) end - 1.0, 0.0), 5) as x from z where raw is not null")
def z_penalty(spark: SparkSession, sf: str) -> DataFrame:
    """A penalty for standing out in the group; group statistics come from an aggregation and a join, so a large group isn't gathered."""
    rows = candidates(spark, sf).where("trim(group_id) != '' and raw is not null").select("group_id", "candidate_index", "raw")
    stats = rows.groupBy("group_id").agg(F.avg("raw").alias("m"), F.stddev_pop("raw").alias("s"), F.count("raw").alias("n"))
    z = F.when(C("n") <= 1, 0.0).otherwise(F.coalesce(F.try_divide(C("raw") - C("m"), F.nullif(C("s"), F.lit(0.0))), F.lit(0.0)))
    return rows.join(stats, "group_id").select("group_id", "candidate_index", F.round(C("raw") - 0.1 * F.greatest(z - 1.0, F.lit(0.0)), 5).alias("x"))


@R.query("sca_21_range", "select distinct log_seq, coalesce(proposal.expected_changed_fraction[1], case proposal.family when 'object' then 0.05 when 'style' then 0.5 else 0.1 end) as low from candidate_log")
def changed_range(spark: SparkSession, sf: str) -> DataFrame:
    default = F.when(C("proposal.family") == "object", 0.05).when(C("proposal.family") == "style", 0.5).otherwise(0.1)
    return read(spark, sf, "candidate_log").select("log_seq", F.coalesce(F.get("proposal.expected_changed_fraction", F.lit(0)), default).alias("low")).distinct()


add("sca_22_pair_score", "cand", x=(lambda: r6(X.gmean([C("edit"), C("preservation"), C("judge")])), _r(_gm("edit", "preservation", "judge"))))
add("sca_23_effective", "cand", x=(lambda: F.coalesce(C("raw"), C("rubric"), C("score"), F.lit(0.0)), "coalesce(raw, rubric, score, 0.0)"))
add("sca_24_raw_chain", "cand", x=(lambda: F.coalesce(C("semantic"), C("raw"), C("judge")), "coalesce(semantic, raw, judge)"))
MODES = {"raw": ("raw", "raw"), "blend": ("0.5 * coalesce(raw, 0.0) + 0.5 * coalesce(rubric, 0.0)", None), "judge": ("coalesce(judge, raw)", None)}
add("sca_25_modes", "cand", **{m: ((lambda e=e: F.expr(f"round({e}, 6)")), _r(e)) for m, (e, _) in MODES.items()})
add("sca_26_weight", "cand", weight=(lambda: F.expr("round(case when not accepted then 0.0 when judge < 0.4 then 0.25 when drift > 0.6 then 0.5 else least(greatest(coalesce(score, 0.5), 0.1), 1.0) end, 6)"), _r("case when not accepted then 0.0 when judge < 0.4 then 0.25 when drift > 0.6 then 0.5 else least(greatest(coalesce(score, 0.5), 0.1), 1.0) end::double")), reason=(lambda: F.expr("case when not accepted then 'not_accepted' when judge < 0.4 then 'low_judge' when drift > 0.6 then 'drift' else 'score' end"), "case when not accepted then 'not_accepted' when judge < 0.4 then 'low_judge' when drift > 0.6 then 'drift' else 'score' end"))
add("sca_27_tags", "cand", tags=(lambda: F.coalesce(X.filled(F.array_join(X.reasons([("no_op", C("changed") < 0.1), ("drift", C("drift") > 0.6), ("low_judge", C("judge") < 0.5)]), "|")), F.lit("hard_near_miss")), "coalesce(nullif(concat_ws('|', case when changed < 0.1 then 'no_op' end, case when drift > 0.6 then 'drift' end, case when judge < 0.5 then 'low_judge' end), ''), 'hard_near_miss')"))

_W = "regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+')"
add("sca_28_instruction", "rec", n=(lambda: F.size(I.words(C("caption"))), f"len({_W.format('caption')})::int"), reason=(lambda: X.first_reason([("short", F.size(I.words(C("caption"))) < 6), ("long", F.size(I.words(C("caption"))) > 9), ("vague", I.any_of(C("caption"), ["some", "thing"]))]), f"case when len({_W.format('caption')}) < 6 then 'short' when len({_W.format('caption')}) > 9 then 'long' when contains(lower(coalesce(caption, '')), 'some') or contains(lower(coalesce(caption, '')), 'thing') then 'vague' end"))
add("sca_29_pair_quality", "pool", x=(lambda: r6(0.6 * F.coalesce("profile.source_quality", F.lit(0.0)) + 0.4 * F.coalesce("profile.object_clarity", F.lit(0.0))), _r("0.6 * coalesce(profile.source_quality, 0.0) + 0.4 * coalesce(profile.object_clarity, 0.0)")))


def log_query(name: str, sql: str, **columns) -> None:
    """Expressions over the instructions of the log, one row per log entry."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        return read(spark, sf, "candidate_log").select("log_seq", *[make().alias(c) for c, make in columns.items()])

    R.QUERIES[name] = query
    R.SQL[name] = f"select log_seq, {sql} from candidate_log"


INS = lambda: C("proposal.instruction")
_I = "proposal.instruction"
_CLS = "case " + " ".join(f"when regexp_matches(lower({_I}), '{sign}') then '{name}'" for name, sign in I.CLASS_SIGNS) + " else 'other' end"
_PAT = [r"(?i)\bwith (?:an? |the )?([\w -]+)", r"(?i)\binto (?:an? |the )?([\w -]+)", r"(?i)\bas (?:an? |the )?([\w -]+)"]
log_query("sca_31_replacement", "coalesce(" + ", ".join(f"nullif(regexp_extract({_I}, '{p}', 1), '')" for p in _PAT) + ") as target", target=lambda: I.replacement_target(INS()))
log_query("sca_33_eight_classes", f"case when {_CLS} <> 'other' then {_CLS} when proposal.family = 'background' then 'background' else 'global' end as class", **{"class": lambda: F.when(I.instruction_class(INS()) != "other", I.instruction_class(INS())).when(C("proposal.family") == "background", "background").otherwise("global")})
log_query("sca_34_prompt", f"'Edit the image: ' || coalesce({_I}, '') || case when proposal.scope = 'local' then ' Keep everything else.' else '' end as prompt", prompt=lambda: F.concat(F.lit("Edit the image: "), F.coalesce(INS(), F.lit("")), F.when(C("proposal.scope") == "local", " Keep everything else.").otherwise("")))
log_query("sca_35_contract_prompt", f"coalesce({_I}, '') || coalesce(' Must show: ' || array_to_string(proposal.structured_edit.required_after, '; '), '') as prompt", prompt=lambda: F.concat(F.coalesce(INS(), F.lit("")), F.coalesce(F.concat(F.lit(" Must show: "), F.array_join("proposal.structured_edit.required_after", "; ")), F.lit(""))))


@R.query("sca_36_alias", "select p.pool_id, p.scored_at, coalesce(n.edit_type, 'other') as edit_type from pool_candidates p left join edit_type_names n on n.alias = lower(trim(p.edit_type))")
def alias(spark: SparkSession, sf: str) -> DataFrame:
    """Aliases from a table of 44 rows become a literal map: no join is left in the plan."""
    names = {r.alias: r.edit_type for r in whole_list(read(spark, sf, "edit_type_names"), "aliases")}
    return read(spark, sf, "pool_candidates").select("pool_id", "scored_at", X.looked_up(F.lower(F.trim("edit_type")), names, F.lit("other")).alias("edit_type"))


_FLAT = r"trim(regexp_replace(author, '[ \t\r\n]+', ' ', 'g'))"
add("sca_38_clean", "rec", author=(lambda: I.clean(C("author"), 12), f"case when {_FLAT} <> '' and lower({_FLAT}) not in ({', '.join(repr(w) for w in I.NULL_WORDS)}) then substring({_FLAT}, 1, 12) end"))
log_query("sca_39_article", f"regexp_replace(trim({_I}), '^(a|an|the)\\s+', '', 'i') as text, regexp_extract({_I}, '(next to|under|behind|in) the ([a-z ]+)', 2) as place", text=lambda: I.without_article(INS()), place=lambda: F.regexp_extract(INS(), "(next to|under|behind|in) the ([a-z ]+)", 2))
_TAIL = f"trim({_I})"
for _p in (r"[.!?]+$", r"\s+(please|completely|entirely)$", r"\s+from the (image|scene|picture)$", r"\s+(next to|under|behind|in|on|at|by) the [\w ]+$"):
    _TAIL = f"regexp_replace({_TAIL}, '{_p}', '', 'i')"
log_query("sca_40_tail", f"trim({_TAIL}) as text", text=lambda: I.without_tail(INS()))
log_query("sca_41_slots", rf"regexp_extract({_I}, '^Remove the ([\w ]+?)( (next|under|in|by|at|behind|on) .*)?$', 1) as removed, regexp_extract({_I}, '^Turn the ([\w ]+) into ([\w ]+)$', 2) as material", removed=lambda: F.regexp_extract(INS(), r"^Remove the ([\w ]+?)( (next|under|in|by|at|behind|on) .*)?$", 1), material=lambda: F.regexp_extract(INS(), r"^Turn the ([\w ]+) into ([\w ]+)$", 2))
_SEF = ("source_object", "target_object", "target_region", "target", "replacement")
log_query("sca_42_edit", ", ".join(f"nullif(trim(proposal.structured_edit.{f}), '') as {f}" for f in _SEF) + ", coalesce(nullif(trim(proposal.structured_edit.source_object), ''), nullif(trim(proposal.structured_edit.target), '')) as subject", **{f: (lambda f=f: X.filled(C(f"proposal.structured_edit.{f}"))) for f in _SEF}, subject=lambda: F.coalesce(X.filled(C("proposal.structured_edit.source_object")), X.filled(C("proposal.structured_edit.target"))))
log_query("sca_43_region", f"coalesce(contains(lower({_I}), lower(proposal.structured_edit.target_region)), false) as mentioned", mentioned=lambda: F.coalesce(F.lower(INS()).contains(F.lower("proposal.structured_edit.target_region")), F.lit(False)))


@R.query("sca_44_object_text", "select distinct raw_id, case when instr(payload, '{') > 0 and instr(payload, '}') > 0 and length(payload) - instr(reverse(payload), '}') + 1 > instr(payload, '{') then length(substring(payload, instr(payload, '{'), length(payload) - instr(reverse(payload), '}') + 2 - instr(payload, '{'))) end as n from raw_lines")
def object_span(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "raw_lines").select("raw_id", F.length(I.object_text(C("payload"))).alias("n")).distinct()


@R.query("sca_45_fenced", "select distinct raw_id, json_extract_string(try_cast(payload as json), '$.status') as status from raw_lines where json_type(try_cast(payload as json)) = 'OBJECT'")
def fenced(spark: SparkSession, sf: str) -> DataFrame:
    """Put into a fence, taken out again and parsed; broken text gives no row."""
    v = F.try_parse_json(I.unfenced(F.concat(F.lit("```json\n"), "payload", F.lit("\n```"))))
    rows = read(spark, sf, "raw_lines").select("raw_id", v.alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    return rows.select("raw_id", F.try_variant_get("v", "$.status", "string").alias("status")).distinct()




@R.query("sca_47_judge_list", "with v as (select raw_id, try_cast(payload as json) as j from raw_lines where json_type(try_cast(payload as json)) = 'OBJECT'), d as (select raw_id, unnest(case json_type(json_extract(j, '$.distractors')) when 'ARRAY' then json_extract(j, '$.distractors[*]') when 'OBJECT' then [json_extract(j, '$.distractors')] else [] end) as e from v) select distinct raw_id, json_extract_string(e, '$.operation_id') as operation_id from d where json_type(e) = 'OBJECT'")
def judge_list(spark: SparkSession, sf: str) -> DataFrame:
    """Entries given as a list or as a single object, from variants."""
    v = read(spark, sf, "raw_lines").select("raw_id", F.try_parse_json("payload").alias("v"))
    d = v.select("raw_id", F.try_variant_get("v", "$.distractors", "variant").alias("d"))
    listed = F.when(F.schema_of_variant("d").startswith("ARRAY"), F.try_variant_get("d", "$", "array<variant>")).when(F.schema_of_variant("d").startswith("OBJECT"), F.array("d"))
    return d.select("raw_id", F.explode(listed).alias("e")).where(F.schema_of_variant("e").startswith("OBJECT")).select("raw_id", F.try_variant_get("e", "$.operation_id", "string").alias("operation_id")).distinct()




@R.query("sca_49_score_aliases", "select pool_id, scored_at, e.key as name, round(least(greatest(1 + 4 * e.value, 1.0), 5.0), 6) as score from (select pool_id, scored_at, unnest(map_entries(opportunities)) as e from pool_candidates) where isfinite(e.value)")
def score_aliases(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "pool_candidates").select("pool_id", "scored_at", F.explode("opportunities").alias("name", "v")).where(X.is_finite(C("v"))).select("pool_id", "scored_at", "name", r6(F.least(F.greatest(1 + 4 * C("v"), F.lit(1.0)), F.lit(5.0))).alias("score"))


_WC = [("edit", 0.4), ("preservation", 0.3), ("validity", 0.3)]
add("sca_50_weighted", "cand", x=(lambda: r6(X.weighted_mean([(C(n), w) for n, w in _WC])), _r(_wsum(_WC, ""))))
add("sca_51_decision_id", "pool", id=(lambda: F.sha1(F.concat_ws("\n", F.coalesce("source_key", F.lit("")), F.coalesce("known_type", F.lit("")), C("pool_id").cast("string"))), "sha1(coalesce(source_key, '') || chr(10) || coalesce(known_type, '') || chr(10) || pool_id)"))
add("sca_53_short_id", "rec", id=(lambda: F.substring(F.sha2("key", 256), 1, 16), "substring(sha256(key), 1, 16)"))
_BITS = "array_to_string(list_transform(embedding[{}:{}], lambda x: case when x > 0 then '1' else '0' end), '')"
_bits = lambda a, n: F.array_join(F.transform(F.slice("embedding", a, n), lambda x: F.when(x > 0, "1").otherwise("0")), "")
add("sca_55_hamming", "embeddings", bits=(lambda: X.bits_differing(_bits(1, 32), _bits(33, 32)), f"hamming({_BITS.format(1, 32)}, {_BITS.format(33, 64)})::int"))
add("sca_56_hex_hamming", "pool", bits=(lambda: X.hex_bits_differing(F.md5("source_key"), F.md5("source_id")), "list_sum(list_transform(range(1, 33), lambda i: bit_count(xor(('0x' || md5(source_key)[i])::int, ('0x' || md5(source_id)[i])::int))))::int"))
add("sca_57_average_hash", "embeddings", bits=(lambda: F.array_join(F.transform("embedding", lambda x: F.when(x.cast("double") > X.total(C("embedding")) / F.size("embedding"), "1").otherwise("0")), ""), "array_to_string(list_transform(embedding, lambda x: case when x::double > list_sum(embedding::double[]) / len(embedding) then '1' else '0' end), '')"))
add("sca_58_entropy", "pool", x=(lambda: r6(_entropy(F.map_values("opportunities"))), "case when opportunities is not null then coalesce(round(abs(list_sum(list_transform(map_values(opportunities), lambda v: case when v > 0 then v / list_sum(map_values(opportunities)) * log2(v / list_sum(map_values(opportunities))) else 0.0 end))), 6), 0.0) end"))


def _entropy(values):
    p = F.transform(values, lambda v: F.try_divide(v, X.total(values)))
    return F.abs(F.aggregate(F.transform(p, lambda q: F.when(q > 0, q * F.log2(q)).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x))


log_query("sca_61_round", "coalesce(try_cast(regexp_extract(edited_image_path, 'r(\\d+)/', 1) as int), 0) as round", round=lambda: F.coalesce(F.regexp_extract("edited_image_path", r"r(\d+)/", 1).try_cast("int"), F.lit(0)))
add("sca_62_cell", "rec", cell=(lambda: F.when(F.lower(F.trim("author")).isin("", "nan"), None).otherwise(C("author")), "case when lower(trim(author)) not in ('', 'nan') then author end"))
add("sca_63_stamp", "events", stamp=(lambda: F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'"), "strftime(ts, '%Y%m%dT%H%M%SZ')"))
_NOUN = r"(?:[a-z]+ ){0,2}(?:kettle|basket|suitcase|doormat|globe|awning|signpost)"
add("sca_64_objects", "rec", objects=(lambda: F.array_join(F.array_distinct(F.transform(F.regexp_extract_all(F.lower(F.coalesce("caption", F.lit(""))), F.lit(_NOUN), F.lit(0)), I.without_article)), "|"), rf"coalesce(array_to_string(list_transform(regexp_extract_all(lower(coalesce(caption, '')), '{_NOUN}'), lambda x: regexp_replace(trim(x), '^(a|an|the)\s+', '')), '|'), '')"))
add("sca_65_preferred", "rec", preferred=(lambda: I.any_of(C("caption"), ["kettle", "basket"]) & ~I.any_of(C("caption"), ["crowd", "wall"]), "(contains(lower(coalesce(caption, '')), 'kettle') or contains(lower(coalesce(caption, '')), 'basket')) and not (contains(lower(coalesce(caption, '')), 'crowd') or contains(lower(coalesce(caption, '')), 'wall'))"))
add("sca_66_region_rule", "rec", region=(lambda: F.when(I.any_of(C("caption"), ["next to the doorway"]), "left").when(I.any_of(C("caption"), ["under", "lower"]), "bottom").otherwise("centre"), "case when contains(lower(coalesce(caption, '')), 'next to the doorway') then 'left' when contains(lower(coalesce(caption, '')), 'under') or contains(lower(coalesce(caption, '')), 'lower') then 'bottom' else 'centre' end"))
_T = "list_transform(list_filter({w}, lambda w: not list_contains([" + ", ".join(f"'{w}'" for w in I.STOP_WORDS) + "], w)), lambda w: case when length(w) > 3 and ends_with(w, 's') then w[:-2] else w end)"
log_query("sca_67_overlap", f"list_has_any({_T.format(w=_W.format(_I))}, {_T.format(w=_W.format('caption'))}) as shared", shared=lambda: I.shares_term(INS(), C("caption")))
log_query("sca_68_indefinite", "case when proposal.structured_edit.target is null then null when lower(substring(proposal.structured_edit.target, 1, 1)) in ('a', 'e', 'i', 'o', 'u') then 'an ' || proposal.structured_edit.target else 'a ' || proposal.structured_edit.target end as text", text=lambda: I.with_article(C("proposal.structured_edit.target")))
log_query("sca_69_template", f"list_filter(['next to the doorway', 'under the arch', 'behind the railing'], lambda t: not contains(lower(coalesce({_I}, '')), t))[1] as template", template=lambda: F.get(F.filter(F.array(*[F.lit(t) for t in ("next to the doorway", "under the arch", "behind the railing")]), lambda t: ~F.contains(F.lower(F.coalesce(INS(), F.lit(""))), t)), F.lit(0)))
add("sca_70_proposal", "pool", text=(lambda: F.when(C("known_type") == "object_removal", F.concat(F.lit("Remove the object in "), "source_key")).when(C("known_type") == "color_change", F.concat(F.lit("Recolour "), "source_key")).otherwise(F.concat(F.lit("Adjust "), "source_key")), "case when known_type = 'object_removal' then 'Remove the object in ' || source_key when known_type = 'color_change' then 'Recolour ' || source_key else 'Adjust ' || source_key end"))
add("sca_71_terms", "rec", terms=(lambda: F.array_join(I.content_terms(C("caption")), " "), f"array_to_string({_T.format(w=_W.format('caption'))}, ' ')"))


@R.query("sca_74_placeholder", "select key, ingested_at, lower(trim(author)) in (select filler from placeholder_values) as placeholder from source_records where author is not null group by all")
def placeholder(spark: SparkSession, sf: str) -> DataFrame:
    words = [r.filler for r in whole_list(read(spark, sf, "placeholder_values"), "fillers")]
    return read(spark, sf, "source_records").where("author is not null").select("key", "ingested_at", F.lower(F.trim("author")).isin(words).alias("placeholder")).distinct()


log_query("sca_75_scoped", f"case when proposal.structured_edit.target_region is null or contains({_I}, proposal.structured_edit.target_region) then {_I} else {_I} || ' ' || proposal.structured_edit.target_region end as text", text=lambda: F.when(C("proposal.structured_edit.target_region").isNull() | INS().contains(C("proposal.structured_edit.target_region")), INS()).otherwise(F.concat_ws(" ", INS(), "proposal.structured_edit.target_region")))
_LIST = "coalesce(array_to_string(list_filter(proposal.structured_edit.{0}, lambda x: trim(x) <> '')[1:2], '|'), '') as {0}"
_list = lambda n: (lambda: F.coalesce(F.array_join(F.slice(F.filter(C(f"proposal.structured_edit.{n}"), lambda x: F.trim(x) != ""), 1, 2), "|"), F.lit("")))
log_query("sca_76_rubric", ", ".join(_LIST.format(n) for n in ("required_after", "forbidden_after", "preserve")), **{n: _list(n) for n in ("required_after", "forbidden_after", "preserve")})
log_query("sca_77_taxonomy", "proposal.family as main, proposal.operation_id as target, len(distractors)::int as wrong", main=lambda: C("proposal.family"), target=lambda: C("proposal.operation_id"), wrong=lambda: F.size("distractors"))
log_query("sca_78_phrase", rf"trim(regexp_replace(regexp_replace(lower(coalesce({_I}, '')), '\b(the|a|an|some)\b', '', 'g'), '[^a-z0-9]+', ' ', 'g')) as phrase", phrase=lambda: F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(INS(), F.lit(""))), r"\b(the|a|an|some)\b", ""), "[^a-z0-9]+", " ")))
log_query("sca_79_region_target", "coalesce(case when lower(proposal.structured_edit.target) not in ('scene', 'image') then proposal.structured_edit.target end, proposal.structured_edit.source_object, 'whole image') as target", target=lambda: F.coalesce(F.when(~F.lower("proposal.structured_edit.target").isin("scene", "image"), C("proposal.structured_edit.target")), C("proposal.structured_edit.source_object"), F.lit("whole image")))


@R.query("sca_80_payload_list", "select distinct raw_id, json_extract_string(coalesce(json_extract(j, '$.data'), j), '$.proposal.operation_id') as operation_id from (select raw_id, try_cast(payload as json) as j from raw_lines) where json_type(j) = 'OBJECT'")
def payload_list(spark: SparkSession, sf: str) -> DataFrame:
    """The object itself or what its envelope holds."""
    v = read(spark, sf, "raw_lines").select("raw_id", F.try_parse_json("payload").alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    inner = F.coalesce(F.try_variant_get("v", "$.data.proposal.operation_id", "string"), F.try_variant_get("v", "$.proposal.operation_id", "string"))
    return v.select("raw_id", inner.alias("operation_id")).distinct()
