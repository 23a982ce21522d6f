"""Projection, path access and coercion queries (PRJ)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import exprs as X
from millrace.plans.base import CAND, POOL, REC, Registry, candidates, columns_query, pool, read, records

R = Registry()
QUERIES, SQL = R.QUERIES, R.SQL
C = F.col


def log(name: str, sql: str, **columns) -> None:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return read(spark, sf, "candidate_log").select("log_seq", *[make().alias(c) for c, make in columns.items()]).distinct()

    R.QUERIES[name] = query
    R.SQL[name] = f"select distinct log_seq, {sql} from candidate_log"


def add(name: str, view: str, **columns) -> None:
    columns_query(R, name, view, columns)


_FS = lambda x: f"case when isfinite({x}) then {x} end"
log("prj_1_path_text", "coalesce(proposal.structured_edit.edit_type, 'unknown') as edit_type", edit_type=lambda: F.coalesce(C("proposal.structured_edit.edit_type").cast("string"), F.lit("unknown")))
log("prj_2_path", "proposal.structured_edit.target_region as region, proposal.target as target", region=lambda: C("proposal.structured_edit.target_region"), target=lambda: C("proposal.target"))
_NAMES = ("technical_quality_score", "structure_score", "object_region_clarity", "score")
#: Where each name may stand, in order: the record itself, then its containers.
_HELD = {"technical_quality_score": ("stats_scores",), "structure_score": ("stats_scores",), "object_region_clarity": ("vlm",), "score": ("",)}
_WHERE = [f"{c}.{n}" if c else n for n in _NAMES for c in _HELD[n]]
add("prj_3_containers", "rec", x=(lambda: F.coalesce(*[F.when(~F.isnan(C(w)), C(w)) for w in _WHERE]), "coalesce(" + ", ".join(f"case when not isnan({w}) then {w} end" for w in _WHERE) + ")"))
add("prj_4_first_hit", "rec", x=(lambda: X.finite_or(F.coalesce(C("vlm.removable_object_score"), C("vlm.object_region_clarity")), 0.5), "coalesce(case when isfinite(coalesce(vlm.removable_object_score, vlm.object_region_clarity)) then coalesce(vlm.removable_object_score, vlm.object_region_clarity) end, 0.5)"))
_CS, _SG = "evaluator.component_scores", "evaluator.signals"
_NF = ", ".join(_FS(f"{c}['{n}']") for n in ("cepr_preservation", "rubric_preservation") for c in (_CS, _SG))


def _latest_ev(sql: str) -> str:
    return f"select log_seq, {sql} from candidate_log group by log_seq"


@R.query("prj_5_named_finite", _latest_ev(f"max(coalesce({_NF}, 0.0)) as x"))
def named_finite(spark: SparkSession, sf: str) -> DataFrame:
    """Passes over non-finite values to the next container and name."""
    x = X.named_finite([C(_CS), C(_SG)], ["cepr_preservation", "rubric_preservation"], 0.0)
    return read(spark, sf, "candidate_log").groupBy("log_seq").agg(F.max(x).alias("x"))


@R.query("prj_6_named_present", _latest_ev("max(case when list_contains(map_keys(evaluator.component_scores), 'cepr_edit_specificity') then coalesce(case when isfinite(evaluator.component_scores['cepr_edit_specificity']) then evaluator.component_scores['cepr_edit_specificity'] end, 0.0) when list_contains(map_keys(evaluator.component_scores), 'cepr_semantic_edit') then coalesce(case when isfinite(evaluator.component_scores['cepr_semantic_edit']) then evaluator.component_scores['cepr_semantic_edit'] end, 0.0) else 0.0 end) as x"))
def named_present(spark: SparkSession, sf: str) -> DataFrame:
    """The first name present decides, finite or not."""
    return read(spark, sf, "candidate_log").groupBy("log_seq").agg(F.max(X.named_present(C(_CS), ["cepr_edit_specificity", "cepr_semantic_edit"], 0.0)).alias("x"))


@R.query("prj_7_two_containers", _latest_ev(f"max(coalesce({', '.join(_FS(f'{c}[{chr(39)}object_detector_contract{chr(39)}]') for c in (_CS, _SG))}, 1.0)) as x"))
def two_containers(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "candidate_log").groupBy("log_seq").agg(F.max(X.named_finite([C(_CS), C(_SG)], ["object_detector_contract"], 1.0)).alias("x"))


#: Logical names and the physical ones tried for each, in order.
ALIASES = {"edit": ["cepr_edit_specificity", "cepr_semantic_edit"], "keep": ["cepr_preservation", "rubric_preservation"], "valid": ["cepr_validity", "rubric_validity"]}


@R.query("prj_8_aliases", _latest_ev(", ".join(f"max(coalesce({', '.join(_FS(f'{_CS}[{chr(39)}{n}{chr(39)}]') for n in names)}, 0.0)) as {a}" for a, names in ALIASES.items())))
def aliases(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "candidate_log").groupBy("log_seq").agg(*[F.max(X.named_finite([C(_CS)], names, 0.0)).alias(a) for a, names in ALIASES.items()])


log("prj_9_payload", "coalesce(evaluator, solver).total_score as score, coalesce(evaluator, solver) is null as missing", score=lambda: F.coalesce("evaluator", "solver")["total_score"], missing=lambda: F.coalesce("evaluator", "solver").isNull())
log("prj_10_edit_type", "coalesce(nullif(trim(proposal.structured_edit.edit_type), ''), nullif(trim(proposal.family), ''), 'unknown') as edit_type", edit_type=lambda: F.coalesce(X.filled(C("proposal.structured_edit.edit_type")), X.filled(C("proposal.family")), F.lit("unknown")))
log("prj_11_family_change", "case when proposal.structured_edit.edit_type is not null then proposal.structured_edit.edit_type when proposal.family in ('object', 'style') then proposal.family else proposal.family || '_change' end as edit_type", edit_type=lambda: F.coalesce(C("proposal.structured_edit.edit_type"), F.when(C("proposal.family").isin("object", "style"), C("proposal.family")).otherwise(F.concat("proposal.family", F.lit("_change")))))
AXES = {"edit_type": "edit_type", "family": "family", "level": "level::varchar"}


@R.query("prj_12_axes", f"with {CAND} " + " union all ".join(f"select '{a}' as axis, {e} as value, count(*) as n from cand group by all" for a, e in AXES.items()))
def axes(spark: SparkSession, sf: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(a).alias("axis"), C(a).cast("string").alias("value")) for a in AXES])
    return candidates(spark, sf).select(F.explode(pairs).alias("p")).groupBy("p").agg(F.count("*").alias("n")).select("p.*", "n")


add("prj_13_source_key", "rec", base=(lambda: F.substring_index("key", "__reward_pool__", 1), "split_part(key, '__reward_pool__', 1)"), stem=(lambda: F.regexp_extract("image", r"([^/]+?)(\.[^.]*)?$", 1), r"regexp_extract(image, '([^/]+?)(\.[^.]*)?$', 1)"))
_FAM = "list_distinct(list_filter(list_transform(regexp_split_to_array(coalesce(edit_families_text, ''), '[,;]'), lambda x: lower(trim(x))), lambda x: x not in ('', 'unknown')))"
add("prj_14_families", "rec", families=(lambda: F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.coalesce("edit_families_text", F.lit("")), "[,;]"), lambda x: F.lower(F.trim(x))), lambda x: ~x.isin("", "unknown")))), "|"), f"coalesce(array_to_string(list_sort({_FAM}), '|'), '')"))


@R.query("prj_15_manifest", f"with {REC} select key as id, image as edit_image, caption as prompt from rec")
def manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Renames by a mapping; a field that isn't there raises when the plan is made."""
    names = {"key": "id", "image": "edit_image", "caption": "prompt"}
    return records(spark, sf).select(*[C(a).alias(b) for a, b in names.items()])


add("prj_16_split_list", "rec", parts=(lambda: F.array_join(X.text_list(F.coalesce("edit_families_text", F.lit("")), r"\|"), "/"), "coalesce(array_to_string(list_filter(list_transform(string_split(coalesce(edit_families_text, ''), '|'), lambda x: trim(x)), lambda x: x <> ''), '/'), '')"))
add("prj_17_relative", "rec", path=(lambda: F.regexp_replace("image", "^pool/", ""), "regexp_replace(image, '^pool/', '')"))


@R.query("prj_18_caption_shapes", "select distinct raw_id, case json_type(json_extract(j, '$.caption')) when 'VARCHAR' then json_extract_string(j, '$.caption') end as caption from (select raw_id, try_cast(payload as json) as j from raw_lines) where json_type(j) = 'OBJECT'")
def caption_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """A caption may be text, a list or an object; the first text in it counts."""
    v = read(spark, sf, "raw_lines").select("raw_id", F.try_parse_json("payload").alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    c = F.try_variant_get("v", "$.caption", "variant")
    shape = F.schema_of_variant(c)
    text = F.when(shape == "STRING", F.try_variant_get("v", "$.caption", "string")).when(shape.startswith("ARRAY"), F.try_variant_get("v", "$.caption[0]", "string")).when(shape.startswith("OBJECT"), F.try_variant_get("v", "$.caption.text", "string"))
    return v.select("raw_id", text.alias("caption")).distinct()


add("prj_19_which_field", "rec", text=(lambda: F.coalesce(X.filled(C("caption")), X.filled(C("page")), C("key")), "coalesce(nullif(trim(caption), ''), nullif(trim(page), ''), key)"), field=(lambda: X.first_reason([("caption", X.filled(C("caption")).isNotNull()), ("page", X.filled(C("page")).isNotNull())], "key"), "case when nullif(trim(caption), '') is not null then 'caption' when nullif(trim(page), '') is not null then 'page' else 'key' end"))
add("prj_20_scalar_text", "documents", text=(lambda: F.coalesce(X.filled(C("lang")), C("n_chars").cast("string")), "coalesce(nullif(trim(lang), ''), n_chars::varchar)"))
add("prj_21_flag", "documents", flag=(lambda: X.as_flag(F.when(C("lang") == "en", " Yes ").otherwise(F.when(C("lang").isNotNull(), "0"))), "case when lang = 'en' then true when lang is not null then false end"))


@R.query("prj_22_count_map", "select event_id, try_cast(json_extract_string(props, '$.k') as int) as k from events where try_cast(json_extract_string(props, '$.k') as int) > 0")
def count_map(spark: SparkSession, sf: str) -> DataFrame:
    """Positive whole numbers of a JSON object."""
    m = F.map_filter(F.from_json("props", "map<string,int>"), lambda _, v: v > 0)
    return read(spark, sf, "events").select("event_id", m["k"].alias("k")).where("k is not null")


add("prj_23_number_map", "documents", x=(lambda: X.number_map(F.concat(F.lit("a:1.5, b:nan, c:"), C("n_chars").cast("string")), above=-1.0)["c"], "n_chars::double"), n=(lambda: F.size(X.number_map(F.concat(F.lit("a:1.5, b:nan, c:"), C("n_chars").cast("string")), above=-1.0)), "2"))
add("prj_24_equal_map", "documents", x=(lambda: X.number_map(F.concat(F.lit("a=2;b=0;c="), C("n_chars").cast("string")), ";", "=")["a"], "2.0::double"), n=(lambda: F.size(X.number_map(F.concat(F.lit("a=2;b=0;c="), C("n_chars").cast("string")), ";", "=")), "case when n_chars > 0 then 2 else 1 end"))
add("prj_25_text_list", "rec", n=(lambda: F.size(X.text_list(F.coalesce("edit_families_text", F.lit("")), "[,;|]")), "len(list_filter(list_transform(regexp_split_to_array(coalesce(edit_families_text, ''), '[,;|]'), lambda x: trim(x)), lambda x: x <> ''))::int"))


@R.query("prj_26_wide_row", f"with {CAND} select group_id, candidate_index, status, score, raw, accepted from cand")
def wide_row(spark: SparkSession, sf: str) -> DataFrame:
    """A nested candidate row built and read back."""
    row = F.struct("status", F.struct("score", "raw", "accepted").alias("evaluator"))
    return candidates(spark, sf).select("group_id", "candidate_index", row.alias("row")).select("group_id", "candidate_index", "row.status", "row.evaluator.*")


@R.query("prj_27_exports", f"with {CAND} select group_id, candidate_index, case when accepted then 'sft' when status = 'rejected' then 'preference' end as export from cand where accepted or status = 'rejected'")
def exports(spark: SparkSession, sf: str) -> DataFrame:
    return candidates(spark, sf).where("accepted or status = 'rejected'").select("group_id", "candidate_index", F.when(C("accepted"), "sft").when(C("status") == "rejected", "preference").alias("export"))


add("prj_28_brief", "cand", score=(lambda: F.round("score", 4), "round(score, 4)"), reason=(lambda: F.substring(F.coalesce("record_key", F.lit("")), 1, 22), "substring(coalesce(record_key, ''), 1, 22)"))


@R.query("prj_29_derived_keys", f"with {POOL} select pool_id, source_key || '__reward_pool__' || coalesce(known_type, 'unknown') || '__' || lpad((row_number() over (partition by source_key order by pool_id) - 1)::varchar, 6, '0') as key from pool")
def derived_keys(spark: SparkSession, sf: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("source_key").orderBy("pool_id")) - 1
    return pool(spark, sf).select("pool_id", F.format_string("%s__reward_pool__%s__%06d", "source_key", F.coalesce("known_type", F.lit("unknown")), n).alias("key"))


def parse_override(text: str):
    """A command-line value: null, flag, whole number, number, JSON or text."""
    lowered = text.strip().lower()
    if lowered in ("null", "none", ""):
        return None
    if lowered in ("true", "false"):
        return lowered == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    if text.strip()[:1] in "[{":
        try:
            return json.loads(text)
        except ValueError:
            pass
    return text


def merged(base: dict, path: str, value) -> dict:
    """``base`` with the value at a dotted path; maps on the way are made, others replaced."""
    head, _, rest = path.partition(".")
    inner = base.get(head)
    return base | {head: merged(inner if isinstance(inner, dict) else {}, rest, value) if rest else value}


@R.query("prj_30_31_overrides", f"with {CAND} select group_id, candidate_index from cand where score >= 0.55")
def overridden(spark: SparkSession, sf: str) -> DataFrame:
    """A threshold that comes from a configuration with an override."""
    config = merged({"gates": {"score": 0.4, "raw": 0.3}}, "gates.score", parse_override("0.55"))
    return candidates(spark, sf).where(C("score") >= config["gates"]["score"]).select("group_id", "candidate_index")


