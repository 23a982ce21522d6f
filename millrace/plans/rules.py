"""Queries over the text rules (SCA) and the region measures (IMG-11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import instructions as I
from millrace.functions import kernels as K
from millrace.functions import rules as U
from millrace.plans.arrays import BACK, BOX, _DIFF, _INSIDE, _OUTSIDE, V
from millrace.plans.base import Registry, read

R = Registry()
QUERIES, SQL = R.QUERIES, R.SQL
C = F.col
INS = "proposal.instruction"


def _log(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "candidate_log")


_FLAT = f"trim(regexp_replace(lower(coalesce({INS}, '')), '\\s+', ' ', 'g'))"
_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_ANY = lambda text, terms: "(" + " or ".join(f"contains(lower(coalesce({text}, '')), '{t}')" for t in terms) + ")"
_TARGET = "coalesce(" + ", ".join(f"case when regexp_matches(flat, '{p}') then regexp_extract(flat, '{p}', 1) end" for p in U.TARGETS) + ", flat)"
_NAMED = f"""len(tokens) > 0 and not list_has_any(tokens, ['color', 'colour']) and len(list_filter(tokens, lambda w: not list_contains({_LIST(U.COLOR_WORDS + U.FILL_WORDS)}, w))) > 0
  and (list_has_any(tokens, {_LIST(U.OBJECT_HINTS)}) or len(list_filter(tokens, lambda w: not list_contains({_LIST(U.COLOR_WORDS)}, w))) >= 2)"""
_SIGNED = f"""flat as (select log_seq, {_FLAT} as flat from candidate_log), tok as (select *, list_distinct(regexp_extract_all({_TARGET}, '[a-z]+')) as tokens from flat),
  signs as (select log_seq, {", ".join(f"regexp_matches(' ' || flat || ' ', '{p}') as {n}" for n, p in U.SIGNS.items())}, {_NAMED} as named from tok)"""


def _case(rules, at: int) -> str:
    return "case " + " ".join(f"when {r[0]} then {repr(r[at]) if r[at] else 'null'}" for r in rules) + " end"


def _signs(spark: SparkSession, sf: str) -> DataFrame:
    flat = _log(spark, sf).select("log_seq", U.collapsed(C(INS)).alias("flat"))
    spaced = F.concat(F.lit(" "), C("flat"), F.lit(" "))
    return flat.select("log_seq", F.struct(*[spaced.rlike(p).alias(n) for n, p in U.SIGNS.items()], U.names_object(C("flat")).alias("named")).alias("__signs"))


@R.query("sca_30_classify", f"with {_SIGNED} select log_seq, {_case(U.LENIENT, 1)} as class, {_case(U.LENIENT, 2)} as reason, {_case(U.STRICT, 1)} as strict_class, {_case(U.STRICT, 2)} as strict_reason from signs")
def classify(spark: SparkSession, sf: str) -> DataFrame:
    """Class and reason of every instruction, by the lenient and the strict rules."""
    out = _signs(spark, sf).select("log_seq", U.classified(C("__signs"), U.LENIENT).alias("a"), U.classified(C("__signs"), U.STRICT).alias("b"))
    return out.select("log_seq", "a.class", "a.reason", C("b.class").alias("strict_class"), C("b.reason").alias("strict_reason"))


@R.query("sca_32_tokens", f"with {_SIGNED} select log_seq, named from signs")
def object_hint(spark: SparkSession, sf: str) -> DataFrame:
    return _signs(spark, sf).select("log_seq", "__signs.named")


_TYPE = f"case when lower(coalesce(proposal.family, '')) in ({', '.join(repr(f) for f in U.GLOBAL_FAMILIES)}) then 'global_adjustment' " + " ".join(f"when {_ANY(INS, terms)} then '{n}'" for n, terms in U.TYPE_TERMS) + " " + " ".join(f"when lower(proposal.family) = '{f}' then '{n}'" for f, n in U.FAMILY_TYPES) + " else 'local_enhancement' end"


@R.query("sca_37_infer", f"select log_seq, {_TYPE} as edit_type from candidate_log")
def infer_type(spark: SparkSession, sf: str) -> DataFrame:
    return _log(spark, sf).select("log_seq", U.edit_type_of(C(INS), C("proposal.family")).alias("edit_type"))


_ANSWER = "case candidate_index % 3 when 0 then '```json' || chr(10) || '{\"choice\": \" ' || status || ' \"}' || chr(10) || '```' when 1 then 'I would say ' || upper(status) || ', not more.' else 'Either {\"choice\": \"' || status || '\"} or accepted or rejected' end"
_LABELS = ("accepted", "rejected", "candidate")
_CLEAN = "trim(regexp_replace(regexp_replace(trim(t), '^```(?i:json)?', ''), '```$', ''), ' ' || chr(10))"


@R.query("sca_46_choice", f"""with a as (select log_seq, {_ANSWER} as t from candidate_log), c as (select log_seq, {_CLEAN} as c from a),
  p as (select *, trim(json_extract_string(coalesce(try_cast(c as json), try_cast(nullif(regexp_extract(c, '\\{{.*\\}}', 0, 's'), '') as json)), '$.choice')) as choice,
    list_filter([{", ".join(f"case when regexp_matches(lower(c), '\\b{w}\\b') then '{w}' end" for w in _LABELS)}], lambda x: x is not null) as hits from c)
  select log_seq, case when choice in ({", ".join(repr(w) for w in _LABELS)}) then choice when len(hits) = 1 then hits[1] end as label from p""")
def choice(spark: SparkSession, sf: str) -> DataFrame:
    """Answers as fenced JSON, as prose and as JSON within prose."""
    status = C("status")
    answer = F.when(C("candidate_index") % 3 == 0, F.concat(F.lit('```json\n{"choice": " '), status, F.lit(' "}\n```'))).when(C("candidate_index") % 3 == 1, F.concat(F.lit("I would say "), F.upper(status), F.lit(", not more."))).otherwise(F.concat(F.lit('Either {"choice": "'), status, F.lit('"} or accepted or rejected')))
    return _log(spark, sf).select("log_seq", U.chosen_label(answer, _LABELS).alias("label"))


@R.query("sca_48_failure_phrases", f"select doc_id, coalesce({' or '.join(f'regexp_matches(lower(text), {p!r})' for p in U.FAILED_REMOVAL)}, false) as failed from documents".replace("\\\\", "\\"))
def failure_phrases(spark: SparkSession, sf: str) -> DataFrame:
    lowered = F.lower("text")
    return read(spark, sf, "documents").select("doc_id", F.coalesce(F.array_contains(F.array(*[lowered.rlike(p) for p in U.FAILED_REMOVAL]), True), F.lit(False)).alias("failed"))


_EDIT = ("edit_type", "instruction", "target", "replacement", "source_object", "target_object", "target_region")
_ENTRIES = ", ".join(f"'\"{f}\": \"' || replace(replace(proposal.structured_edit.{f}, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"') || '\"'" for f in sorted(_EDIT))


@R.query("sca_52_canonical", f"select log_seq, sha1('{{' || array_to_string(list_filter([{_ENTRIES}], lambda x: x is not null), ', ') || '}}') as id from candidate_log")
def canonical_id(spark: SparkSession, sf: str) -> DataFrame:
    return _log(spark, sf).select("log_seq", F.sha1(U.canonical([(f, C(f"proposal.structured_edit.{f}")) for f in _EDIT])).alias("id"))


@R.query("sca_54_safe_key", "with k as (select key, regexp_replace(regexp_replace(trim(coalesce(page, '')), '[^A-Za-z0-9_.-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') as s from source_records) select key, case when s = '' then 'item' else substring(s, 1, 160) end as safe from k")
def safe_keys(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "source_records").select("key", U.item_key(C("page")).alias("safe"))


@R.query("sca_59_ranges", """with t as (select snapshot_no, round_index || '-' || (round_index + groups_total % 4) || ', ' || groups_evaluated || ',,' || round_index as t from round_metrics where round_index >= 0 and groups_total >= 0 and groups_evaluated >= 0),
  p as (select snapshot_no, list_filter(list_transform(string_split(t, ','), lambda x: trim(x)), lambda x: x <> '') as p from t)
  select snapshot_no, array_to_string(list_sort(list_distinct(flatten(list_transform(p, lambda x: case when contains(x, '-') then range(split_part(x, '-', 1)::int, split_part(x, '-', 2)::int + 1) else [x::bigint] end)))), '|') as rounds from p""")
def ranges(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat("round_index", F.lit("-"), C("round_index") + C("groups_total") % 4, F.lit(", "), "groups_evaluated", F.lit(",,"), "round_index")
    rows = read(spark, sf, "round_metrics").where("round_index >= 0 and groups_total >= 0 and groups_evaluated >= 0").select("snapshot_no", text.cast("string").alias("t"))
    return rows.select("snapshot_no", F.array_join(U.listed_rounds(C("t")), "|").alias("rounds"))


@R.query("sca_60_fractions", "select pool_id, scored_at, (pool_id % 100)::double / 100 as object_removal, 0.25::double as color_change, 0.0::double as style_transfer from pool_candidates")
def fractions(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit(" object_removal ="), (C("pool_id") % 100).cast("double") / 100, F.lit(",, color_change= 0.25 "))
    return read(spark, sf, "pool_candidates").select("pool_id", "scored_at", *[U.fraction_of(text, n).alias(n) for n in ("object_removal", "color_change", "style_transfer")])


_FORBID = "proposal.structured_edit.forbidden_after[1]"
_SPEC = ("target_object", "replacement", "target_attribute", "target_material", "target_style")
_STOP = _LIST(I.STOP_WORDS)
_TERMS = f"list_transform(list_filter(regexp_extract_all(lower(coalesce({{}}, '')), '[a-z0-9]+'), lambda w: not list_contains({_STOP}, w)), lambda w: case when length(w) > 3 and ends_with(w, 's') then w[:-2] else w end)"
_WANTED = "array_to_string(list_concat(coalesce(proposal.structured_edit.required_after, []), [" + ", ".join(f"proposal.structured_edit.{f}" for f in _SPEC) + "]), ' ')"


@R.query("sca_72_contradiction", f"""select log_seq, coalesce(proposal.structured_edit.edit_type, '') in ({', '.join(repr(t) for t in U.NEGATABLE_TYPES)}) and {_ANY(_FORBID, U.NEGATIONS)}
  and list_has_any({_TERMS.format(_WANTED)}, {_TERMS.format(_FORBID)}) as contradicts from candidate_log""")
def contradiction(spark: SparkSession, sf: str) -> DataFrame:
    """A forbidden prompt that denies what the edit requires."""
    edit = C("proposal.structured_edit")
    text = F.get(edit["forbidden_after"], F.lit(0))
    wanted = F.concat_ws(" ", edit["required_after"], *[edit[f] for f in _SPEC])
    own = F.coalesce(edit["edit_type"].isin(*U.NEGATABLE_TYPES), F.lit(False))
    return _log(spark, sf).select("log_seq", (own & U.contains_any(text, U.NEGATIONS) & F.arrays_overlap(I.content_terms(wanted), I.content_terms(text))).alias("contradicts"))


@R.query("sca_73_generic", f"select log_seq, trim(coalesce({_FORBID}, '')) = '' or {_ANY(_FORBID, U.GENERIC_MARKERS)} as generic from candidate_log")
def generic(spark: SparkSession, sf: str) -> DataFrame:
    text = F.get("proposal.structured_edit.forbidden_after", F.lit(0))
    return _log(spark, sf).select("log_seq", ((F.trim(F.coalesce(text, F.lit(""))) == "") | U.contains_any(text, U.GENERIC_MARKERS)).alias("generic"))


def _measures(d: str) -> dict[str, str]:
    inside, outside = _INSIDE.format(d=d), _OUTSIDE.format(d=d)
    over = lambda x: f"list_sum(list_transform({x}, lambda v: (v > 0.1)::int))"
    square = lambda x: f"list_avg(list_transform({x}, lambda v: v * v))"
    psnr = lambda x: f"case when {square(x)} <= 1e-12 then 60.0 else least(60.0, -10.0 * log10({square(x)})) end"
    return {
        "target_area": "16 / 64.0::double", "outside_area": "48 / 64.0::double", "changed": f"{over(d)} / 64.0::double", "target_change": f"list_avg({inside})", "outside_change": f"list_avg({outside})",
        "target_changed": f"{over(inside)} / 16.0::double", "outside_changed": f"{over(outside)} / 48.0::double", "target_pixels": f"{over(inside)} / 64.0::double", "outside_pixels": f"{over(outside)} / 64.0::double",
        "precision": f"case when {over(d)} > 0 then {over(inside)} / {over(d)}::double else 1.0 end", "target_mse": square(inside), "outside_mse": square(outside), "target_psnr": psnr(inside), "outside_psnr": psnr(outside),
    }


@R.query("img_11_region", f"with d as (select vec_id, {_DIFF} as d from embeddings) select vec_id, " + ", ".join(f"round({s}, 5) as {n}" for n, s in _measures("d").items()) + " from d")
def region(spark: SparkSession, sf: str) -> DataFrame:
    """Fourteen measures of what an edit changed inside the region meant and outside it."""
    found = K.region_measures(K.difference(V(), BACK()), BOX(), 0.1)
    return read(spark, sf, "embeddings").select("vec_id", *[F.round(x, 5).alias(n) for n, x in found.items()])
