"""Shared views of the tables for the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from millrace.functions.exprs import filled, finite
from millrace.functions.text import base_key
from millrace.operators.latest import latest_by

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries of a module with their SQL, where SQL can express them."""

    def __init__(self) -> None:
        self.QUERIES: dict[str, Query] = {}
        self.SQL: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.QUERIES[name] = f
            if sql is not None:
                self.SQL[name] = sql
            return f

        return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def whole_list(rows: DataFrame, what: str, most: int = 10_000) -> list[Row]:
    """All rows of a table written by people; more than ``most`` is an error, never a cut."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} {what}")
    return found


#: Short names of the components and signals that the queries use.
COMPONENTS = {
    "edit": "cepr_edit_specificity",
    "taxonomy": "cepr_taxonomy",
    "semantic": "cepr_semantic_edit",
    "preservation": "cepr_preservation",
    "validity": "cepr_validity",
    "raw": "cepr_raw_reward",
    "rubric": "rubric_edit_success",
}
SIGNALS = {"changed": "cepr_latent_changed_fraction", "drift": "cepr_latent_drift_score", "judge": "internal_vlm_judge_score", "gain": "cepr_true_prompt_gain", "rival": "cepr_max_distractor_gain"}


def candidates(spark: SparkSession, sf: str, *more: Column) -> DataFrame:
    """The valid candidates with their scores as plain columns; non-finite scores are null.

    Copies of a log entry may differ in their maps; the one with the higher scores counts.
    """
    log = read(spark, sf, "candidate_log")
    ev = F.coalesce("evaluator", "solver")
    flat = log.select(
        "log_seq", "group_id", "candidate_index", "logged_at", "candidate_role", "record_key", "status",
        base_key(F.col("record_key")).alias("base"),
        F.coalesce(filled(F.col("proposal.structured_edit.edit_type")), filled(F.col("proposal.family")), F.lit("unknown")).alias("edit_type"),
        F.col("proposal.family").alias("family"), F.col("proposal.round_index").alias("round"), F.col("proposal.difficulty_level").alias("level"),
        F.coalesce(ev["accepted"], F.lit(False)).alias("accepted"),
        finite(ev["total_score"]).alias("score"), finite(ev["global_score"]).alias("global_score"), finite(ev["local_score"]).alias("local_score"),
        *[finite(ev["component_scores"][name]).alias(short) for short, name in COMPONENTS.items()],
        *[finite(ev["signals"][name]).alias(short) for short, name in SIGNALS.items()],
        *more,
    )
    return latest_by(flat, ["group_id", "candidate_index"], "logged_at", [F.col("log_seq").desc(), *[F.col(c).desc_nulls_last() for c in (*COMPONENTS, *SIGNALS)]]).drop("logged_at", "log_seq")


def _sql_finite(x: str) -> str:
    return f"case when isfinite({x}) then {x} end"


CAND_COLUMNS = ", ".join(
    [
        "group_id, candidate_index, candidate_role, record_key, status",
        "split_part(record_key, '__reward_pool__', 1) as base",
        "coalesce(nullif(trim(proposal.structured_edit.edit_type), ''), nullif(trim(proposal.family), ''), 'unknown') as edit_type",
        "proposal.family as family, proposal.round_index as round, proposal.difficulty_level as level",
        "coalesce(coalesce(evaluator, solver).accepted, false) as accepted",
        *(f"{_sql_finite(f'coalesce(evaluator, solver).{s}')} as {a}" for s, a in (("total_score", "score"), ("global_score", "global_score"), ("local_score", "local_score"))),
        *(f"{_sql_finite(f'''coalesce(evaluator, solver).component_scores['{name}']''')} as {short}" for short, name in COMPONENTS.items()),
        *(f"{_sql_finite(f'''coalesce(evaluator, solver).signals['{name}']''')} as {short}" for short, name in SIGNALS.items()),
    ]
)
#: SQL of ``candidates``, to go after WITH.
_TIES = ", ".join(f"{c} desc nulls last" for c in (*COMPONENTS, *SIGNALS))
CAND = f"""flat as (select log_seq, logged_at, {CAND_COLUMNS} from candidate_log
), cand as (
  select * exclude (version, log_seq, logged_at) from (select *, row_number() over (partition by group_id, candidate_index order by logged_at desc nulls last, log_seq desc, {_TIES}) as version from flat) where version = 1
)"""


_RECORD_TIES = ["score", *(f"vlm.{c}" for c in "quality_score natural_image_score editable_content_score object_region_clarity removable_object_score small_object_separability preservation_potential clutter_penalty text_watermark_penalty".split()), *(f"stats_scores.{c}" for c in "technical_quality_score structure_score saturation_score contrast_score".split())]


def records(spark: SparkSession, sf: str) -> DataFrame:
    """The valid source records."""
    return latest_by(read(spark, sf, "source_records"), ["key"], "ingested_at", [F.col(c).desc_nulls_last() for c in _RECORD_TIES])


REC = f"rec as (select * exclude (version) from (select *, row_number() over (partition by key order by ingested_at desc nulls last, {', '.join(c + ' desc nulls last' for c in _RECORD_TIES)}) as version from source_records) where version = 1)"


def pool(spark: SparkSession, sf: str) -> DataFrame:
    """The valid pool candidates, with ``known_type`` where the type has a known alias."""
    rows = latest_by(read(spark, sf, "pool_candidates"), ["pool_id"], "scored_at")
    names = read(spark, sf, "edit_type_names").select(F.col("alias").alias("__alias"), F.col("edit_type").alias("known_type"))
    return rows.withColumn("__alias", F.lower(F.trim("edit_type"))).join(F.broadcast(names), "__alias", "left").drop("__alias")


POOL = """pool as (select p.*, n.edit_type as known_type from (
  select * exclude (version) from (select *, row_number() over (partition by pool_id order by scored_at desc nulls last) as version from pool_candidates) where version = 1) p
  left join edit_type_names n on n.alias = lower(trim(p.edit_type)))"""


def r6(x: Column) -> Column:
    return F.round(x, 6)


def document_rows(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents")


#: For queries that are expressions over one view: the view, its key and its SQL.
VIEWS: dict[str, tuple[Query, list[str], str]] = {
    "cand": (candidates, ["group_id", "candidate_index"], f"with {CAND} select {{}} from cand"),
    "rec": (records, ["key"], f"with {REC} select {{}} from rec"),
    "pool": (pool, ["pool_id"], f"with {POOL} select {{}} from pool"),
    "documents": (document_rows, ["doc_id"], "select {} from documents"),
    "embeddings": (lambda spark, sf: read(spark, sf, "embeddings"), ["vec_id"], "select {} from embeddings"),
    "events": (lambda spark, sf: read(spark, sf, "events"), ["event_id"], "select {} from events"),
}


def columns_query(registry: Registry, name: str, view: str, columns: dict[str, tuple[Callable[[], Column], str | None]]) -> None:
    """Registers a projection of a view: per output column the expression and its SQL."""
    source, key, sql = VIEWS[view]

    def query(spark: SparkSession, sf: str) -> DataFrame:
        return source(spark, sf).select(*key, *[make().alias(c) for c, (make, _) in columns.items()])

    registry.QUERIES[name] = query
    if all(text is not None for _, text in columns.values()):
        registry.SQL[name] = sql.format(", ".join([*key, *(f"{text} as {c}" for c, (_, text) in columns.items())]))
