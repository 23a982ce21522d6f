"""The queries of this subpackage over whole tables, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from millrace.functions.ordered import is_finite, ordered_bits
from millrace.functions.text import base_key, token_count, trimmed_lower
from millrace.llm.cutoff import Cutoffs, cutoff_report, kept_rows, share_cutoffs
from millrace.llm.cutting import cut
from millrace.llm.group_splits import ComponentStore, splits, tied_keys, update_components
from millrace.llm.mixing import Mix, domain_model, mix_sources
from millrace.llm.packing import pack
from millrace.llm.quota_sample import QuotaSample, quota_sample
from millrace.llm.top_items import top_items
from millrace.operators.latest import latest_by
from millrace.scratch import keep

Query = Callable[[SparkSession, str], DataFrame]

SAMPLE_PCT = 20
TOP = 3


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def whole_list(rows: DataFrame, what: str, most: int = 10_000) -> list[Row]:
    """All rows of a table written by people; more than ``most`` is an error, never a cut."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} {what}")
    return found


def known_edit_type(spark: SparkSession, sf: str, rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``known_type``: the edit type whose alias the trimmed lower-case value is."""
    names = _read(spark, sf, "edit_type_names").select(F.col("alias").alias("__alias"), F.col("edit_type").alias("known_type"))  # fixed, 44 rows
    return rows.withColumn("__alias", trimmed_lower(F.col(column))).join(F.broadcast(names), "__alias", "left").drop("__alias")


def _sampled(spark: SparkSession, sf: str) -> QuotaSample:
    targets = _read(spark, sf, "sample_targets")
    pool = latest_by(_read(spark, sf, "pool_candidates").select("pool_id", "batch", "edit_type", "scored_at"), ["pool_id"], "scored_at")
    pool = known_edit_type(spark, sf, pool, "edit_type").select(F.lit("edit_type").alias("axis"), "batch", F.col("known_type").alias("category"), F.col("pool_id").cast("string").alias("record"))
    families = [r[0] for r in whole_list(targets.where("axis = 'family'").select("category"), "families")]
    records = latest_by(_read(spark, sf, "source_records").select("key", "batch", "edit_families", "edit_families_text", "ingested_at"), ["key"], "ingested_at")
    text = F.trim("edit_families_text")
    as_list = F.when(text.startswith("["), F.from_json(text, "array<string>"))
    listed = F.when(F.size("edit_families") > 0, F.col("edit_families")).otherwise(F.coalesce(as_list, F.split(text, "[,;|/]")))
    known = F.filter(F.transform(listed, trimmed_lower), lambda x: x.isin(families))
    records = records.select(F.lit("family").alias("axis"), "batch", F.get(known, F.lit(0)).alias("category"), F.col("key").alias("record"))
    return quota_sample(pool.unionByName(records), targets, "axis", "batch", "category", "record", SAMPLE_PCT)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _sampled(spark, sf).report.where("is_short").select(F.col("stratum").alias("batch"), "axis", "category")


def p1_report(spark: SparkSession, sf: str) -> DataFrame:
    return _sampled(spark, sf).report.withColumnRenamed("stratum", "batch")


def p1_sample(spark: SparkSession, sf: str) -> DataFrame:
    return _sampled(spark, sf).sample.select("axis", "batch", "category", "record", "rank", "priority", "within_floor")


def tie_values(spark: SparkSession, sf: str, rows: DataFrame) -> Column:
    """The values that tie a source record: base key, author, page and entities."""
    fillers = [r[0] for r in whole_list(_read(spark, sf, "placeholder_values").select("filler").where("filler is not null"), "fillers")]

    def clean(x: Column, kind: str) -> Column:
        return F.when((x != "") & ~x.isin(fillers), F.concat(F.lit(kind), x))

    author = F.regexp_replace(trimmed_lower(F.col("author")), "^@", "")
    page = F.regexp_replace(F.regexp_replace(trimmed_lower(F.col("page")), "[?#].*$", ""), "/$", "")
    entities = F.coalesce(F.transform(F.col("entities"), lambda e: clean(trimmed_lower(e), "e:")), F.array().cast("array<string>"))
    single = F.array(F.concat(F.lit("b:"), base_key(F.col("key"))), clean(author, "a:"), clean(page, "p:"))
    return F.array_compact(F.array_distinct(F.concat(single, entities)))


def _record_ties(spark: SparkSession, sf: str) -> DataFrame:
    records = latest_by(_read(spark, sf, "source_records").select("key", "author", "page", "entities", "ingested_at"), ["key"], "ingested_at")
    return records.select("key", tie_values(spark, sf, records).alias("values"))


def _log_ties(spark: SparkSession, sf: str) -> DataFrame:
    keys = _read(spark, sf, "candidate_log").select(F.col("record_key").alias("key")).where("key is not null").distinct()
    return keys.select("key", F.array(F.concat(F.lit("b:"), base_key(F.col("key")))).alias("values"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    store = ComponentStore.fresh(spark)
    update_components(store, _record_ties(spark, sf).unionByName(_log_ties(spark, sf)), None)
    return tied_keys(store)


def p2_splits(spark: SparkSession, sf: str) -> DataFrame:
    """One split per key, built in two steps: the source records, then the keys of the log."""
    store = ComponentStore.fresh(spark)
    targets = _read(spark, sf, "split_targets")
    update_components(store, _record_ties(spark, sf), targets)
    update_components(store, _log_ties(spark, sf), targets)
    return splits(store)


def p2_components(spark: SparkSession, sf: str) -> DataFrame:
    """Root and generation of every key of the store that p2_splits builds in two generations, opened again by its path."""
    store = ComponentStore.fresh(spark)
    update_components(store, _record_ties(spark, sf), None)
    update_components(ComponentStore(spark, store.path), _log_ties(spark, sf), None)
    return ComponentStore(spark, store.path).keys().select("key", "root_key", "generation")


def _cutoffs(spark: SparkSession, sf: str) -> Cutoffs:
    pool = latest_by(_read(spark, sf, "pool_candidates").select("pool_id", "source_id", "edit_type", "total_score", "scored_at"), ["pool_id"], "scored_at")
    shares = _read(spark, sf, "keep_targets").select(F.col("edit_type").alias("known_type"), "keep_pct")  # fixed, 11 rows
    known = known_edit_type(spark, sf, pool, "edit_type").drop("edit_type", "scored_at").join(F.broadcast(shares), "known_type").withColumnRenamed("known_type", "edit_type")
    return share_cutoffs(known, ["source_id", "edit_type"], "total_score", "keep_pct")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return kept_rows(_cutoffs(spark, sf), ["source_id", "edit_type"], "pool_id").select("pool_id")


def p4_cutoffs(spark: SparkSession, sf: str) -> DataFrame:
    return cutoff_report(_cutoffs(spark, sf), ["source_id", "edit_type"], "pool_id")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    log = _read(spark, sf, "candidate_log").where("trim(group_id) != ''")
    slim = log.select("group_id", "candidate_index", "logged_at", "record_key", F.coalesce("evaluator.total_score", "solver.total_score").alias("score"))
    valid = latest_by(slim, ["group_id", "candidate_index"], "logged_at").where(is_finite(F.col("score")))
    worst = (-ordered_bits(F.col("score"))).alias("worst")
    scored = valid.select("group_id", "candidate_index", base_key(F.col("record_key")).alias("base"), worst)
    places = F.explode(F.array(F.struct(F.lit("group").alias("axis"), F.col("group_id").alias("axis_key")), F.struct(F.lit("record").alias("axis"), F.col("base").alias("axis_key"))))
    items = scored.select("group_id", F.col("candidate_index").cast("bigint").alias("item_no"), "worst", places.alias("p")).select("p.axis", "p.axis_key", "worst", "group_id", "item_no").where("axis_key is not null")
    rounds = _read(spark, sf, "round_metrics").where(F.col("current_group_id").isNotNull() & is_finite(F.col("health_score")))
    live = rounds.select(F.lit("live").alias("axis"), F.col("current_group_id").alias("axis_key"), (-ordered_bits(F.col("health_score"))).alias("worst"), F.col("current_group_id").alias("group_id"), F.col("snapshot_no").alias("item_no")).distinct()
    best = top_items(items.unionByName(live), ["axis", "axis_key"], ["worst", "group_id", "item_no"], TOP)
    return best.select("axis", "axis_key", "group_id", "item_no")


def _packed(spark: SparkSession, sf: str) -> DataFrame:
    documents = _read(spark, sf, "documents").select("doc_id", token_count(F.col("text")).alias("n_tokens"))
    limits = _read(spark, sf, "size_limits").where("used_for = 'pack'")
    return pack(documents, limits, "doc_id", "n_tokens")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    containers = _packed(spark, sf).groupBy("limit_name", "doc_id").agg(F.count_distinct("container").alias("containers"))
    return containers.where("containers > 1").select("limit_name", "doc_id")


def p6_containers(spark: SparkSession, sf: str) -> DataFrame:
    return _packed(spark, sf)


def _sourced(spark: SparkSession, sf: str) -> DataFrame:
    source = F.regexp_replace(trimmed_lower(F.col("source")), "-", "_")
    return _read(spark, sf, "documents").select("doc_id", "text", "snapshot", source.alias("source"))


def _mixed(spark: SparkSession, sf: str) -> Mix:
    return mix_sources(_sourced(spark, sf), _read(spark, sf, "mix_targets"), "snapshot", "doc_id", "text", "source")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf).shares.where("is_short").select("mix", "snapshot", "source")


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf).shares


def p7_repeats(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf).repeats


def p7_targets(spark: SparkSession, sf: str) -> DataFrame:
    """What each source has and should supply, as the operator counts it."""
    return _mixed(spark, sf).shares.select("mix", "snapshot", "source", "weight_pct", "max_repeat", "total_tokens", "source_tokens", F.round("target_tokens", 3).alias("target_tokens"), "is_short")


def p7_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """How well the classifier of the mix does on labelled documents that it was not fitted on."""
    domains = sorted(r[0] for r in whole_list(_read(spark, sf, "mix_targets").select("source").distinct(), "sources of mixes"))
    return domain_model(_sourced(spark, sf), domains, "doc_id", "text", "source").quality()


def _pieces(spark: SparkSession, sf: str, include_small: bool) -> DataFrame:
    """The pieces for every cut limit."""
    limits = whole_list(_read(spark, sf, "size_limits").where("used_for = 'cut'").orderBy("limit_name"), "cut limits")
    documents = _read(spark, sf, "documents").select("doc_id", "text")
    return reduce(DataFrame.unionByName, [cut(documents, "doc_id", "text", r.capacity, r.overlap, include_small) for r in limits])


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    pieces = keep(_pieces(spark, sf, False).select("doc_id", "oversized_blocks"), "oversized-blocks")  # read twice below
    blocks = pieces.df.select("doc_id", F.explode_outer("oversized_blocks").alias("block_no"))
    by_document = blocks.groupBy("doc_id").agg(F.count("block_no").alias("n"))
    none = by_document.where("n = 0").select("doc_id", F.lit(-1).alias("block_no"))
    return blocks.where("block_no is not null").unionByName(none)


def p8_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return _pieces(spark, sf, True)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (p1_found, p1_report, p1_sample, p2_found, p2_splits, p2_components, p4_found, p4_cutoffs, p5_found, p6_found, p6_containers, p7_found, p7_shares, p7_repeats, p7_targets, p7_classifier, p8_found, p8_pieces)
}
