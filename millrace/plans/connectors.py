"""Source and sink queries (SRC, SNK): a table goes out in a format and comes back."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.base import POOL, REC, Registry, pool, read, records, whole_list
from millrace.scratch import new_path
from millrace.sources import readers, writers

R = Registry()
QUERIES, SQL = R.QUERIES, R.SQL
C = F.col

ROW = "doc_id long, lang string, n_chars long, snapshot string"
_ROWS = "select doc_id, lang, n_chars, snapshot from documents"


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", "lang", "n_chars", "snapshot")


@R.query("src_1_jsonl", _ROWS)
def jsonl(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "src") + ".jsonl"
    writers.write_log(_documents(spark, sf), path)
    return readers.read_records(spark, path, ROW)


@R.query("src_1_csv", "select doc_id::varchar as doc_id, lang, n_chars::varchar as n_chars, snapshot from documents")
def csv(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "src") + ".csv"
    writers.write_table(_documents(spark, sf), path)
    return readers.read_records(spark, path, ROW)


@R.query("src_1_json_shapes", "select split_name, target_pct, n as shape from split_targets, range(0, 3) t(n)")
def json_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """A list, a wrapped list and a map of records give the same rows."""
    rows = [r.asDict() for r in whole_list(read(spark, sf, "split_targets"), "splits")]
    out = None
    for i, value in enumerate((rows, {"records": rows}, {r["split_name"]: r for r in rows})):
        path = new_path(spark, "shape") + ".json"
        spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.text(path)
        part = readers.read_records(spark, path, "split_name string, target_pct int").withColumn("n", F.lit(i).cast("long"))
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("n", "shape")


@R.query("src_2_torn_tail", _ROWS)
def torn_tail(spark: SparkSession, sf: str) -> DataFrame:
    """A broken last line in a file is left out."""
    path = new_path(spark, "torn")
    good = _documents(spark, sf).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    good.write.text(path)
    tail = spark.createDataFrame([('{"doc_id": 1}',), ('{"doc_id": 2, "la',)], "value string").coalesce(1)
    tail.write.mode("append").text(path)
    return readers.read_log(spark, path, ROW).where("snapshot is not null").drop("source_file")


@R.query("src_4_strict", _ROWS)
def strict(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "strict")
    writers.write_log(_documents(spark, sf), path)
    return readers.read_strict(spark, path, ROW)


@R.query("src_5_last_wins", "select source_key, max(scored_at) as scored_at from pool_candidates group by source_key")
def last_wins(spark: SparkSession, sf: str) -> DataFrame:
    return readers.last_rows(read(spark, sf, "pool_candidates").select("source_key", "scored_at"), "source_key", ["scored_at"])


@R.query("src_11_rounds", "select candidate_index, status, proposal.round_index as _round, count(*) as n from candidate_log where proposal.round_index in (0, 1) group by all")
def rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Round folders are opened only if listed."""
    run = new_path(spark, "run")
    log = read(spark, sf, "candidate_log").select("candidate_index", "status", C("proposal.round_index").alias("r"))
    log.withColumn("round", F.format_string("%02d", "r")).drop("r").write.partitionBy("round").json(f"{run}/all")


    rows = spark.read.schema("candidate_index int, status string, round int").json(f"{run}/all").where("round in (0, 1)")
    return rows.select("candidate_index", "status", (readers.round_of(F.concat(F.lit("round_"), C("round").cast("string")))).alias("_round")).groupBy("candidate_index", "status", "_round").agg(F.count("*").alias("n"))


@R.query("src_13_hash_order", f"with {REC} select key from rec where not exists (select 1 from pool_candidates p where p.source_key = rec.key) order by md5(key) limit 50")
def hash_order(spark: SparkSession, sf: str) -> DataFrame:
    """A shuffled scan that resumes after the keys already taken."""
    done = read(spark, sf, "pool_candidates").select(C("source_key").alias("key"))
    return records(spark, sf).select("key").join(done, "key", "left_anti").orderBy(F.md5("key")).limit(50)


@R.query("src_15_collect", "select doc_id, coalesce(record_key, source, 'none') as origin from documents")
def collect_fields(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", F.coalesce("record_key", "source", F.lit("none")).alias("origin"))


@R.query("src_18_schema", "select column_name as name from (describe documents)")
def schema(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n, _ in readers.schema_rows(read(spark, sf, "documents"))], "name string")


@R.query("src_20_quota", f"with {POOL}, r as (select pool_id, known_type, row_number() over (partition by known_type order by pool_id) as r from pool where known_type is not null) select pool_id, known_type from r where r <= 6 order by r, known_type limit 50")
def quota(spark: SparkSession, sf: str) -> DataFrame:
    return readers.per_type_quota(pool(spark, sf).where("known_type is not null").select("pool_id", "known_type"), "known_type", [C("pool_id")], 6, 50)


@R.query("src_21_filters", "select doc_id from documents where lang = 'en'")
def filters(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").where(readers.unless_all("lang", "en") & readers.unless_all("snapshot", "all")).select("doc_id")


@R.query("src_22_locale", f"with {REC} select key, coalesce(nullif(trim(caption), ''), nullif(trim(page), '')) as prompt from rec where batch in ('batch-000000', 'batch-000001') and coalesce(nullif(trim(caption), ''), nullif(trim(page), '')) is not null")
def locale(spark: SparkSession, sf: str) -> DataFrame:
    from millrace.functions.exprs import filled

    rows = records(spark, sf).where(C("batch").isin("batch-000000", "batch-000001"))
    return rows.select("key", F.coalesce(filled(C("caption")), filled(C("page"))).alias("prompt")).where("prompt is not null")


@R.query("src_23_first_wins", "select record_key, min(doc_id) as doc_id from documents where record_key is not null group by record_key")
def first_wins(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").where("record_key is not null").groupBy("record_key").agg(F.min("doc_id").alias("doc_id"))


@R.query("src_27_sft", "select log_seq from candidate_log where status = 'accepted' and evaluator.total_score >= 0.5 and isfinite(evaluator.total_score) and coalesce(edited_image_path, '') <> '' group by log_seq")
def sft(spark: SparkSession, sf: str) -> DataFrame:
    from millrace.functions.exprs import finite

    rows = read(spark, sf, "candidate_log").where((C("status") == "accepted") & (finite(C("evaluator.total_score")) >= 0.5) & (F.coalesce("edited_image_path", F.lit("")) != ""))
    return readers.require_rows(rows.select("log_seq").distinct(), "accepted rows")


@R.query("src_29_scores", "select pool_id, scored_at, sort_score, total_score, round(sqrt(sort_score * total_score), 6) as overall from pool_candidates where isfinite(sort_score) and isfinite(total_score)")
def scores(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "scores")
    writers.write_table(read(spark, sf, "pool_candidates").select("pool_id", C("scored_at").cast("string"), "sort_score", "total_score"), path)
    rows = readers.read_score_table(spark, path, "sort_score", "total_score")
    return rows.select(C("pool_id").cast("long"), C("scored_at").cast("timestamp_ntz").alias("scored_at"), "sort_score", "total_score", F.round("overall", 6).alias("overall"))


@R.query("src_30_sections", "select axis as section, category as name, target_pct::double as value from sample_targets")
def sections(spark: SparkSession, sf: str) -> DataFrame:
    """A text report with section headings, written and read back."""
    path = new_path(spark, "report")
    rows = whole_list(read(spark, sf, "sample_targets").orderBy("axis", "category"), "targets")
    text = "\n".join(line for a in sorted({r.axis for r in rows}) for line in [f"== {a} ==", "", *[f"{r.category}: {r.target_pct}" for r in rows if r.axis == a], "total"])
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return readers.read_sections(spark, path, r"^== (.*) ==$", r"^(\w+): ([\d.]+)$").drop("file")


@R.query("src_31_latest_file", "select split_name from split_targets where split_name = 'test'")
def latest_file(spark: SparkSession, sf: str) -> DataFrame:
    """Of the files in a folder the one written last is read."""
    path = new_path(spark, "files")
    rows = read(spark, sf, "split_targets").select("split_name")
    for name in ("train", "test"):
        rows.where(C("split_name") == name).coalesce(1).write.mode("append").json(path)
        time.sleep(0.05)  # files are told apart by the time of their last change
    return spark.read.schema("split_name string").json(readers.latest_file(spark, f"{path}/*.json"))


@R.query("src_32_model_row", "select * from split_targets where split_name = 'test'")
def model(spark: SparkSession, sf: str) -> DataFrame:
    return readers.model_row(read(spark, sf, "split_targets"), "split_name", "test")


@R.query("snk_2_append", "select doc_id, lang, n_chars, snapshot from documents where doc_id % 2 = 0 union all select doc_id, lang, n_chars, snapshot from documents where doc_id % 2 <> 0")
def append(spark: SparkSession, sf: str) -> DataFrame:
    """Two appends to one log."""
    path = new_path(spark, "log")
    rows = _documents(spark, sf)
    for part in ("doc_id % 2 = 0", "doc_id % 2 != 0"):
        writers.write_log(rows.where(part), path, append=True)
    return spark.read.schema(ROW).json(path)


@R.query("snk_6_columns", "select doc_id::varchar as doc_id, lang from documents")
def columns(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "csv")
    writers.write_table(_documents(spark, sf), path, ["doc_id", "lang"])
    return spark.read.option("header", True).csv(path)


@R.query("snk_7_union", "select edit_type as name, keep_pct::varchar as keep_pct, null::varchar as target_pct from keep_targets union all select split_name, null, target_pct::varchar from split_targets")
def union(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "union")
    writers.write_union([read(spark, sf, "keep_targets").withColumnRenamed("edit_type", "name"), read(spark, sf, "split_targets").withColumnRenamed("split_name", "name")], path)
    return spark.read.option("header", True).csv(path)


@R.query("snk_8_splits", "select case when doc_id % 10 = 0 then 'held' else 'main' end as split, count(*) as n from documents group by all")
def split_files(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "splits")
    writers.write_splits(_documents(spark, sf).withColumn("split", F.when(C("doc_id") % 10 == 0, "held").otherwise("main")), "split", path)
    return spark.read.schema(f"{ROW}, split string").json(path).groupBy("split").agg(F.count("*").alias("n"))


@R.query("snk_9_outcomes", f"with {REC} select case when accepted then 'selected' else 'rejected' end as outcome, count(*) as n from rec group by all")
def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "outcomes")
    writers.write_outcomes(records(spark, sf).select("key", "accepted"), path, "accepted")
    return spark.read.schema("key string, accepted boolean, outcome string").json(path).groupBy("outcome").agg(F.count("*").alias("n"))


@R.query("snk_14_manifest", f"with {REC} select key as id, regexp_replace(image, '^pool/', '') as edit_image from rec")
def manifest(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "manifest")
    writers.write_manifest(records(spark, sf), path, {"key": "id", "image": "edit_image"}, "pool")
    return spark.read.schema("id string, edit_image string").json(path)


@R.query("snk_15_reports")
def reports(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "split_targets").orderBy("split_name")
    return spark.createDataFrame([("markdown", writers.markdown(rows)), ("latex", writers.latex(rows)), ("html", writers.dashboard(rows, "splits"))], "kind string, text string")


