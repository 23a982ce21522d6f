"""Further source, sink, streaming and plug-in queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.exprs import finite
from millrace.operators.plugins import Strategies, called, staged
from millrace.operators.sets import replay
from millrace.plans.base import CAND, POOL, Registry, candidates, pool, r6, read
from millrace.plans.stream import _as_files
from millrace.scratch import new_path
from millrace.sources import readers, writers
from millrace.sources.rows import RecordSet
from millrace.streaming.log import run_available, stream_of

R = Registry()
QUERIES, SQL = R.QUERIES, R.SQL
C = F.col


@R.query("src_13_remote", "select printf('set-%08d', n) as key, n as position from range(100, 350) t(n)")
def remote(spark: SparkSession, sf: str) -> DataFrame:
    """A data source of its own, with skip and limit, read in shards."""
    spark.dataSource.register(RecordSet)
    return spark.read.format("record_set").option("total", 1000).option("skip", 100).option("limit", 250).option("shards", 3).load().select("key", "position")


@R.query("src_16_fallback_split", "select split_name from split_targets")
def fallback_split(spark: SparkSession, sf: str) -> DataFrame:
    return readers.open_first([lambda: spark.read.parquet(f"{sf}/no_such_table.parquet"), lambda: read(spark, sf, "split_targets")]).select("split_name")


@R.query("src_10_globs", "select count(*) as n from split_targets")
def globs(spark: SparkSession, sf: str) -> DataFrame:
    """A path that two patterns give is read once."""
    return spark.read.parquet(*readers.expand_paths(spark, [f"{sf}/split_targets.parquet", f"{sf}/split_target?.parquet"])).agg(F.count("*").alias("n"))


@R.query("src_33_new_files", "select split_name from split_targets where split_name <> 'train'")
def new_files(spark: SparkSession, sf: str) -> DataFrame:
    """Result files that a run added: those of an earlier listing are left out, the new ones are read."""
    path = new_path(spark, "results")
    rows = read(spark, sf, "split_targets").select("split_name")
    rows.where("split_name = 'train'").write.json(path)
    before = set(readers.matching_paths(spark, f"{path}/*.json"))
    rows.where("split_name != 'train'").write.mode("append").json(path)
    return spark.read.schema("split_name string").json(readers.new_files(spark, before, f"{path}/*.json"))


@R.query("snk_12_with_replay", f"with {CAND}, d as (select distinct base from cand where accepted and base is not null order by base limit 40), p as (select base, row_number() over (order by base) - 1 as pos, count(*) over () as n from d) select 'sft' as kind, count(*) as n from cand where accepted union all select 'replay', count(*) from p, range(0, 40) g(turn) where pos + g.turn * n < 40")
def with_replay(spark: SparkSession, sf: str) -> DataFrame:
    """A training manifest and its replay rows in one sink."""
    path = new_path(spark, "sft")
    rows = candidates(spark, sf).where("accepted").select(F.lit("sft").alias("kind"), "base", "score")
    again = replay(rows, "base", 40).select(F.lit("replay").alias("kind"), "base")
    writers.write_log(rows.unionByName(again, allowMissingColumns=True), path)
    return spark.read.schema("kind string, base string, score double").json(path).groupBy("kind").agg(F.count("*").alias("n"))


@R.query("snk_17_metadata", "select 'documents' as name, count(*) as n, count(distinct doc_id) as ids from documents")
def metadata(spark: SparkSession, sf: str) -> DataFrame:
    """What a run read, as a row beside its output."""
    return read(spark, sf, "documents").agg(F.lit("documents").alias("name"), F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids"))


@R.query("str_3_restore", f"with {CAND} select round, count(*) as n from cand where round = 0 group by round")
def restore(spark: SparkSession, sf: str) -> DataFrame:
    """A finished round is read from its own partition; the others aren't opened."""
    path = new_path(spark, "rounds")
    candidates(spark, sf).where("round is not null").select("round", "group_id").write.partitionBy("round").parquet(path)
    return spark.read.schema("group_id string, round int").parquet(path).where("round = 0").groupBy("round").agg(F.count("*").alias("n"))


@R.query("str_4_watch", "select count(*) as n, max(snapshot_no) as last from round_metrics")
def watch(spark: SparkSession, sf: str) -> DataFrame:
    """A monitor that adds up each batch once; the sums are kept by batch number."""
    path = new_path(spark, "watch")

    def each(rows: DataFrame, batch: int) -> None:
        rows.agg(F.count("*").alias("n"), F.max("snapshot_no").alias("last")).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    run_available("watch", stream_of(spark, _as_files(spark, read(spark, sf, "round_metrics").select("snapshot_no")), 1), each)
    return spark.read.parquet(path).agg(F.sum("n").alias("n"), F.max("last").alias("last"))


@R.query("str_9_scored_stream", "select pool_id, scored_at, round(case when isfinite(total_score) then total_score else 0.0 end, 6) as score from pool_candidates group by all")
def scored_stream(spark: SparkSession, sf: str) -> DataFrame:
    """A stateless scorer over a stream, copies left out as they come."""
    out = new_path(spark, "scored")
    rows = read(spark, sf, "pool_candidates").select("pool_id", "scored_at", r6(F.coalesce(finite(C("total_score")), F.lit(0.0))).alias("score"))
    stream = stream_of(spark, _as_files(spark, rows), 1).dropDuplicates(["pool_id", "scored_at", "score"])
    stream.writeStream.format("parquet").trigger(availableNow=True).option("checkpointLocation", new_path(spark, "scored-state")).start(out).awaitTermination()
    return spark.read.parquet(out)


@R.query("str_12_progress", "select count(*) as n from pool_candidates")
def progress(spark: SparkSession, sf: str) -> DataFrame:
    """Rows a stream reports as read, from its own progress."""
    out = new_path(spark, "progress")
    query = stream_of(spark, _as_files(spark, read(spark, sf, "pool_candidates").select("pool_id")), 1).writeStream.format("parquet").trigger(availableNow=True).option("checkpointLocation", new_path(spark, "progress-state")).start(out)
    query.awaitTermination()
    return spark.createDataFrame([(sum(p["numInputRows"] for p in query.recentProgress),)], "n long")


EVALUATORS = Strategies("evaluator")


@EVALUATORS.add("strict", "solver")
def _strict(rows: DataFrame) -> DataFrame:
    return rows.withColumn("total", F.least("edit", "preservation", "validity"))


@EVALUATORS.add("mean")
def _mean(rows: DataFrame) -> DataFrame:
    return rows.withColumn("total", (F.coalesce("edit", F.lit(0.0)) + F.coalesce("preservation", F.lit(0.0)) + F.coalesce("validity", F.lit(0.0))) / 3)


@R.query("udf_3_evaluators", f"with {CAND} select group_id, candidate_index, least(edit, preservation, validity) as strict, round((coalesce(edit, 0.0) + coalesce(preservation, 0.0) + coalesce(validity, 0.0)) / 3, 6) as mean from cand")
def evaluators(spark: SparkSession, sf: str) -> DataFrame:
    """Two evaluators by name, one by its older name."""
    rows = EVALUATORS["solver"](candidates(spark, sf)).withColumnRenamed("total", "strict")
    return EVALUATORS["mean"](rows).select("group_id", "candidate_index", "strict", r6(C("total")).alias("mean"))


@R.query("udf_8_aggregate", f"with {POOL} select known_type, round(sqrt(avg(total_score * total_score) filter (isfinite(total_score))), 6) as rms from pool group by known_type")
def aggregate_object(spark: SparkSession, sf: str) -> DataFrame:
    """An aggregate of one's own, composed of built-in ones so that it combines before the shuffle."""
    x = finite(C("total_score"))
    return pool(spark, sf).groupBy("known_type").agg(r6(F.sqrt(F.avg(x * x))).alias("rms"))


@R.query("udf_9_hook", f"with {CAND} select group_id, candidate_index, coalesce(judge, score) as score from cand where coalesce(judge, score) >= 0.7")
def hook(spark: SparkSession, sf: str) -> DataFrame:
    """A judge stage that may be put in or left out."""
    stages = [("judge", lambda rows: rows.withColumn("score", F.coalesce("judge", "score"))), ("none", None), ("cut", lambda rows: rows.where("score >= 0.7"))]
    return staged(candidates(spark, sf), stages).select("group_id", "candidate_index", "score")


@R.query("udf_10_calls", "select doc_id, md5(coalesce(text, '')) as answer, case when text is null then 'ValueError: no text' end as error from documents where text is not null union all select doc_id, null, 'ValueError: no text' from documents where text is null")
def calls(spark: SparkSession, sf: str) -> DataFrame:
    """A stand-in for a judge service: answers, errors, and a cache of earlier answers."""
    documents = read(spark, sf, "documents").select("doc_id", "text")
    cache = documents.where("doc_id % 2 = 0 and text is not null").select("doc_id", F.md5("text").alias("answer"))

    def judge(text: str | None) -> str:
        import hashlib

        if text is None:
            raise ValueError("no text")
        return hashlib.md5(text.encode()).hexdigest()

    return called(documents, "doc_id", "text", judge, cache)
