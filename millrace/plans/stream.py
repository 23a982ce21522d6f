"""Streaming and plug-in queries (STR, UDF): the streams run over what is there and end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from millrace.functions.exprs import finite, gmean, weighted_mean
from millrace.plans.base import CAND, REC, Registry, candidates, r6, read, records
from millrace.scratch import keep, new_path
from millrace.streaming.log import LatestTable, level_controller, run_available, stream_of

R = Registry()
QUERIES, SQL = R.QUERIES, R.SQL
C = F.col


def _as_files(spark: SparkSession, rows: DataFrame, parts: int = 4) -> str:
    """A table laid out as files, as a stream's source."""
    path = new_path(spark, "stream-in")
    rows.repartition(parts).write.parquet(path)
    return path


def _log_stream(spark: SparkSession, sf: str) -> DataFrame:
    log = read(spark, sf, "candidate_log").where("trim(group_id) != ''").select("group_id", "candidate_index", "logged_at", "log_seq", "status", finite(F.coalesce("evaluator.total_score", "solver.total_score")).alias("score"))
    return stream_of(spark, _as_files(spark, log), 1)


_LATEST = "l as (select * from (select group_id, candidate_index, status, row_number() over (partition by group_id, candidate_index order by logged_at desc, log_seq desc) as r from candidate_log where trim(group_id) <> '') where r = 1)"


@R.query("str_1_upsert", f"with {_LATEST} select group_id, candidate_index, status from l")
def upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The log's last status per candidate, merged batch by batch."""
    table = LatestTable(spark, ["group_id", "candidate_index"], ["logged_at", "log_seq"])
    run_available("upsert", _log_stream(spark, sf), table)
    return table.read().select("group_id", "candidate_index", "status")


@R.query("str_2_resume", f"with {_LATEST} select group_id from l group by group_id having not bool_and(status in ('accepted', 'rejected'))")
def resume(spark: SparkSession, sf: str) -> DataFrame:
    """Groups that a restart still has to work on."""
    table = LatestTable(spark, ["group_id", "candidate_index"], ["logged_at", "log_seq"])
    run_available("resume", _log_stream(spark, sf), table)
    done = table.read().groupBy("group_id").agg(F.bool_and(C("status").isin("accepted", "rejected")).alias("done"))
    return done.where("not done").select("group_id")


@R.query("str_5_live_counts", "select status, count(*) as n from candidate_log where trim(group_id) <> '' group by status")
def live_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A running count in complete mode; the last state is the result."""
    out = new_path(spark, "live")

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(out)

    counts = _log_stream(spark, sf).groupBy("status").agg(F.count("*").alias("n"))
    counts.writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", new_path(spark, "live-state")).foreachBatch(write).start().awaitTermination()
    return spark.read.parquet(out)


@R.query("str_6_rescored", f"with {_LATEST}, s as (select group_id, candidate_index, max(case when isfinite(coalesce(evaluator.total_score, solver.total_score)) then coalesce(evaluator.total_score, solver.total_score) end) as score from candidate_log where trim(group_id) <> '' group by all) select group_id, candidate_index from s where score >= 0.6")
def rescored(spark: SparkSession, sf: str) -> DataFrame:
    """Scores gathered as they come, the threshold set over all of them at the end."""
    table = LatestTable(spark, ["group_id", "candidate_index"], ["score"])
    run_available("rescored", _log_stream(spark, sf).where("score is not null"), table)
    return table.read().where("score >= 0.6").select("group_id", "candidate_index")


@R.query("str_7_processed_keys", f"with {REC} select distinct key from source_records")
def processed_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Each key once, however often it comes; the keys seen are the stream's state."""
    out = new_path(spark, "keys")
    stream = stream_of(spark, _as_files(spark, read(spark, sf, "source_records").select("key")), 1).dropDuplicates(["key"])
    stream.writeStream.format("parquet").trigger(availableNow=True).option("checkpointLocation", new_path(spark, "keys-state")).start(out).awaitTermination()
    return spark.read.parquet(out)


@R.query(
    "str_10_levels",
    """with recursive h as (select (snapshot_no % 5)::int as run, snapshot_no, health_score as h from (select distinct snapshot_no, health_score from round_metrics where isfinite(health_score))), o as (select *, row_number() over (partition by run order by snapshot_no) as k from h),
    e as (select run, 0::bigint as k, 3 as level from (select distinct run from o) union all select o.run, o.k, least(greatest(e.level + case when o.h >= 50 then 1 when o.h < 30 then -1 else 0 end, 1), 5) from e join o on o.run = e.run and o.k = e.k + 1) select run, arg_max(level, k)::int as level, max(k)::int as seen from e group by run""",
)
def levels(spark: SparkSession, sf: str) -> DataFrame:
    """A controller whose level is the stream's own state."""
    rows = read(spark, sf, "round_metrics").select((F.pmod("snapshot_no", F.lit(5))).cast("int").alias("run"), "snapshot_no", finite(C("health_score")).alias("h")).where("h is not null").distinct()
    path = new_path(spark, "levels-in")
    rows.coalesce(1).sortWithinPartitions("snapshot_no").write.parquet(path)
    table = LatestTable(spark, ["run"], ["seen"])
    run_available_update(level_controller(stream_of(spark, path), "run", "snapshot_no", "h", 3, 30.0, 50.0, 1, 5), table)
    return table.read().select("run", "level", "seen")


def run_available_update(stream: DataFrame, each: Callable[[DataFrame, int], None]) -> None:
    stream.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", new_path(stream.sparkSession, "update-state")).foreachBatch(each).start().awaitTermination()


@R.query("str_11_cumulative", f"with {CAND} select round, count(*) filter (accepted) as accepted from cand where round is not null group by round")
def cumulative(spark: SparkSession, sf: str) -> DataFrame:
    """Accepted rows appended round by round to one table."""
    path = new_path(spark, "cumulative")
    rows = keep(candidates(spark, sf).where("round is not null").select("round", "accepted"), "rounds")
    half = rows.df.agg(F.percentile("round", F.lit(0.5))).first()[0] or 0
    for part in (rows.df.where(C("round") <= half), rows.df.where(C("round") > half)):
        part.write.mode("append").parquet(path)
    return spark.read.schema("round int, accepted boolean").parquet(path).groupBy("round").agg(F.count_if("accepted").alias("accepted"))


# plug-ins


@udtf(returnType="edit_type string, instruction string")
class Proposals:
    """A record's proposals by rule: none without a caption, else one per opportunity named."""

    def eval(self, caption: str, kinds: list):
        if caption:
            for kind in kinds or []:
                if kind:
                    yield kind, f"{kind.replace('_', ' ')}: {caption}"


@R.query("udf_1_proposers", f"with {REC}, k as (select key, caption, unnest(edit_families) as kind from rec where coalesce(caption, '') <> '') select key, kind as edit_type, replace(kind, '_', ' ') || ': ' || caption as instruction from k where coalesce(kind, '') <> ''")
def proposers(spark: SparkSession, sf: str) -> DataFrame:
    records(spark, sf).select("key", "caption", "edit_families").createOrReplaceTempView("__records")
    spark.udtf.register("rule_proposals", Proposals)
    return spark.sql("select key, p.edit_type, p.instruction from __records, lateral rule_proposals(caption, edit_families) p")


#: Scores by name: each makes an expression over a candidate's columns.
SCORES: dict[str, Callable[[], Column]] = {
    "mean": lambda: weighted_mean([(C("edit"), 0.4), (C("preservation"), 0.3), (C("validity"), 0.3)], 0.0),
    "geometric": lambda: gmean([C("edit"), C("preservation"), C("validity")]),
    "raw": lambda: F.coalesce("raw", F.lit(0.0)),
    "judge": lambda: F.coalesce("judge", "raw", F.lit(0.0)),
    "lowest": lambda: F.coalesce(F.array_min(F.array_compact(F.array("edit", "preservation", "validity"))), F.lit(0.0)),
}


def score(name: str) -> Column:
    if name not in SCORES:
        raise ValueError(f"no score named {name}; there are {', '.join(sorted(SCORES))}")
    return SCORES[name]()


@R.query("udf_6_scores", f"with {CAND} select group_id, candidate_index, coalesce(raw, 0.0) as raw_score, coalesce(judge, raw, 0.0) as judge_score, coalesce(list_min(list_filter([edit, preservation, validity], lambda x: x is not null)), 0.0) as lowest from cand")
def scored(spark: SparkSession, sf: str) -> DataFrame:
    return candidates(spark, sf).select("group_id", "candidate_index", score("raw").alias("raw_score"), score("judge").alias("judge_score"), score("lowest").alias("lowest"))


@R.query("udf_7_group_scorer", f"with {CAND} select group_id, candidate_index, round(raw - avg(raw) over (partition by group_id), 6) as centred from cand where trim(group_id) <> '' and raw is not null")
def group_scorer(spark: SparkSession, sf: str) -> DataFrame:
    """A scorer that sees a whole group, as an aggregation and a join: no group is gathered."""
    rows = candidates(spark, sf).where("trim(group_id) != '' and raw is not null").select("group_id", "candidate_index", "raw")
    return rows.join(rows.groupBy("group_id").agg(F.avg("raw").alias("m")), "group_id").select("group_id", "candidate_index", r6(C("raw") - C("m")).alias("centred"))


@R.query("udf_11_distractors", "select log_seq, d.operation_id as operation_id, count(*) > 0 as given from (select log_seq, unnest(distractors) as d from candidate_log) group by all")
def distractor_bank(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "candidate_log").select("log_seq", F.explode("distractors").alias("d"))
    return rows.select("log_seq", C("d.operation_id").alias("operation_id")).groupBy("log_seq", "operation_id").agg((F.count("*") > 0).alias("given"))


@R.query("udf_12_fallbacks", f"with {REC} select key, coalesce(nullif(trim(caption), ''), case when len(edit_families) > 0 then 'edit ' || edit_families[1] end, 'edit ' || key) as proposal from rec")
def fallbacks(spark: SparkSession, sf: str) -> DataFrame:
    """Stages of a proposer; the first that gives something counts."""
    from millrace.functions.exprs import filled

    return records(spark, sf).select("key", F.coalesce(filled(C("caption")), F.when(F.size("edit_families") > 0, F.concat(F.lit("edit "), F.get("edit_families", F.lit(0)))), F.concat(F.lit("edit "), "key")).alias("proposal"))
