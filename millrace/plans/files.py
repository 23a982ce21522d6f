"""Queries over files of other shapes (SRC, SNK): caches, side-cars, round folders, manifests, documents."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.base import REC, Registry, read, records, whole_list
from millrace.scratch import new_path
from millrace.sources import provenance, readers, writers

R = Registry()
QUERIES, SQL = R.QUERIES, R.SQL
C = F.col
TARGETS = "split_name string, target_pct int"
_TARGETS = "select split_name, target_pct from split_targets"


def _lines(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


@R.query("src_3_monitor", "select snapshot_no, round_index, status from round_metrics")
def monitor(spark: SparkSession, sf: str) -> DataFrame:
    """A log that is still written to: the torn last line of the live file is left for the next look."""
    path = new_path(spark, "live")
    _lines(read(spark, sf, "round_metrics").select("snapshot_no", "round_index", "status"), path)
    spark.createDataFrame([('{"snapshot_no": 1, "stat',)], "value string").coalesce(1).write.mode("append").text(path)
    return readers.read_log(spark, path, "snapshot_no long, round_index int, status string").drop("source_file")


@R.query("src_6_decision_cache", "select pool_id as decision_id, max(scored_at) as at from pool_candidates group by pool_id")
def decision_cache(spark: SparkSession, sf: str) -> DataFrame:
    """A cache of decisions in JSON lines; the last row of an id wins."""
    path = new_path(spark, "cache")
    writers.write_log(read(spark, sf, "pool_candidates").select(C("pool_id").alias("decision_id"), C("scored_at").alias("at")), path)
    rows = readers.read_log(spark, path, "decision_id long, at timestamp_ntz").drop("source_file")
    return readers.last_rows(rows, "decision_id", ["at"])


@R.query("src_7_sidecar", f"with {REC} select doc_id, d.record_key, r.caption from documents d left join rec r on r.key = d.record_key")
def sidecar(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata by key beside the data: the last row of a key, joined on."""
    path = new_path(spark, "sidecar")
    writers.write_log(read(spark, sf, "source_records").select("key", "caption", "ingested_at"), path)
    rows = readers.read_strict(spark, path, "key string, caption string, ingested_at timestamp_ntz")
    known = readers.last_rows(rows, "key", ["ingested_at"]).select(C("key").alias("record_key"), "caption")
    return read(spark, sf, "documents").select("doc_id", "record_key").join(known, "record_key", "left")


def _pictures(spark: SparkSession, sf: str) -> str:
    """A folder of small picture files, one per nation in its region's folder."""
    path = new_path(spark, "pictures")
    for r in whole_list(read(spark, sf, "nation").select("n_regionkey", "n_nationkey"), "nations"):
        provenance.put_text(spark, f"{path}/{r.n_regionkey}/{r.n_nationkey}.{'png' if r.n_nationkey % 2 else 'jpg'}", "x")
    provenance.put_text(spark, f"{path}/notes.txt", "x")
    return path


@R.query("src_8_directory", "select n_regionkey || '__' || n_nationkey || case when n_nationkey % 2 = 1 then '.png' else '.jpg' end as key from nation")
def directory(spark: SparkSession, sf: str) -> DataFrame:
    return readers.read_source(spark, "directory", _pictures(spark, sf), "").select("key")


@R.query("src_8_jsonl", "select key, caption from source_records")
def directory_or_lines(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "records") + ".jsonl"
    writers.write_log(read(spark, sf, "source_records").select("key", "caption"), path)
    return readers.read_source(spark, "jsonl", path, "key string, caption string")


@R.query("src_9_limited", "select n_regionkey || '__' || n_nationkey || case when n_nationkey % 2 = 1 then '.png' else '.jpg' end as key from nation order by n_regionkey::varchar || '/' || n_nationkey || case when n_nationkey % 2 = 1 then '.png' else '.jpg' end limit 7")
def limited(spark: SparkSession, sf: str) -> DataFrame:
    """The first pictures in path order."""
    return readers.read_source(spark, "directory", _pictures(spark, sf), "", 7).select("key")


@R.query("src_12_rounds", "select round_index as _round, count(*) as snapshots, max(candidates_total) as candidates, max(case when status = 'complete' then 1 else 0 end) as finished from round_metrics where round_index is not null group by round_index")
def round_folders(spark: SparkSession, sf: str) -> DataFrame:
    """Two documents in the folder of each round, joined on the round that the path names."""
    run = new_path(spark, "run")
    rows = read(spark, sf, "round_metrics").where("round_index is not null").groupBy("round_index").agg(F.count("*").alias("snapshots"), F.max("candidates_total").alias("candidates"), F.max((C("status") == "complete").cast("int")).alias("finished"))
    for r in whole_list(rows.withColumn("finished", F.coalesce("finished", F.lit(0))), "rounds"):
        provenance.put_text(spark, f"{run}/round_{r.round_index:03d}/summary.json", json.dumps({"snapshots": r.snapshots, "candidates": r.candidates}))
        provenance.put_text(spark, f"{run}/round_{r.round_index:03d}/progress.json", json.dumps({"finished": r.finished}, indent=1))
    return readers.round_of_parts(spark, run, {"summary.json": "snapshots long, candidates int", "progress.json": "finished int"})


@R.query("src_14_shuffled", "select doc_id, source from documents")
def shuffled(spark: SparkSession, sf: str) -> DataFrame:
    """A full shuffle of a data set by a seeded order."""
    return readers.shuffled(read(spark, sf, "documents").select("doc_id", "source"), "doc_id", 7)


@R.query("src_17_specs", "select * from (values ('preset', 'known', null, 'validation'), ('repo', 'a/b', null, 'train'), ('repo:split', 'a/b', null, 'test'), ('repo:config:split', 'a/b', 'c', 'test')) t(spec, repo, config, split)")
def specs(spark: SparkSession, sf: str) -> DataFrame:
    """The four ways to name a data set."""
    presets = {"small": {"repo": "known", "config": None, "split": "validation"}}
    parsed = [(kind, readers.parse_spec(text, presets)) for kind, text in (("preset", "small"), ("repo", "a/b"), ("repo:split", "a/b:test"), ("repo:config:split", "a/b:c:test"))]
    return spark.createDataFrame([(k, p["repo"], p["config"], p["split"]) for k, p in parsed], "spec string, repo string, config string, split string")


@R.query("src_19_pairs", f"with {REC} select r.key, r.image, p.pool_id from rec r join pool_candidates p on p.source_key = r.key")
def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Edit pairs of a written data set: a source picture and what was made of it."""
    path = new_path(spark, "pairs")
    made = read(spark, sf, "pool_candidates").select(C("source_key").alias("key"), "pool_id")
    records(spark, sf).select("key", "image").join(made, "key").write.parquet(path)
    return spark.read.parquet(path)


@R.query("src_24_benchmark", "select doc_id, lang from documents")
def benchmark(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "benchmark") + ".jsonl"
    writers.write_log(read(spark, sf, "documents").select("doc_id", "lang"), path)
    return readers.read_records(spark, path, "doc_id long, lang string")


def _manifest(spark: SparkSession, sf: str, suffix: str) -> str:
    path = new_path(spark, "manifest") + suffix
    rows = [r.asDict() for r in whole_list(read(spark, sf, "split_targets").select("split_name", "target_pct"), "splits")]
    provenance.put_text(spark, path, json.dumps(rows) if suffix == ".json" else "\n".join(map(json.dumps, rows)))
    return path


@R.query("src_25_list", _TARGETS)
def must_be_list(spark: SparkSession, sf: str) -> DataFrame:
    return readers.read_listed(spark, _manifest(spark, sf, ".json"), TARGETS)


@R.query("src_26_manifest", f"{_TARGETS} union all {_TARGETS}")
def training_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """The same manifest as a list and as lines."""
    return readers.read_records(spark, _manifest(spark, sf, ".json"), TARGETS).unionByName(readers.read_records(spark, _manifest(spark, sf, ".jsonl"), TARGETS))


@R.query("src_28_config", _TARGETS)
def config(spark: SparkSession, sf: str) -> DataFrame:
    """Settings as YAML (of which JSON is a part), a mapping that knows its path."""
    rows = whole_list(read(spark, sf, "split_targets").select("split_name", "target_pct"), "splits")
    path = new_path(spark, "config") + ".yaml"
    provenance.put_text(spark, path, "\n".join(["splits:", *[f"  {r.split_name}: {r.target_pct}" for r in rows]]))
    value = readers.parse_yaml(provenance.get_text(spark, path), path)
    return spark.createDataFrame(sorted(value["splits"].items()), TARGETS)


@R.query("snk_1_overwrite", "select doc_id, lang from documents where lang = 'en'")
def overwrite(spark: SparkSession, sf: str) -> DataFrame:
    """A log written twice holds what was written last."""
    path = new_path(spark, "log")
    rows = read(spark, sf, "documents").select("doc_id", "lang")
    writers.write_log(rows, path)
    writers.write_log(rows.where("lang = 'en'"), path)
    return readers.read_strict(spark, path, "doc_id long, lang string")


@R.query("snk_3_ascii", "select doc_id, text from documents")
def ascii_only(spark: SparkSession, sf: str) -> DataFrame:
    """JSON lines of ASCII only: everything else is escaped, and comes back whole."""
    path = new_path(spark, "ascii")
    writers.write_ascii_log(read(spark, sf, "documents").select("doc_id", "text"), path)
    lines = spark.read.text(path)
    return lines.select(F.from_json("value", "doc_id long, text string").alias("r"), (F.octet_length("value") == F.length("value")).alias("plain")).where("plain").select("r.*")


@R.query("snk_4_document", _TARGETS)
def document(spark: SparkSession, sf: str) -> DataFrame:
    """A JSON document in the shared store, indented and replaced as a whole."""
    path = new_path(spark, "document") + ".json"
    rows = whole_list(read(spark, sf, "split_targets").select("split_name", "target_pct"), "splits")
    for value in ([], [r.asDict() for r in rows]):
        provenance.put_text(spark, path, json.dumps(value, indent=2, sort_keys=True))
    return readers.read_records(spark, path, TARGETS)


@R.query("snk_5_atomic", "select 2 as version, count(*)::int as n from split_targets")
def atomic(spark: SparkSession, sf: str) -> DataFrame:
    """A document is there in one version or the other, and nothing is left beside it."""
    folder = new_path(spark, "atomic")
    for version in (1, 2):
        provenance.put_text(spark, f"{folder}/state.json", json.dumps({"version": version, "n": read(spark, sf, "split_targets").count()}))
    if [p.rsplit("/", 1)[-1] for p in readers.matching_paths(spark, f"{folder}/*")] != ["state.json"]:
        raise ValueError("a part was left behind")
    return spark.read.schema("version int, n int").option("multiLine", True).json(f"{folder}/state.json")


@R.query("snk_13_replay", f"""with {REC}, now as (select key, score from rec where accepted and isfinite(score)), anchors as (select key, score from rec where not accepted and isfinite(score) order by score desc, key limit 30)
  select 'preference' as kind, key, 1.0::double as weight from now union all select 'anchor', key, 0.25::double from anchors""")
def preference_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest of preference rows with anchors of earlier rounds replayed at a lower weight."""
    path = new_path(spark, "preferences")
    rows = records(spark, sf).where(F.coalesce(~F.isnan("score") & (F.abs("score") < float("inf")), F.lit(False)))
    writers.write_with_anchors(rows.where("accepted").select("key"), rows.where("not accepted").orderBy(F.desc("score"), "key").limit(30).select("key"), path, 0.25)
    return readers.read_strict(spark, path, "kind string, key string, weight double")


@R.query("snk_16_dashboard", "select count(*) as entries, true as whole from split_targets")
def dashboard(spark: SparkSession, sf: str) -> DataFrame:
    """A page and its data side by side, each replaced as a whole."""
    folder = new_path(spark, "dashboard")
    rows = read(spark, sf, "split_targets").orderBy("split_name")
    provenance.put_text(spark, f"{folder}/index.html", writers.dashboard(rows, "splits"))
    provenance.put_text(spark, f"{folder}/data.json", json.dumps(writers.collected(rows)))
    page = spark.read.text(f"{folder}/index.html", wholetext=True).select((F.size(F.regexp_extract_all("value", F.lit("<tr>"), F.lit(0))) - 1).cast("long").alias("rows"))
    return readers.read_records(spark, f"{folder}/data.json", TARGETS).agg(F.count("*").alias("entries")).crossJoin(F.broadcast(page)).select("entries", (C("rows") == C("entries")).alias("whole"))


@R.query("snk_18_sidecar", "select * from (values ('absent', 'empty'), ('bare', 'unknown'), ('other', 'different'), ('same', 'same'), ('fresh', 'unchecked')) t(name, found)")
def provenance_sidecar(spark: SparkSession, sf: str) -> DataFrame:
    """A sidecar with the settings of an output, and what a later run finds."""
    folder, settings = new_path(spark, "export"), {"table": "split_targets", "rows": read(spark, sf, "split_targets").count()}
    found = [("absent", provenance.may_resume(spark, folder, settings))]
    writers.write_log(read(spark, sf, "split_targets"), folder)
    found.append(("bare", provenance.may_resume(spark, folder, settings)))
    provenance.save_provenance(spark, folder, settings)
    found += [("other", provenance.may_resume(spark, folder, settings | {"rows": -1})), ("same", provenance.may_resume(spark, folder, settings)), ("fresh", provenance.may_resume(spark, folder, {}, fresh=True))]
    return spark.createDataFrame(found, "name string, found string")


@R.query("fil_37_guard", "select * from (values ('same', true), ('different', false), ('allowed', true)) t(name, passes)")
def guard(spark: SparkSession, sf: str) -> DataFrame:
    """Outputs of other settings are refused unless the run asks for it."""
    folder = new_path(spark, "export")
    writers.write_log(read(spark, sf, "split_targets"), folder)
    provenance.save_provenance(spark, folder, {"seed": 1})
    out = []
    for name, settings, options in (("same", {"seed": 1}, {}), ("different", {"seed": 2}, {}), ("allowed", {"seed": 2}, {"allow_mismatch": True})):
        try:
            provenance.require_same(spark, folder, settings, **options)
            out.append((name, True))
        except ValueError:
            out.append((name, False))
    return spark.createDataFrame(out, "name string, passes boolean")


@R.query("str_8_resume", f"with {REC} select key from rec where key not in (select record_key from documents where record_key is not null)")
def resume(spark: SparkSession, sf: str) -> DataFrame:
    """What a download that was stopped has still to fetch; keys already in its metadata are passed over."""
    path = new_path(spark, "metadata")
    writers.write_log(read(spark, sf, "documents").select(C("record_key").alias("key")), path)
    done = readers.read_log(spark, path, "key string")
    return readers.resumed(records(spark, sf).select("key"), done, "key")
