"""Readers of record logs, manifests, score tables and reports."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.exprs import finite

IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "webp", "bmp")


def read_records(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Records by suffix: .jsonl, .csv (all text), or .json holding a list, {"records": [...]} or a map of records."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "jsonl":
        return spark.read.schema(schema).json(path)
    if suffix == "csv":
        return spark.read.option("header", True).csv(path)
    if suffix != "json":
        raise ValueError(f"records can't be read from .{suffix}")
    whole = spark.read.text(path, wholetext=True)
    ddl = schema.simpleString()
    listed = F.from_json("value", f"array<{ddl}>")
    held = F.from_json("value", f"struct<records:array<{ddl}>>")["records"]
    keyed = F.map_values(F.from_json("value", f"map<string,{ddl}>"))
    kind = F.schema_of_variant(F.try_parse_json("value"))
    rows = F.when(kind.startswith("ARRAY"), listed).when(held.isNotNull(), held).otherwise(keyed)
    return whole.select(F.explode(rows).alias("r")).select("r.*")


def read_log(spark: SparkSession, paths: str | Sequence[str], schema: str | T.StructType, torn_tail: bool = True) -> DataFrame:
    """JSON lines; a broken last line of a file is left out, any other raises.

    With ``torn_tail`` False a broken last line raises too.  Blank lines are
    skipped.  ``source_file`` tells where a row comes from.  Files are split
    as usual; where a line stands follows from its split and its place there.
    """
    lines = spark.read.text(list(paths) if not isinstance(paths, str) else paths).select(
        "value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("__split"), F.monotonically_increasing_id().alias("__line")
    )
    lines = lines.where("trim(value) != ''").withColumn("__ok", F.try_parse_json("value").isNotNull())
    place = F.struct("__split", "__line")
    broken = lines.where("not __ok").select("source_file", place.alias("__at"), "value")
    last = lines.groupBy("source_file").agg(F.max(place).alias("__last"))  # a row per file
    harmful = broken.join(last, "source_file").where(F.col("__at") != F.col("__last") if torn_tail else F.lit(True))
    bad = harmful.select("source_file", F.col("__at.__line").alias("line")).limit(1).collect()
    if bad:
        raise ValueError(f"broken line in {bad[0].source_file}")
    return lines.where("__ok").select(F.from_json("value", schema).alias("r"), "source_file").select("r.*", "source_file")


def read_strict(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines; any broken line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def last_rows(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per key, the last in order."""
    best = F.max_by(F.struct(*rows.columns), F.struct(*order))
    return rows.groupBy(F.col(key).alias("__k")).agg(best.alias("r")).select("r.*")


def read_images(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(key, path, length) of a folder's pictures in path order; the key is the relative path with slashes doubled to underscores."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(IMAGE_SUFFIXES) + "}").load(path)
    root = re.sub(r"^file:", "", path).rstrip("/")
    relative = F.regexp_replace(F.regexp_replace("path", "^file:", ""), f"^{re.escape(root)}/", "")
    rows = found.select(F.regexp_replace(relative, "/", "__").alias("key"), "path", "length")
    return rows.orderBy("path").limit(limit) if limit else rows


def matching_paths(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that a pattern matches in whatever store it names, sorted."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    names = sorted(str(f.getPath().toString()) for f in found) if found is not None else []
    return names if ":" in pattern.split("/")[0] else [re.sub(r"^file:(//)?", "", n) for n in names]


def expand_paths(spark: SparkSession, patterns: Sequence[str]) -> list[str]:
    """Matches of each pattern, or the pattern itself; distinct and sorted, so that no file is read twice."""
    return sorted({m for p in patterns for m in (matching_paths(spark, p) or [p])})


def read_source(spark: SparkSession, source: str, path: str, schema: str, limit: int | None = None) -> DataFrame:
    """Records of a ``directory`` of pictures or of a ``jsonl`` file, at most ``limit``; any other source raises."""
    if source == "directory":
        return read_images(spark, path, limit).select("key", "path")
    if source != "jsonl":
        raise ValueError(f"unknown source: {source}")
    rows = read_records(spark, path, schema)
    return rows.limit(limit) if limit else rows


def read_listed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A manifest that must be a JSON list."""
    kinds = spark.read.text(path, wholetext=True).select(F.schema_of_variant(F.try_parse_json("value")).alias("kind")).limit(1).collect()
    if not kinds or not (kinds[0].kind or "").startswith("ARRAY"):
        raise ValueError(f"{path} isn't a list")
    return read_records(spark, path, schema)


def resumed(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is still to be fetched: rows whose key isn't among those done."""
    return wanted.join(done.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """All rows in a seeded random order that doesn't depend on the partitioning."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key))


def round_of(path: Column) -> Column:
    """The number of the round folder in a path; 0 without one."""
    return F.coalesce(F.regexp_extract(path, r"round_(\d+)", 1).try_cast("int"), F.lit(0))


def read_rounds(spark: SparkSession, run: str, schema: str, rounds: Sequence[int] | None = None) -> DataFrame:
    """The logs of a run's round folders with ``_round``; only the listed rounds are opened."""
    paths = [p for p in matching_paths(spark, f"{run}/round_*") if rounds is None or int(re.search(r"round_(\d+)", p).group(1)) in rounds]
    if not paths:
        return spark.createDataFrame([], T.StructType.fromDDL(schema).add("_round", T.IntegerType()))
    rows = spark.read.schema(schema).option("pathGlobFilter", "*.json*").json(paths)
    return rows.withColumn("_round", round_of(F.col("_metadata.file_path")))


def round_of_parts(spark: SparkSession, run: str, parts: dict[str, str]) -> DataFrame:
    """Several one-row documents per round, joined on the round: file name to schema."""
    out = None
    for name, schema in parts.items():
        part = spark.read.schema(schema).option("multiLine", True).json(f"{run}/round_*/{name}").withColumn("_round", round_of(F.col("_metadata.file_path")))
        out = part if out is None else out.join(part, "_round", "full")
    return out


def parse_spec(text: str, presets: dict[str, dict]) -> dict:
    """A dataset name: a preset, or repo, repo:split, repo:config:split."""
    if text in presets:
        return dict(presets[text])
    parts = text.split(":")
    if len(parts) > 3 or not all(parts):
        raise ValueError(f"bad dataset name: {text}")
    repo, *rest = parts
    return {"repo": repo, "config": rest[0] if len(rest) == 2 else None, "split": rest[-1] if rest else "train"}


def open_first(readers: Sequence) -> DataFrame:
    """The first reader that opens; the last error if none does."""
    error: Exception = ValueError("nothing to open")
    for make in readers:
        try:
            frame = make()
            _ = frame.schema
            return frame
        except Exception as e:  # the next one may work
            error = e
    raise error


def schema_rows(rows: DataFrame) -> list[tuple[str, str]]:
    return rows.dtypes


def per_type_quota(rows: DataFrame, kind: str, order: Sequence[Column], quota: int, total: int) -> DataFrame:
    """At most ``quota`` rows a type and ``total`` in all; each input partition is cut before the shuffle."""
    from millrace.operators.selection import capped

    return capped(rows, [kind], order, quota).orderBy("place", kind).limit(total).drop("place")


def unless_all(column: str, value: str) -> Column:
    """Equality that ``all`` turns off; the optimiser drops it then."""
    return F.lit(True) if value == "all" else F.col(column) == value


def require_rows(rows: DataFrame, what: str) -> DataFrame:
    if rows.isEmpty():
        raise ValueError(f"no {what}")
    return rows


def parse_yaml(text: str, path: str) -> dict:
    """Settings from text; they must be a mapping, and remember their path."""
    import yaml

    value = yaml.safe_load(text)
    if not isinstance(value, dict):
        raise ValueError(f"{path} isn't a mapping")
    return value | {"_path": path}


def load_yaml(path: str) -> dict:
    """A configuration file; it must be a mapping."""
    with open(path) as f:
        return parse_yaml(f.read(), path)


def read_score_table(spark: SparkSession, path: str, first: str, second: str) -> DataFrame:
    """A CSV of scores: rows with both numbers, and ``overall``, their geometric mean."""
    raw = spark.read.option("header", True).csv(path)
    a, b = finite(F.col(first).try_cast("double")), finite(F.col(second).try_cast("double"))
    return raw.withColumn(first, a).withColumn(second, b).where(F.col(first).isNotNull() & F.col(second).isNotNull()).withColumn("overall", F.sqrt(F.col(first) * F.col(second)))


def read_sections(spark: SparkSession, path: str, header: str, entry: str) -> DataFrame:
    """(section, name, value) of text reports: lines matching ``header`` name the section of the entries after them.

    ``header`` has one group, ``entry`` two.  Reports are read whole, one row a
    file, so that line order is certain; a report is a page or two.
    """
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))
    from pyspark.sql import Window

    named = lines.withColumn("h", F.nullif(F.regexp_extract("line", header, 1), F.lit("")))
    w = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = named.withColumn("section", F.last("h", True).over(w))
    return placed.where(F.col("h").isNull() & (F.regexp_extract("line", entry, 1) != "")).select("file", "section", F.regexp_extract("line", entry, 1).alias("name"), F.regexp_extract("line", entry, 2).try_cast("double").alias("value"))


def latest_file(spark: SparkSession, pattern: str) -> str | None:
    """The file changed last, without opening any."""
    found = spark.read.format("binaryFile").load(pattern).select("path", "modificationTime")
    return found.agg(F.max_by("path", F.struct("modificationTime", "path"))).first()[0]


def model_row(table: DataFrame, column: str, name: str) -> DataFrame:
    """The model's row; the only row if there is one; else an error."""
    own = table.where(F.col(column) == name).limit(1)
    if not own.isEmpty():
        return own
    few = table.limit(2).count()
    if few == 1:
        return table
    raise ValueError(f"no row for {name}")


def new_files(spark: SparkSession, before: set[str], pattern: str) -> list[str]:
    """Files that weren't there in an earlier listing."""
    return sorted(set(matching_paths(spark, pattern)) - before)
