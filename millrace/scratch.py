"""Intermediate tables in the folder that all executors share.

A written table cuts lineage, survives the loss of executors and is read back
column by column, so it is preferred here to ``DataFrame.checkpoint``.  The
folder is ``spark.checkpoint.dir`` of the session; only a local session that
has none gets one of its own.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_local_folder: str | None = None
_live: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The shared folder; raises on a cluster that names none."""
    global _own_local_folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_local_folder is None:
        _own_local_folder = tempfile.mkdtemp(prefix="millrace-")
    return _own_local_folder


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target))


def children(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, sorted; none if there is no such folder."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(str(f.getPath().getName()) for f in files.listStatus(target)) if files.exists(target) else []


def touch(spark: SparkSession, path: str) -> None:
    """An empty file, put there in one step."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True).close()


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _live.append((spark, path))
    return path


class Kept:
    """A written intermediate: ``df`` reads it, ``drop`` deletes it."""

    def __init__(self, df: DataFrame, label: str):
        self.spark = df.sparkSession
        self.path = new_path(self.spark, label)
        schema = df.schema
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(schema).parquet(self.path)

    def count(self) -> int:
        return self.df.count()

    def drop(self) -> None:
        _delete(self.spark, self.path)
        if (self.spark, self.path) in _live:
            _live.remove((self.spark, self.path))


def keep(df: DataFrame, label: str) -> Kept:
    return Kept(df, label)


@atexit.register
def _drop_all() -> None:
    for spark, path in _live:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the session may have ended first
            pass
