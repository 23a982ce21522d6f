"""What an output folder was made with, and whether a run may add to it."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from millrace.scratch import exists
from millrace.sources.readers import matching_paths

SIDECAR = "provenance.sidecar"


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, replaced as a whole: written beside its place, then renamed."""
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target, part = path_of(path), path_of(f"{path}.part")
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = files.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    if files.exists(target):
        files.delete(target, False)
    if not files.rename(part, target):
        raise OSError(f"{path} can't be replaced")


def get_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def save_provenance(spark: SparkSession, folder: str, settings: dict) -> None:
    put_text(spark, f"{folder}/{SIDECAR}", json.dumps(settings, indent=2, sort_keys=True))


def may_resume(spark: SparkSession, folder: str, settings: dict, pattern: str = "*.json", fresh: bool = False, allow_mismatch: bool = False) -> str:
    """Why a run may add to a folder, or why not.

    ``fresh`` and ``allow_mismatch`` ask for no check; an absent folder or one
    without matching files is ``empty``; outputs without a sidecar are
    ``unknown``, with other settings ``different``, with the same ones ``same``.
    """
    if fresh or allow_mismatch:
        return "unchecked"
    if not exists(spark, folder) or not matching_paths(spark, f"{folder}/{pattern}"):
        return "empty"
    if not exists(spark, f"{folder}/{SIDECAR}"):
        return "unknown"
    return "same" if json.loads(get_text(spark, f"{folder}/{SIDECAR}")) == json.loads(json.dumps(settings)) else "different"


def require_same(spark: SparkSession, folder: str, settings: dict, **options) -> None:
    """Raises where outputs of unknown or other settings would be mixed with new ones."""
    found = may_resume(spark, folder, settings, **options)
    if found in ("unknown", "different"):
        raise ValueError(f"{folder} holds outputs of {found} settings")
