"""Queries over the raw candidate payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.latest import latest_by
from millrace.operators.variants import VariantTables, variant_tables

#: Rows of the supertype that aren't children of a listed path.
OWN_ROWS = ("record", "evaluator", "proposal")


def _tables(spark: SparkSession, sf: str) -> VariantTables:
    lines = latest_by(spark.read.parquet(f"{sf}/raw_lines.parquet").select("raw_id", "payload", "received_at").where("raw_id is not null"), ["raw_id"], "received_at")
    return variant_tables(lines, "raw_id", "payload")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = _tables(spark, sf).rows.df
    return rows.where(~F.col("child").isin(*OWN_ROWS)).select("raw_id", "child", "parent_pos", "item")


def p3_records(spark: SparkSession, sf: str) -> DataFrame:
    return _tables(spark, sf).tables["records"]


def p3_evaluations(spark: SparkSession, sf: str) -> DataFrame:
    return _tables(spark, sf).tables["evaluations"]


def p3_proposals(spark: SparkSession, sf: str) -> DataFrame:
    return _tables(spark, sf).tables["proposals"]


def p3_edits(spark: SparkSession, sf: str) -> DataFrame:
    return _tables(spark, sf).tables["edits"]


def p3_flat_edits(spark: SparkSession, sf: str) -> DataFrame:
    return _tables(spark, sf).tables["flat_edits"]


def p3_nested_edits(spark: SparkSession, sf: str) -> DataFrame:
    return _tables(spark, sf).tables["nested_edits"]


def p3_text_edits(spark: SparkSession, sf: str) -> DataFrame:
    return _tables(spark, sf).tables["text_edits"]


def p3_distractors(spark: SparkSession, sf: str) -> DataFrame:
    return _tables(spark, sf).tables["distractors"]


def p3_number_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _tables(spark, sf).tables["number_scores"]


def p3_text_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _tables(spark, sf).tables["text_scores"]


def p3_edit_entries(spark: SparkSession, sf: str) -> DataFrame:
    return _tables(spark, sf).tables["edit_entries"]


QUERIES = {f.__name__: f for f in (p3_found, p3_records, p3_evaluations, p3_proposals, p3_edits, p3_flat_edits, p3_nested_edits, p3_text_edits, p3_distractors, p3_number_scores, p3_text_scores, p3_edit_entries)}
SQL: dict[str, str] = {}
