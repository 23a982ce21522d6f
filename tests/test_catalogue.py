"""A spread of the catalogue against its SQL on the smallest tables; the driver runs all of it."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__
from millrace.plans import catalogue

SF = "/root/testdata/sf0.001"
NAMES = sorted(catalogue.oracle_sql())[::7]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return f"{float(v):.9g}" if hasattr(v, "as_tuple") else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    rows = catalogue.queries()[name](spark, SF)
    columns = sorted(rows.columns)
    got = sorted([plain(x) for x in r] for r in rows.select(*columns).collect())
    answer = con.execute(catalogue.oracle_sql()[name])
    at = [[d[0] for d in answer.description].index(c) for c in columns]
    assert len(answer.description) == len(columns)
    assert got == sorted([plain(r[i]) for i in at] for r in answer.fetchall())


def test_entry_points(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
