from __future__ import annotations

import json

import pytest

from millrace.plans.projections import merged, parse_override
from millrace.sources import readers, writers

SCHEMA = "a int, b string"


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_torn_tail(spark, tmp_path):
    good = '{"a": 1, "b": "x"}\n\n{"a": 2, "b": "y"}\n'
    put(tmp_path / "log/one.jsonl", good + '{"a": 3, "b": ')
    put(tmp_path / "log/two.jsonl", good)
    rows = readers.read_log(spark, str(tmp_path / "log"), SCHEMA)
    assert sorted((r.a, r.b) for r in rows.collect()) == [(1, "x"), (1, "x"), (2, "y"), (2, "y")]
    with pytest.raises(ValueError):
        readers.read_log(spark, str(tmp_path / "log"), SCHEMA, torn_tail=False)
    put(tmp_path / "bad/one.jsonl", '{"a": 1}\n{"a": \n{"a": 2}\n')
    with pytest.raises(ValueError):
        readers.read_log(spark, str(tmp_path / "bad"), SCHEMA)


def test_records_by_suffix(spark, tmp_path):
    rows = [{"a": 1, "b": "x"}, {"a": 2, "b": None}]
    for i, value in enumerate((rows, {"records": rows}, {"k1": rows[0], "k2": rows[1]})):
        path = put(tmp_path / f"{i}.json", json.dumps(value))
        assert sorted(r.a for r in readers.read_records(spark, path, SCHEMA).collect()) == [1, 2]
    assert readers.read_records(spark, put(tmp_path / "t.csv", "a,b\n1,x\n"), SCHEMA).first().a == "1"
    with pytest.raises(ValueError):
        readers.read_records(spark, "x.txt", SCHEMA)


def test_rounds(spark, tmp_path):
    for n in (1, 2, 10):
        put(tmp_path / f"round_{n:02d}/proposals.jsonl", f'{{"a": {n}, "b": "x"}}\n')
        put(tmp_path / f"round_{n:02d}/x/summary.json", f'{{"s": {n}}}')
    assert sorted((r.a, r._round) for r in readers.read_rounds(spark, str(tmp_path), SCHEMA).collect()) == [(1, 1), (2, 2), (10, 10)]
    assert [r._round for r in readers.read_rounds(spark, str(tmp_path), SCHEMA, [10]).collect()] == [10]
    assert readers.read_rounds(spark, str(tmp_path / "none"), SCHEMA).count() == 0


def test_round_parts(spark, tmp_path):
    put(tmp_path / "round_01/summary.json", '{"s": 1}')
    put(tmp_path / "round_02/summary.json", '{"s": 2}')
    put(tmp_path / "round_02/progress.json", '{"p": 5}')
    rows = readers.round_of_parts(spark, str(tmp_path), {"summary.json": "s int", "progress.json": "p int"}).collect()
    assert sorted((r._round, r.s, r.p or 0) for r in rows) == [(1, 1, 0), (2, 2, 5)]


def test_images_and_paths(spark, tmp_path):
    for name in ("b.png", "d/a.jpg", "c.txt"):
        put(tmp_path / name, "x")
    assert [r.key for r in readers.read_images(spark, str(tmp_path)).collect()] == ["b.png", "d__a.jpg"]
    one = str(tmp_path / "b.png")
    assert readers.expand_paths(spark, [one, str(tmp_path / "*.png"), "missing"]) == [one, "missing"]
    before = {one}
    assert readers.new_files(spark, before, str(tmp_path / "*")) == sorted([str(tmp_path / "c.txt"), str(tmp_path / "d")])


def test_specs_overrides_and_yaml(tmp_path):
    assert readers.parse_spec("org/x:conf:test", {}) == {"repo": "org/x", "config": "conf", "split": "test"}
    assert readers.parse_spec("p", {"p": {"repo": "r"}}) == {"repo": "r"} and readers.parse_spec("r", {})["split"] == "train"
    with pytest.raises(ValueError):
        readers.parse_spec("a:b:c:d", {})
    assert [parse_override(x) for x in ("null", "True", "3", "0.5", "[1]", "word")] == [None, True, 3, 0.5, [1], "word"]
    assert merged({"a": {"b": 1, "c": 2}}, "a.b", 5) == {"a": {"b": 5, "c": 2}} and merged({"a": 1}, "a.b.c", 2) == {"a": {"b": {"c": 2}}}
    assert readers.load_yaml(put(tmp_path / "c.yaml", "x: 1"))["x"] == 1
    with pytest.raises(ValueError):
        readers.load_yaml(put(tmp_path / "l.yaml", "- 1"))


def test_model_row(spark):
    table = spark.createDataFrame([("m1", 1), ("m2", 2)], "name string, v int")
    assert readers.model_row(table, "name", "m2").first().v == 2
    assert readers.model_row(table.where("v = 1"), "name", "other").first().v == 1
    with pytest.raises(ValueError):
        readers.model_row(table, "name", "other")
    with pytest.raises(ValueError):
        readers.require_rows(table.limit(0), "rows")


def test_open_first(spark, tmp_path):
    good = lambda: spark.createDataFrame([(1,)], "a int")
    assert readers.open_first([lambda: spark.read.parquet(str(tmp_path / "none")), good]).first().a == 1
    with pytest.raises(Exception):
        readers.open_first([lambda: spark.read.parquet(str(tmp_path / "none"))])


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("a|b", 0.5), (None, 1.0)], "name string, v double")
    assert writers.markdown(rows).splitlines() == ["| name | v |", "| --- | --- |", "| a\\|b | 0.5 |", "|  | 1 |"]
    assert "\\begin{tabular}{ll}" in writers.latex(rows) and "<td>0.5</td>" in writers.dashboard(rows, "t")
    writers.save_document({"b": 1}, str(tmp_path / "d.json"))
    assert json.loads((tmp_path / "d.json").read_text()) == {"b": 1}
