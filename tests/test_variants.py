from __future__ import annotations

import json
import os
import random

import pytest

from millrace.operators.variants import Layout, child_rows, flatten_record, run_automaton, variant_tables

OWN = {"record", "evaluator", "proposal"}


def brute(text):
    """The child rows as the problem states them, written without an automaton."""
    try:
        v = json.loads(text)
    except (TypeError, ValueError):
        return []
    if not isinstance(v, dict):
        return []
    if "data" in v:
        v = v["data"]
    out = set()
    ev = v.get("evaluator") or v.get("solver") or {}

    def leaves(d, prefix):
        for k, x in d.items():
            if isinstance(x, dict):
                yield from leaves(x, f"{prefix}{k}.")
            elif x is not None:
                yield prefix + k

    for t in ("component_scores", "signals"):
        d = ev.get(t) or {}
        if isinstance(d, list):
            d = {p["name"]: p["value"] for p in d if isinstance(p, dict)}
        out |= {(f"evaluator.{t}", -1, name) for name in leaves(d, "")}

    def solid(x):
        return x is not None and not (isinstance(x, str) and not x.strip())

    def as_list(x):
        return [] if x is None else x if isinstance(x, list) else [x]

    def edit(e, path, parent):
        if isinstance(e, str):
            try:
                e = json.loads(e)
            except ValueError:
                return
        if isinstance(e, dict) and e:
            out.add((path, parent, ""))
            for f in ("required_after", "forbidden_after", "preserve"):
                out.update((f"{path}.{f}", parent, str(i)) for i, x in enumerate(as_list(e.get(f))) if solid(x))

    edit((v.get("proposal") or {}).get("structured_edit"), "proposal.structured_edit", -1)
    for i, d in enumerate(as_list(v.get("distractors"))):
        if solid(d):
            out.add(("distractors", -1, str(i)))
            if isinstance(d, dict):
                edit(d.get("structured_edit"), "distractors.structured_edit", i)
    return sorted(out)


def found(text):
    return sorted(r[:3] for r in flatten_record(text, Layout()) if r[0] not in OWN)


CASES = [
    None, "", " ", "{", '{"a": 1} x', "[]", "null", "3", '"text"', '{"a": NaN}', "{}", '{"data": {}}', '{"evaluator": {}, "solver": {"signals": {"a": 0}}}',
    '{"evaluator": null, "solver": {"component_scores": [{"name": "a", "value": 1}, {"name": "b", "value": null}, null]}}',
    '{"evaluator": {"signals": {"x": {"y": {"z": 1, "n": null}, "e": {}}, "l": [1]}}}',
    '{"proposal": {"structured_edit": "{\\"edit_type\\": \\"a\\", \\"preserve\\": [null, \\" \\", \\"p\\"]}"}, "distractors": [null, {"structured_edit": {"required_after": "one"}}, {"structured_edit": "broken{"}, {"structured_edit": {}}]}',
    '{"distractors": {"structured_edit": {"a": 1}}}', '{"proposal": null, "distractors": null}', '{"proposal": "text", "distractors": "text"}',
]


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    if text and '"distractors": "text"' in text:
        assert found(text) == [("distractors", -1, "0")]
    else:
        assert found(text) == ([] if text and "NaN" in text else brute(text))


def test_random_records():
    rng = random.Random(1)
    value = lambda d: rng.choice([None, "", " ", "t", 1, 0.5, True, [], {}, [value(d - 1)], {"k": value(d - 1)}]) if d else rng.choice([None, "x", 2])
    for _ in range(500):
        edit = rng.choice([None, {}, {"edit_type": "a", "preserve": rng.choice([None, [], ["a", None, ""], "lone"])}])
        edit = json.dumps(edit) if rng.random() < 0.3 and edit else edit
        record = {"evaluator": rng.choice([None, {}, {"signals": {"a": value(2), "b": rng.choice([None, 1])}}]), "solver": {"component_scores": {"s": 1}}, "proposal": {"structured_edit": edit}, "distractors": rng.choice([None, [], [None, {"structured_edit": edit}], {"structured_edit": edit}])}
        text = json.dumps({"kind": "candidate", "data": record} if rng.random() < 0.3 else record)
        assert found(text) == brute(text), text


def test_states_and_depth():
    state = lambda x: run_automaton(x, Layout()).state
    assert state([{"name": "a", "value": 1}, None]) == "list.pairs" and state([1, "a"]) == "list.scalars" and state([{}, {"a": 1}]) == "list.objects"
    assert state({"a": {"b": 1}}) == "object.nested" and state({"a": 1}) == "object.flat" and state({"data": {"a": 1}, "kind": "x"}) == "object.envelope"
    deep = '{"evaluator": {"signals": ' + '{"k":' * 300 + "1" + "}" * 300 + "}}"
    assert found(deep) == [("evaluator.signals", -1, ".".join(["k"] * 300))]


def test_tables(spark):
    rows = [(i, c, "clash") for i, c in enumerate(CASES)] + [(None, '{"status": "x"}', "")]
    df = spark.createDataFrame(rows, "id long, payload string, child string")
    tables = variant_tables(df, "id", "payload").tables
    assert {r.id for r in tables["records"].collect()} >= {None, 10, 11}
    assert sorted((r.id, r.number) for r in tables["number_scores"].collect() if r.number is not None)[0] == (12, 0.0)
    assert [r.text for r in tables["edit_entries"].where("id = 15").orderBy("child").collect()] == ["one", "p"]
    assert child_rows(df.limit(0), "id", "payload").count() == 0


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001/raw_lines.parquet"), reason="no test tables")
def test_whole_table(spark):
    from millrace.plans.nested import p3_found

    want = set()
    for r in spark.read.parquet("/root/testdata/sf0.001/raw_lines.parquet").collect():
        want |= {(r.raw_id, *x) for x in brute(r.payload)}
    got = [tuple(r) for r in p3_found(spark, "/root/testdata/sf0.001").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def leaves(value):
    """Every value in a tree that isn't null or blank, numbers and numbers in text alike."""
    if isinstance(value, dict):
        return set().union(*map(leaves, value.values())) if value else set()
    if isinstance(value, list):
        return set().union(*map(leaves, value)) if value else set()
    if isinstance(value, str) and value[:1] in "{[":
        try:
            return leaves(json.loads(value))
        except ValueError:
            pass
    if value is None or isinstance(value, str) and not value.strip():
        return set()
    try:
        return {float(value)}
    except ValueError:
        return {str(value).lower()}


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001/raw_lines.parquet"), reason="no test tables")
def test_nothing_of_a_whole_table_is_lost(spark):
    """Every value of every readable payload is in one of the tables, and edits are routed to exactly one."""
    rows = [(r.raw_id, r.payload) for r in spark.read.parquet("/root/testdata/sf0.001/raw_lines.parquet").where("raw_id is not null").dropDuplicates(["raw_id"]).collect()]
    tables = variant_tables(spark.createDataFrame(rows, "raw_id long, payload string"), "raw_id", "payload").tables
    got: dict[int, set] = {}
    keys = ("raw_id", "child", "parent_pos", "item", "variant")
    for name, table in tables.items():
        for r in table.collect():
            got.setdefault(r.raw_id, set()).update(*(leaves(v) for k, v in r.asDict().items() if k not in ("raw_id", "child", "parent_pos", "variant")))  # the name of a pair is the item
    for raw_id, payload in rows:
        if flatten_record(payload, Layout()):
            value = json.loads(payload)
            while run_automaton(value, Layout()).state == "object.envelope":
                value = value["data"]
            assert leaves(value) <= got[raw_id], (raw_id, leaves(value) - got[raw_id])
    at = lambda name: sorted(tuple(r[k] for k in keys) for r in tables[name].select(*keys).collect())
    assert at("edits") == sorted(at("flat_edits") + at("nested_edits") + at("text_edits")) and at("text_edits") and at("nested_edits")


def test_lists_with_some_good_pairs_and_long_numbers():
    assert found('{"evaluator": {"signals": [{"name": "a", "value": 1, "unit": "x"}, {"name": " ", "value": 2}, {"name": 3, "value": 2}, {"name": "b"}, 7, {"name": "c", "value": "2"}]}}') == [("evaluator.signals", -1, "a"), ("evaluator.signals", -1, "c")]
    long = "1" * 6000
    assert flatten_record('{"evaluator": {"signals": {"n": ' + long + "}}}", Layout())[-1][5] == long
