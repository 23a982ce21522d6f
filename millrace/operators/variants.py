"""Nested records as flat tables, one per structural variant.

A record is JSON text.  A bottom-up tree automaton gives every value a state:
leaves by their kind, arrays and objects by the states of what they hold.  The
states decide which variant an object is, and a router walks down from the root
and sends each variant to its own typed table.  All tables share the keys of
the common supertype: the record, the child path, the parent's position and
the row's own position or name.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.scratch import Kept, keep

# states of leaves
NULL, BLANK, TEXT, NUMBER, FLAG = "null", "blank", "text", "number", "flag"
# states of arrays
NO_ITEMS, PAIRS, OBJECTS, SCALARS, MIXED = "list.empty", "list.pairs", "list.objects", "list.scalars", "list.mixed"
# states of objects
NO_FIELDS, PAIR, FLAT, NESTED, ENVELOPE = "object.empty", "object.pair", "object.flat", "object.nested", "object.envelope"

LEAVES = frozenset({NULL, BLANK, TEXT, NUMBER, FLAG})
OBJECT_STATES = frozenset({NO_FIELDS, PAIR, FLAT, NESTED, ENVELOPE})
ABSENT = frozenset({NULL, BLANK, NO_ITEMS, NO_FIELDS})


@dataclass(frozen=True)
class Layout:
    """Where things lie in a record; the defaults are those of evaluated candidates."""

    envelope: str = "data"
    evaluations: tuple[str, ...] = ("evaluator", "solver")
    scores: tuple[str, ...] = ("component_scores", "signals")
    proposal: str = "proposal"
    edit: str = "structured_edit"
    edit_lists: tuple[str, ...] = ("required_after", "forbidden_after", "preserve")
    repeated: str = "distractors"


def leaf_state(value: object) -> str:
    if value is None:
        return NULL
    if isinstance(value, bool):
        return FLAG
    if isinstance(value, (int, float)):
        return NUMBER
    return TEXT if str(value).strip(" \t\r\n") else BLANK


def array_state(items: Iterable[str]) -> str:
    """The transition for arrays: the states of the items to the state of the array."""
    kinds = set(items)
    if not kinds:
        return NO_ITEMS
    solid = kinds - {NULL, BLANK}
    if solid and solid <= {PAIR}:
        return PAIRS
    if solid and solid <= OBJECT_STATES:
        return OBJECTS
    return SCALARS if kinds <= LEAVES else MIXED


def object_state(fields: dict[str, str], layout: Layout) -> str:
    """The transition for objects: the states of the fields to the state of the object."""
    if not fields:
        return NO_FIELDS
    if fields.keys() == {"name", "value"} and fields["name"] == TEXT:
        return PAIR
    if fields.get(layout.envelope) in OBJECT_STATES and not fields.keys() & {*layout.evaluations, layout.proposal, layout.repeated}:
        return ENVELOPE
    return FLAT if set(fields.values()) <= LEAVES else NESTED


@dataclass(slots=True)
class Node:
    """A value with its state; ``parts`` are the nodes of an array or object."""

    value: object
    state: str
    parts: list[Node] | dict[str, Node] = field(default_factory=list)


def run_automaton(value: object, layout: Layout) -> Node:
    """States for a whole tree, from the leaves up; nesting of any depth needs no recursion limit."""
    root = Node(value, "")
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        if isinstance(node.value, dict):
            node.parts = {k: Node(v, "") for k, v in node.value.items()}
            todo += node.parts.values()
        elif isinstance(node.value, list):
            node.parts = [Node(v, "") for v in node.value]
            todo += node.parts
    for node in reversed(order):
        if isinstance(node.value, dict):
            node.state = object_state({k: n.state for k, n in node.parts.items()}, layout)
        elif isinstance(node.value, list):
            node.state = array_state(n.state for n in node.parts)
        else:
            node.state = leaf_state(node.value)
    return root


def _whole_object(text: str | None) -> dict | None:
    def refuse(token: str) -> None:
        raise ValueError(token)

    if text is None:
        return None
    try:
        # a whole number too long for the parser stays text
        value = json.loads(text, parse_constant=refuse, parse_int=lambda t: int(t) if len(t) < 4000 else t)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _items(node: Node | None) -> list[Node]:
    """A lone value counts as a list of one."""
    if node is None or node.state in (NULL, NO_ITEMS):
        return []
    return node.parts if isinstance(node.value, list) else [node]


def _number(node: Node) -> float | None:
    if node.state in (NUMBER, FLAG):
        try:
            return float(node.value)
        except OverflowError:
            return None
    if node.state == TEXT:
        try:
            return float(node.value)
        except ValueError:
            return None
    return None


def _text(node: Node) -> str | None:
    if node.state == NULL:
        return None
    return node.value if isinstance(node.value, str) else json.dumps(node.value, ensure_ascii=False)


def _named(node: Node | None, prefix: str = "") -> Iterator[tuple[str, Node]]:
    """The named entries of a score table, written as an object or as a list of pairs."""
    if node is None:
        return
    if isinstance(node.value, list):  # every pair counts, whatever else is in the list
        pairs = [n.parts for n in node.parts if isinstance(n.value, dict) and n.parts.keys() >= {"name", "value"}]
        entries = [(p["name"].value, p["value"]) for p in pairs if p["name"].state == TEXT]
    elif isinstance(node.value, dict):
        entries = list(node.parts.items())
    else:
        return
    stack = [(prefix + k, n) for k, n in reversed(entries)]
    while stack:
        name, n = stack.pop()
        if isinstance(n.value, dict):
            stack += [(f"{name}.{k}", x) for k, x in reversed(list(n.parts.items()))]
        elif n.state != NULL:
            yield name, n


#: child, parent_pos, item, variant, number, text, fields
Row = tuple[str, int, str, str, float | None, str | None, list[tuple[str, str | None]] | None]


def flatten_record(text: str | None, layout: Layout) -> list[Row]:
    """The child rows of one record; none for what isn't one whole JSON object."""
    value = _whole_object(text)
    if value is None:
        return []
    root = run_automaton(value, layout)
    while root.state == ENVELOPE:
        root = root.parts[layout.envelope]
    top = root.parts if isinstance(root.parts, dict) else {}
    chosen = next((e for e in layout.evaluations if e in top and top[e].state not in ABSENT), None)
    evaluation = top.get(chosen)
    out: list[Row] = [("record", -1, "", root.state, None, None, _fields(root, (chosen, layout.proposal, layout.repeated)))]
    if evaluation is not None and isinstance(evaluation.parts, dict):
        name = layout.evaluations[0]
        out.append((name, -1, "", evaluation.state, None, None, _fields(evaluation, layout.scores)))
        for table in layout.scores:
            seen = set()
            for item, n in _named(evaluation.parts.get(table)):
                if item not in seen:  # the first of entries that share a name
                    seen.add(item)
                    out.append((f"{name}.{table}", -1, item, n.state, _number(n), _text(n), None))
    proposal = top.get(layout.proposal)
    if proposal is not None and isinstance(proposal.parts, dict):
        out.append((layout.proposal, -1, "", proposal.state, None, None, _fields(proposal, (layout.edit,))))
        out += _edit(proposal.parts.get(layout.edit), f"{layout.proposal}.{layout.edit}", -1, layout)
    for i, n in enumerate(_items(top.get(layout.repeated))):
        if n.state in (NULL, BLANK):
            continue
        out.append((layout.repeated, -1, str(i), n.state, None, None, _fields(n, (layout.edit,)) if isinstance(n.value, dict) else [("value", _text(n))]))
        if isinstance(n.parts, dict):
            out += _edit(n.parts.get(layout.edit), f"{layout.repeated}.{layout.edit}", i, layout)
    return out


def _fields(node: Node, tabled: Iterable[str]) -> list[tuple[str, str | None]]:
    """The fields of an object: leaves as text, and whatever has no table of its own as JSON text."""
    if not isinstance(node.parts, dict):
        return []
    own = set(tabled)
    return [(k, _text(n)) for k, n in node.parts.items() if n.state in LEAVES or k not in own or not n.parts and n.state not in ABSENT]


def _edit(node: Node | None, path: str, parent: int, layout: Layout) -> list[Row]:
    variant = ""
    if node is not None and node.state == TEXT:
        inner = _whole_object(node.value)
        node, variant = (run_automaton(inner, layout), "text:") if inner is not None else (None, "")
    if node is None or node.state == NO_FIELDS or not isinstance(node.value, dict):
        return []
    rows: list[Row] = [(path, parent, "", variant + node.state, None, None, _fields(node, layout.edit_lists))]
    for name in layout.edit_lists:
        for i, n in enumerate(_items(node.parts.get(name))):
            if n.state not in (NULL, BLANK):
                rows.append((f"{path}.{name}", parent, str(i), n.state, None, _text(n), None))
    return rows


CHILD = [
    T.StructField("child", T.StringType()),
    T.StructField("parent_pos", T.IntegerType()),
    T.StructField("item", T.StringType()),
    T.StructField("variant", T.StringType()),
    T.StructField("number", T.DoubleType()),
    T.StructField("text", T.StringType()),
    T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
]


def child_rows(records: DataFrame, key: str, payload: str, layout: Layout = Layout()) -> DataFrame:
    """All child rows of all records: the key, child, parent_pos, item, variant, number, text, fields.

    One row per record (``child`` is record), evaluation, proposal, named
    score, edit, edit list entry and distractor.  ``item`` is the name or the
    position (from 0, as text) among the siblings, ``parent_pos`` the position
    of the distractor above, or -1.  Payloads that are null, empty, broken, not
    an object or followed by anything else give no rows; other envelopes are
    opened.  Null and blank list entries give none but keep their position.
    ``variant`` is the automaton's state.  Rows are parsed where they lie: no
    shuffle, and a payload of any size is taken whole; one nested deeper than the
    JSON parser goes (some thousands of levels) counts as broken.  ``fields``
    has every field of an object that gives no rows of its own, nested ones as
    JSON text, so that nothing is lost.  Repeated keys are parsed each.
    """
    slim = records.select(F.col(key).alias("__key"), F.col(payload).alias("__payload")).where("__payload is not null")
    schema = T.StructType([T.StructField("__key", slim.schema["__key"].dataType), *CHILD])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches:
            keys, rows = [], []
            payloads = batch.column(1)
            for i, one in enumerate(batch.column(0).to_pylist()):
                own = flatten_record(payloads[i].as_py(), layout)
                keys += [one] * len(own)
                rows += own
                if len(rows) > 50_000:
                    yield _as_batch(keys, rows, target)
                    keys, rows = [], []
            if rows:
                yield _as_batch(keys, rows, target)

    return slim.mapInArrow(parse, schema).withColumnRenamed("__key", key)


def _as_batch(keys: list, rows: list[Row], target: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(keys, target.field(0).type), *(pa.array(c, target.field(i + 1).type) for i, c in enumerate(columns))], schema=target)


@dataclass
class VariantTables:
    """One typed table per subtype, and the supertype's rows that they share keys with."""

    rows: Kept
    tables: dict[str, DataFrame]


#: Typed columns of the subtype tables that come from an object's leaf fields.
RECORD_FIELDS = {"group_id": "string", "candidate_index": "int", "candidate_role": "string", "record_key": "string", "caption": "string", "status": "string"}
EVALUATION_FIELDS = {"global_score": "double", "local_score": "double", "total_score": "double", "accepted": "boolean"}
DISTRACTOR_FIELDS = {"operation_id": "string", "family": "string", "instruction": "string"}
PROPOSAL_FIELDS = {
    "round_index": "int", "proposal_index": "int", "operation_id": "string", "family": "string", "difficulty": "int", "difficulty_level": "int", "instruction": "string", "scope": "string",
    "metric": "string", "direction": "string", "target": "double", "verifier": "string", "inverse_operation_id": "string",
}
EDIT_FIELDS = {
    name: "string"
    for name in "edit_type instruction target replacement source_object target_object source_attribute target_attribute source_material target_material source_style target_style source_location target_location target_region difficulty".split()
}

#: Which states of a structured edit go to which table; together they are all states that it can have.
ROUTES = {"flat_edits": f"= '{FLAT}'", "nested_edits": f"not in ('{FLAT}') and not startswith(variant, 'text:')", "text_edits": "like 'text:%'"}


def variant_tables(records: DataFrame, key: str, payload: str, layout: Layout = Layout()) -> VariantTables:
    """The typed tables of all records; the payloads are parsed once.

    The router sends a row to the subtype table that its state belongs to
    (``ROUTES``): a structured edit of leaves only, one with nested fields and
    one that came as JSON text have tables of their own, scores are split by
    whether they read as a number, and list entries by whether they are leaves.
    ``edits`` is the supertype of the three: their common keys and variant.
    ``records``, ``evaluations``, ``proposals``, ``distractors`` and the edits
    have their leaf fields as typed columns (null where absent or not of the
    type), and all others in ``more``, as JSON text.  Every table has the
    record's key, child, parent_pos, item and variant.
    """
    kept = keep(child_rows(records, key, payload, layout), "variant-rows")
    shared = [F.col(key), F.col("child"), F.col("parent_pos"), F.col("item"), F.col("variant")]

    def typed(where: str, columns: dict[str, str]) -> DataFrame:
        values = [F.col("fields")[c].try_cast(kind).alias(c) for c, kind in columns.items()]
        # a value that isn't of its column's type is kept as it is
        unread = F.map_filter("fields", lambda k, v: ~k.isin(list(columns)) | reduce(or_, [(k == c) & v.isNotNull() & v.try_cast(kind).isNull() for c, kind in columns.items()]))
        more = F.when(F.size(unread) > 0, F.to_json(unread))
        return kept.df.where(where).select(*shared, *values, more.alias("more"))

    scores = " or ".join(f"child = '{layout.evaluations[0]}.{s}'" for s in layout.scores)
    edits = f"child like '%.{layout.edit}'"
    entries = " or ".join(f"child like '%.{layout.edit}.{x}'" for x in layout.edit_lists)
    tables = {
        "records": typed("child = 'record'", RECORD_FIELDS),
        "evaluations": typed(f"child = '{layout.evaluations[0]}'", EVALUATION_FIELDS),
        "proposals": typed(f"child = '{layout.proposal}'", PROPOSAL_FIELDS),
        "distractors": typed(f"child = '{layout.repeated}'", DISTRACTOR_FIELDS),
        "edits": kept.df.where(edits).select(*shared),
        "number_scores": kept.df.where(f"({scores}) and number is not null").select(*shared, "number"),
        "text_scores": kept.df.where(f"({scores}) and number is null").select(*shared, "text"),
        "edit_entries": kept.df.where(entries).select(*shared, "text"),
    }
    for table, states in ROUTES.items():
        tables[table] = typed(f"{edits} and variant {states}", EDIT_FIELDS)
    return VariantTables(kept, tables)
