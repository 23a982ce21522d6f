"""All queries of the library outside the llm subpackage."""

from __future__ import annotations

from millrace.plans import aggregates, arrays, connectors, extras, files, gates, joins, nested, projections, rules, scalars, selection, sets, stream, windows

MODULES = [nested, connectors, projections, gates, joins, aggregates, windows, selection, sets, scalars, rules, arrays, stream, extras, files]
FLAGSHIP = "agg_4_threshold_acceptance"


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
