"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from millrace.llm import queries as _queries
from millrace.llm import sql as _sql


def queries() -> dict:
    return dict(_queries.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_sql.SQL)
