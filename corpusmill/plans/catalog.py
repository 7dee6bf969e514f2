"""All queries of the library with their SQL."""

from __future__ import annotations

from . import indexes, repair, series, tables, text

MODULES = (text, tables, series, repair, indexes)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
