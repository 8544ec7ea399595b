"""Every registered query with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name, with the SQL that gives the same rows."""

    def add(f):
        key = name or f.__name__
        assert key not in QUERIES, key
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add


def queries() -> dict[str, Callable]:
    from quillstone.plans import all_queries  # noqa: F401  registers on import

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
