"""All registered queries of the library, by name, and their SQL."""

from __future__ import annotations

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def register(sql: str | None = None):
    """Register a query function (spark, sf_dir) under its name, with the SQL that gives the same rows."""

    def keep(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict:
    from geoloom.plans import all_queries

    all_queries()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    queries()
    return _SQL
