"""All queries of the engine's own operators and their SQL twins."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir), with the SQL that gives the same rows."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


from . import aggregates, graphs, relational, samples, search, similarity, texts  # noqa: E402,F401
