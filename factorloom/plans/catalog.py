"""Registration of queries with the SQL that gives the same rows."""

from __future__ import annotations

from ..sources import adapters

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """sql goes on from the adapters' WITH list: it starts with SELECT, or with a comma and further tables."""

    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = adapters.SQL + sql
        return f

    return register
