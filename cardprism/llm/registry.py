"""Queries of this subpackage and their DuckDB twins (None: not expressible;
held against brute force in tests/llm)."""

QUERIES: dict = {}
ORACLE: dict = {}


def register(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return put
