"""How query modules register a query with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable


def registering() -> tuple[dict, dict, Callable]:
    """(queries, SQL by query, decorator that adds to both)."""
    queries: dict = {}
    oracles: dict = {}

    def query(name: str, sql: str | None = None):
        def keep(function):
            queries[name] = function
            if sql:
                oracles[name] = sql
            return function

        return keep

    return queries, oracles, query
