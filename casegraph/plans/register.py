"""How a module of queries registers them."""

from __future__ import annotations

from collections.abc import Callable


def register() -> tuple[dict[str, Callable], dict[str, str], Callable]:
    """Queries and SQL of a module by name, and the decorator that adds to them."""
    queries: dict[str, Callable] = {}
    sql: dict[str, str] = {}

    def query(name: str, twin: str | None = None) -> Callable:
        """Register a query under a name, with its SQL twin."""

        def add(function: Callable) -> Callable:
            queries[name] = function
            if twin:
                sql[name] = twin
            return function

        return add

    return queries, sql, query
