"""How a module of queries registers them with their SQL."""

from __future__ import annotations


def registry():
    """(queries, SQL by query, decorator that adds both under the function's name)."""
    found: dict = {}
    sql: dict[str, str] = {}

    def query(text: str | None = None):
        def add(f):
            found[f.__name__] = f
            if text:
                sql[f.__name__] = text
            return f

        return add

    return found, sql, query
