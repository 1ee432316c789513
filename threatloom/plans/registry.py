"""Registration of queries and the SQL that they are checked with."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict[str, Callable], dict[str, str], Callable]:
    """``(queries, sql, query)``: two tables and the decorator ``query(sql)`` that fills them."""
    queries: dict[str, Callable] = {}
    sql: dict[str, str] = {}

    def query(text: str | None = None):
        def register(fn):
            queries[fn.__name__] = fn
            if text is not None:
                sql[fn.__name__] = text
            return fn

        return register

    return queries, sql, query
