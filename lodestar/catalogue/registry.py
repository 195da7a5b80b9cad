"""Registration of queries together with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from lodestar.sources.corpus import CORPUS


def area() -> tuple[Callable, dict[str, Callable], dict[str, str]]:
    """(decorator, queries, SQL) of one module; SQL that reads the corpus view gets its definition put in front."""
    queries: dict[str, Callable] = {}
    oracle: dict[str, str] = {}

    def query(sql: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            queries[f.__name__] = f
            if sql:
                whole = sql.lstrip().upper().startswith("WITH") or "corpus" not in sql
                oracle[f.__name__] = sql if whole else f"WITH {CORPUS} {sql}"
            return f

        return add

    return query, queries, oracle
