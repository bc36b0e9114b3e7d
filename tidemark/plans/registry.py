"""Registers queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from tidemark.plans.views import SQL


def registry() -> tuple[dict[str, Callable], dict[str, str], Callable]:
    queries, oracles = {}, {}

    def query(sql: str | None = None, name: str | None = None):
        """Adds a query; sql starting with a comma goes on after the views, `SELECT` follows them, anything else stands alone."""

        def add(f: Callable) -> Callable:
            key = name or f.__name__
            queries[key] = f
            if sql is not None:
                text = sql.strip()
                oracles[key] = SQL + text if text.startswith((",", "SELECT")) else text
            return f

        return add

    return queries, oracles, query


def hash_int(text: str) -> str:
    """DuckDB: the first four bytes of SHA-256, as a number."""
    return f"(('0x' || substr(sha256({text}), 1, 8))::BIGINT)"
