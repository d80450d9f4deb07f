"""Registered queries and the DuckDB SQL for each."""

from __future__ import annotations

from playwatch.plans.queries import QUERIES, Query


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
