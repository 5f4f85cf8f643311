"""Registry of the engine's queries and of their DuckDB SQL."""

from __future__ import annotations

from tidemark.plans import exploration, geometry, lifecycle, scoring, traffic, training

_PLANS = (traffic, scoring, lifecycle, exploration, training, geometry)


def queries() -> dict:
    return {name: f for plan in _PLANS for name, f in plan.R.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in _PLANS for name, sql in plan.R.sql.items()}
