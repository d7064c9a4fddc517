"""All queries of the engine's own operators, and their DuckDB SQL."""

from __future__ import annotations

from passagework.queries import compare, composed, lifecycle, records, search, stewardship, vault, work

_MODULES = (search, records, composed, lifecycle, vault, work, compare, stewardship)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
