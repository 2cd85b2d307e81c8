"""Query registry: name -> (Spark builder, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_SQL: dict[str, Callable[[], str]] = {}


def register(name: str, sql: Callable[[], str] | None = None):
    """Register a query builder; ``sql`` returns the equivalent DuckDB SQL
    (omitted for ML / iterative operators: rows-only check)."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn
    return deco


def _load_all() -> None:
    # Importing the modules runs their @register decorators.
    from textpulse.plans import q_aggregate, q_clean, q_quality, q_scores, q_topics  # noqa: F401


def queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """SQL twin of every query that has one. A twin whose text cannot be built
    does not hide the others: its SQL is a statement that fails with the
    reason, so the comparison reports that one query as an error."""
    _load_all()
    out = {}
    for name, build in _SQL.items():
        try:
            out[name] = build()
        except Exception as e:  # noqa: BLE001 - reported by the comparison
            reason = f"{type(e).__name__}: {e}".replace("'", "''")
            out[name] = f"SELECT error('oracle SQL of {name} could not be built: {reason}')"
    return out
