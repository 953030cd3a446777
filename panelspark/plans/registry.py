"""Key -> (Spark plan, oracle SQL) registry filled by the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Plan, str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Plan) -> Plan:
        if name in REGISTRY:
            raise ValueError(f"duplicate key {name}")
        REGISTRY[name] = (fn, sql.strip() if sql else None)
        return fn
    return deco


def sql_of(name: str) -> str | None:
    """The SQL of a key that is registered already, for one that gives the same rows another way."""
    return REGISTRY[name][1]


def _load_all() -> None:
    from panelspark.plans import (  # noqa: F401
        baseline_plans,
        conform_plans,
        event_plans,
        io_plans,
        panel_plans,
        quality_plans,
        relational_plans,
        rollup_plans,
    )


def queries() -> dict[str, Plan]:
    _load_all()
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {k: v[1] for k, v in REGISTRY.items() if v[1]}
