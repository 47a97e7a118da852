"""Registered queries: every entry runs one operator over whole tables, most with check SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskspark.plans.oracle import compose
from riskspark.sources.views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(views) -> DataFrame`` under ``name`` with optional check SQL."""
    def deco(fn: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load() -> None:
    """Import every query module (each registers its entries)."""
    from riskspark.plans import (  # noqa: F401
        oracle_views, q_risk, q_intel, q_data, q_events, q_more,
    )


def oracle_sql() -> dict[str, str]:
    return {k: compose(v) for k, v in ORACLES.items()}
