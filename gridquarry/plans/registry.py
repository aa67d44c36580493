"""The registered queries: a function over driver tables, and its oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridquarry.plans.fixtures import Fixtures, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *needs: str) -> Callable:
    """Register fn(fixtures) under its own name."""

    def add(fn: Callable[[Fixtures], DataFrame]) -> Callable[[Fixtures], DataFrame]:
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Fixtures(spark, sf_dir))
        if sql is not None:
            ORACLES[fn.__name__] = oracle(sql, *needs)
        return fn

    return add


def again(name: str, suffix: str) -> None:
    """Register a query and its oracle under a second name."""
    QUERIES[name + suffix] = QUERIES[name]
    if name in ORACLES:
        ORACLES[name + suffix] = ORACLES[name]
