"""Registry of runnable queries and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Runner = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Plan:
    run: Runner
    sql: str | None


PLANS: dict[str, Plan] = {}


def plan(name: str, sql: str | None = None) -> Callable[[Runner], Runner]:
    """Register ``fn(spark, sf_dir)`` under ``name`` with optional checking SQL."""

    def add(fn: Runner) -> Runner:
        if name in PLANS:
            raise ValueError(f"duplicate query {name}")
        PLANS[name] = Plan(fn, sql)
        return fn

    return add
