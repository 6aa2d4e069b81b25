"""Registry of named queries: a Spark callable and, where SQL can state it, a DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship_library
from .fixture_sql import with_fx

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register `fn(spark, sf_dir)` under `name`, with its oracle SQL when given."""
    def wrap(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_library(spark)
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = with_fx(sql)
        return fn
    return wrap


def load_all() -> None:
    from . import (q_ingest, q_responses, q_repair, q_prompts, q_results,  # noqa: F401
                   q_cache, q_metrics, q_history, q_limits, flagship, q_streaming)
