"""The query catalog: one Spark query and (where SQL can say it) one DuckDB oracle per key.

Every query reads whole driver tables through the stand-ins; parameters (filter
arguments, page, as-of time) are fixed literals so results do not depend on the clock.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from muster.plans.standins import StandIns

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(standins) -> DataFrame`` under ``name`` with its oracle SQL."""
    def deco(fn: Callable[[StandIns], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(StandIns.of(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from muster.plans import (  # noqa: F401
        q_access,
        q_derived,
        q_files,
        q_fulltext,
        q_ingest,
        q_jobs,
        q_listing,
        q_mutate,
        q_rules,
        q_sequence,
        q_stream,
        q_totals,
        q_updates,
    )
