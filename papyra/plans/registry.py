"""Registry of named queries: a Spark builder plus, where SQL can express
it, the DuckDB oracle text (fixture views are added as CTEs)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.fixtures import Fixtures, register, with_views

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(fx: Fixtures) -> DataFrame`` as query ``name``."""
    def deco(fn: Callable[[Fixtures], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(register(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return fn
    return deco


def load_all() -> None:
    """Import every catalogue module so its queries register."""
    from . import (catalog_sources, catalog_gates, catalog_joins, catalog_stats,  # noqa: F401
                   catalog_windows, catalog_listing, catalog_functions, catalog_model,
                   catalog_jobs, catalog_streaming)
