"""Registry of named queries (Spark callables) and their DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with optional oracle SQL."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def load_all() -> None:
    """Import every catalog module so that their queries register."""
    from weft.plans import (  # noqa: F401
        cat_audit,
        cat_constraints,
        cat_delivery,
        cat_dirty,
        cat_fit,
        cat_generate,
        cat_io,
        cat_privacy,
        cat_reports,
        cat_scale,
        cat_store,
        cat_temporal,
        cat_text,
    )
