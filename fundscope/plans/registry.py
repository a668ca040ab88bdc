"""Query registry shared by the catalog modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import views
from .oracle_views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

AS_OF = views.AS_OF
AS_OF_TS = views.AS_OF_TS
D_AS_OF = f"DATE '{AS_OF}'"


def register(name: str, sql: str | None = None, *views_needed: str):
    """Register ``fn(spark, sf_dir)`` under ``name`` with its DuckDB oracle (None: rows-only check)."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(sql, *views_needed)
        return fn
    return deco


def v1(spark, d):
    return views.opportunities(spark, d)
