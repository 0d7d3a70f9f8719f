"""Registry of the engine's queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from massloom.plans.views import with_views

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) -> DataFrame under its name, with SQL for the same rows."""

    def keep(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_views(sql)
        return f

    return keep


def load() -> None:
    """Import every module of queries."""
    from massloom.catalog import clusters, deconvolution, dependence, envelopes, featuremaps, features, indexes, kernels, metadata, mobility, paths, peaks, precursors, quality, roundtrips, scans, services, signals, similarity, streams, tracing  # noqa: F401
