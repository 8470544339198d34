"""Every registered query."""

from __future__ import annotations

from trafficlens.plans import queries_capacity, queries_forecast, queries_logs, queries_series, queries_stats, queries_streams  # noqa: F401
from trafficlens.plans.registry import REGISTRY


def spark_queries():
    return {name: q.run for name, q in REGISTRY.items()}


def sql_queries():
    return {name: q.oracle() for name, q in REGISTRY.items() if q.sql is not None}
