"""Registry of the queries: a Spark form, the columns it returns, and where possible the same query as SQL.

Column kinds: ``s`` text, ``i`` integer, ``d`` number rounded to 6 places (``d4``, ``d2`` to fewer), ``t`` timestamp,
``b`` flag. Both forms are projected to the same columns, types and rounding.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.plans.sqlviews import with_views
from trafficlens.session import prepare

SPARK_TYPES = {"s": "string", "i": "bigint", "t": "timestamp_ntz", "b": "boolean"}
SQL_TYPES = {"s": "VARCHAR", "i": "BIGINT", "t": "TIMESTAMP", "b": "BOOLEAN"}


@dataclass(frozen=True)
class Query:
    name: str
    columns: tuple[tuple[str, str], ...]
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    uses: tuple[str, ...]

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        out = []
        for name, kind in self.columns:
            if kind.startswith("d"):
                value = F.round(F.col(name).cast("double"), int(kind[1:] or 6)) + F.lit(0.0)
            else:
                value = F.col(name).cast(SPARK_TYPES[kind])
            out.append(value.alias(name))
        return self.build(spark, sf_dir).select(*out)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        out = []
        for name, kind in self.columns:
            if kind.startswith("d"):
                value = f'round(CAST("{name}" AS DOUBLE), {int(kind[1:] or 6)}) + 0.0'
            else:
                value = f'CAST("{name}" AS {SQL_TYPES[kind]})'
            out.append(f'{value} AS "{name}"')
        return with_views(self.uses) + "SELECT " + ", ".join(out) + f" FROM ({self.sql.strip()}) AS q"


REGISTRY: dict[str, Query] = {}


def query(name: str, columns: str, sql: str | None = None, uses: str = ""):
    """Register a function (spark, sf_dir) -> DataFrame. ``columns`` reads ``name:kind name:kind ...``."""

    def add(build):
        if name in REGISTRY:
            raise ValueError(f"query {name} is already there")
        parts = tuple(tuple(c.rsplit(":", 1)) for c in columns.split())
        REGISTRY[name] = Query(name, parts, build, sql, tuple(uses.split()))
        return build

    return add
