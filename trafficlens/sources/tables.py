"""Saving and loading series, features and reports."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "csv", "json")


def save(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: tuple[str, ...] = ()) -> None:
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format: {fmt}")
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def load(spark: SparkSession, path: str, fmt: str | None = None, schema=None) -> DataFrame:
    """Read a saved table; CSV and JSON take the schema they were saved with (timestamps parse by it)."""
    fmt = fmt or os.path.splitext(path.rstrip("/"))[1].lstrip(".") or "parquet"
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format: {fmt}")
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    elif fmt == "csv":
        reader = reader.option("inferSchema", True)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(path)


def save_by_granularity(series: DataFrame, path: str) -> None:
    """One folder per window length, so a reader of one length skips the others."""
    save(series, path, partition_by=("granularity",))


def export_report(metrics: DataFrame, decisions: DataFrame, folder: str) -> dict[str, str]:
    """Metrics as CSV, the report as JSON, the time series as CSV."""
    paths = {"metrics": f"{folder}/metrics", "report": f"{folder}/report", "series": f"{folder}/series"}
    save(metrics, paths["metrics"], "csv")
    nested = metrics.select(F.struct("*").alias("metrics"))
    save(nested, paths["report"], "json")
    save(decisions, paths["series"], "csv")
    return paths
