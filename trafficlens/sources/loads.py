"""Load tables from CSV and text, and made-up loads for trials."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trafficlens.functions.values import clean_load, epoch_seconds

# Column choice order and the default start of generated timestamps.
LOAD_COLUMNS = ("load", "request_count")
DEFAULT_START = "1995-07-01 00:00:00"


def dense_numbers(lines: DataFrame, name: str) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... over a file read, by file name and place.

    Lines of one split are numbered in a row; how many stand in the splits before comes from one row per split.
    """
    spot = ["__file", "__block"]
    numbered = lines.select(
        "*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__id"),
    )
    before = Window.orderBy(*spot).rowsBetween(Window.unboundedPreceding, -1)
    splits = numbered.groupBy(*spot).agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    splits = splits.select(*spot, "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return numbered.join(splits, spot).withColumn(name, F.col("__before") + F.col("__id") - F.col("__first")).drop(*spot, "__id", "__first", "__before")


def read_csv_loads(spark: SparkSession, path: str, load: str | None = None, ts: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Loads of a CSV file with a header; the load column is the given one, ``load`` or ``request_count``.

    ``keep`` names further columns of the file to pass on, such as the one that tells series apart.
    """
    raw = spark.read.option("header", True).csv(path)
    if not raw.columns:
        raise ValueError("the file is empty")
    chosen = load or next((c for c in LOAD_COLUMNS if c in raw.columns), None)
    if chosen is None or chosen not in raw.columns:
        raise ValueError(f"no load column; the file has {raw.columns}")
    ts = ts or ("timestamp" if "timestamp" in raw.columns else None)
    stamp = F.try_to_timestamp(F.col(ts)).cast("timestamp_ntz") if ts else F.lit(None).cast("timestamp_ntz")
    return dense_numbers(raw, "period").select(
        *keep, "period", stamp.alias("timestamp"),
        clean_load(F.col(chosen).try_cast("double")).alias("load"),
    )


def parse_text_loads(lines: DataFrame, value: str = "value") -> DataFrame:
    """One number per line, or several split by comma, space or tab; comments, blanks and words are dropped."""
    text = F.trim(F.col(value))
    kept = lines.where((text != "") & ~text.startswith("#"))
    rest = [c for c in lines.columns if c != value]
    parts = kept.select(*rest, F.posexplode(F.split(text, r"[,\s]+")).alias("part", "token"))
    number = F.col("token").try_cast("double")
    return parts.where(number.isNotNull()).select(*rest, "part", clean_load(number).alias("load"))


def read_text_loads(spark: SparkSession, path: str) -> DataFrame:
    return parse_text_loads(dense_numbers(spark.read.text(path), "line_no"))


def with_timestamps(df: DataFrame, interval_minutes: float, start: str = DEFAULT_START, period: str = "period") -> DataFrame:
    """Start plus period times interval."""
    begin = F.unix_micros(F.lit(start).cast("timestamp"))
    micros = begin + (F.col(period) * F.lit(interval_minutes * 60_000_000)).cast("bigint")
    return df.withColumn("timestamp", F.timestamp_micros(micros).cast("timestamp_ntz"))


def daily_wave(ts):
    """The noise-free daily shape of the made-up load."""
    hour = (epoch_seconds(ts) % 86400) / F.lit(3600.0)
    return F.greatest(F.lit(50.0) + F.lit(80.0) * F.sin(F.lit(math.pi) * (hour - 6) / 12), F.lit(20.0))


def sample_loads(grid: DataFrame, seed: int = 42, spikes: int = 10, ts: str = "timestamp") -> DataFrame:
    """Daily wave, normal noise and about ``spikes`` spikes per 288 rows on the rows of a time grid; at least 10."""
    chance = F.rand(seed) < F.lit(spikes / 288)
    spike = F.when(chance, F.lit(50.0) + F.rand(seed + 1) * 100).otherwise(0.0)
    return grid.withColumn("load", F.greatest(daily_wave(F.col(ts)) + spike + F.randn(seed + 2) * 10, F.lit(10.0)))


def sample_grid(spark: SparkSession, periods: int, interval_minutes: float = 5.0) -> DataFrame:
    return with_timestamps(spark.range(periods).withColumnRenamed("id", "period"), interval_minutes)
