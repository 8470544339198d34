"""Traffic profiles: statistics, time-of-day and day-of-week shapes, histograms, entropy, downsampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.functions.calendar import day_of_week
from trafficlens.functions.values import epoch_seconds, floor_time, ratio
from trafficlens.operators.scale import quantiles
from trafficlens.operators.sketches import approximate_quantiles

QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def series_stats(df: DataFrame, keys: Sequence[str] = ("series_id",), y: str = "y", ts: str = "timestamp") -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(ts).alias("first_time"),
        F.max(ts).alias("last_time"),
        F.sum(y).alias("total"),
        F.avg(y).alias("mean"),
        F.max(y).alias("max"),
        F.stddev_samp(y).alias("std"),
        F.count_if(F.col(y) == 0).alias("zero_windows"),
    )


def resample(df: DataFrame, step_seconds: int, keys: Sequence[str] = ("series_id",), y: str = "y", ts: str = "timestamp") -> DataFrame:
    """Coarser windows of an existing series: sum, mean, max, sample deviation."""
    return df.groupBy(*keys, floor_time(F.col(ts), step_seconds).alias(ts)).agg(
        F.sum(y).alias("total"), F.avg(y).alias("mean"), F.max(y).alias("max"), F.stddev_samp(y).alias("std")
    )


def hour_profile(df: DataFrame, keys: Sequence[str] = ("series_id",), y: str = "y", ts: str = "timestamp") -> DataFrame:
    rows = df.withColumn("hour", F.hour(ts))
    by = [*keys, "hour"]
    moments = rows.groupBy(*by).agg(
        F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"), F.min(y).alias("min"), F.max(y).alias("max")
    )
    return moments.join(quantiles(rows, by, y, {"median": 0.5}), on=by)


def top_hours(df: DataFrame, n: int = 5, y: str = "y", ts: str = "timestamp") -> DataFrame:
    means = df.groupBy(F.hour(ts).alias("hour")).agg(F.avg(y).alias("mean"))
    return means.orderBy(F.desc("mean"), "hour").limit(n)


def weekday_profile(df: DataFrame, keys: Sequence[str] = ("series_id",), y: str = "y", ts: str = "timestamp") -> DataFrame:
    return df.groupBy(*keys, day_of_week(F.col(ts)).alias("day_of_week")).agg(
        F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"), F.sum(y).alias("total")
    )


def heatmap(df: DataFrame, keys: Sequence[str] = ("series_id",), y: str = "y", ts: str = "timestamp") -> DataFrame:
    """Mean by weekday (rows) and hour (columns h0..h23)."""
    rows = df.select(*keys, day_of_week(F.col(ts)).alias("day_of_week"), F.hour(ts).alias("__h"), y)
    means = [F.avg(F.when(F.col("__h") == h, F.col(y))).alias(f"h{h}") for h in range(24)]
    return rows.groupBy(*keys, "day_of_week").agg(*means)


def weekend_effect(df: DataFrame, keys: Sequence[str] = ("series_id",), y: str = "y", ts: str = "timestamp") -> DataFrame:
    weekend = day_of_week(F.col(ts)) >= 5
    means = df.groupBy(*keys).agg(
        F.avg(F.when(~weekend, F.col(y))).alias("weekday_avg"), F.avg(F.when(weekend, F.col(y))).alias("weekend_avg")
    )
    return means.withColumn("drop_pct", (F.lit(1.0) - ratio(F.col("weekend_avg"), F.col("weekday_avg"))) * 100)


def histogram(df: DataFrame, col: str, bins: int, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Equal-width bins between the key's minimum and maximum; the last bin includes the maximum."""
    keys = list(keys)
    span = df.groupBy(*keys).agg(F.min(col).alias("__lo"), F.max(col).alias("__hi"))
    place = F.coalesce(F.floor(ratio((F.col(col) - F.col("__lo")) * bins, F.col("__hi") - F.col("__lo"))), F.lit(0))
    binned = df.join(span, on=keys).withColumn("bin", F.least(place, F.lit(bins - 1)).cast("int"))
    return binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))


def describe(df: DataFrame, keys: Sequence[str] = ("series_id",), y: str = "y") -> DataFrame:
    """Both deviations, since the two uses of this table differ: population (std) and sample (std_sample)."""
    keys = list(keys)
    moments = df.groupBy(*keys).agg(
        F.avg(y).alias("mean"),
        F.stddev_pop(y).alias("std"),
        F.stddev_samp(y).alias("std_sample"),
        F.min(y).alias("min"),
        F.max(y).alias("max"),
    )
    return moments.join(quantiles(df, keys, y, {**QUARTILES, "p95": 0.95}), on=keys)


def box_stats(
    df: DataFrame, unit: str, keys: Sequence[str] = ("series_id",), y: str = "y", ts: str = "timestamp", sketch_k: int | None = None
) -> DataFrame:
    """Quartiles by ``hour`` or ``day_of_week``; approximate ones with ``sketch_k``."""
    part = {"hour": F.hour(ts), "day_of_week": day_of_week(F.col(ts))}[unit]
    rows = df.withColumn(unit, part)
    return quantiles(rows, [*keys, unit], y, QUARTILES) if sketch_k is None else approximate_quantiles(rows, [*keys, unit], y, QUARTILES, sketch_k)


def host_entropy(rows: DataFrame, step_seconds: int, host: str = "host", ts: str = "timestamp", keys: Sequence[str] = ()) -> DataFrame:
    """Natural-log entropy of the host shares per window, over the log of the number of hosts."""
    by = [*keys, "timestamp"]
    counts = rows.groupBy(*keys, floor_time(F.col(ts), step_seconds).alias("timestamp"), host).agg(
        F.count(F.lit(1)).cast("double").alias("c")
    )
    # -sum(p ln p) = ln N - sum(c ln c) / N needs no second look at the window total.
    sums = counts.groupBy(*by).agg(
        F.sum("c").alias("__n"), F.sum(F.col("c") * F.log("c")).alias("__clogc"), F.count(F.lit(1)).alias("hosts")
    )
    raw = F.log("__n") - F.col("__clogc") / F.col("__n")
    return sums.select(
        *by,
        "hosts",
        raw.alias("entropy"),
        F.when(F.col("hosts") > 1, raw / F.log(F.col("hosts").cast("double"))).otherwise(0.0).alias("entropy_norm"),
    )


def bucket_means(df: DataFrame, step_seconds: int, max_points: int, keys: Sequence[str] = ("series_id",), y: str = "y", ts: str = "timestamp") -> DataFrame:
    """Average runs of n // max_points rows; the rest at the end forms its own bucket. Takes a regular grid."""
    keys = list(keys)
    ends = df.groupBy(*keys).agg(F.min(epoch_seconds(F.col(ts))).alias("__lo"), F.count(F.lit(1)).alias("__n"))
    position = (epoch_seconds(F.col(ts)) - F.col("__lo")) / F.lit(step_seconds)
    factor = F.greatest(F.floor(F.col("__n") / F.lit(max_points)), F.lit(1))
    factor = F.when(F.col("__n") <= max_points, F.lit(1)).otherwise(factor)
    return (
        df.join(ends, on=keys)
        .groupBy(*keys, F.floor(position / factor).cast("bigint").alias("bucket"))
        .agg(F.avg(y).alias("mean"))
    )


def bandwidth(df: DataFrame, keys: Sequence[str] = (), total: str = "bytes_total") -> DataFrame:
    return df.groupBy(*keys).agg(
        (F.sum(total) / F.lit(1e9)).alias("total_gb"),
        (F.avg(total) / F.lit(1e6)).alias("mean_mb"),
        (F.max(total) / F.lit(1e6)).alias("peak_mb"),
    )
