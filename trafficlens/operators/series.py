"""Log rows to regular time series, and the fills for empty windows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.functions.values import epoch_seconds, floor_time, from_epoch, ratio_or_zero
from trafficlens.operators.scale import CHUNK_ROWS, running, whole_rows, with_known

COUNTS = ("request_count", "unique_hosts", "error_count", "bytes_total")
AVERAGES = ("error_rate", "success_rate", "bytes_avg", "bytes_max")
FILLS = ("zero", "ffill", "interpolate", "none")


@dataclass(frozen=True)
class SeriesSpec:
    """What to measure per window."""

    step_seconds: int = 300
    fill: str = "zero"
    hosts: bool = True
    errors: bool = True
    sizes: bool = True
    approximate_hosts: bool = False

    def __post_init__(self):
        if self.step_seconds < 1:
            raise ValueError("step_seconds must be positive")
        if self.fill not in FILLS:
            raise ValueError(f"fill must be one of {FILLS}")


def _measures(rows: DataFrame, spec: SeriesSpec) -> list:
    out = [F.count(F.lit(1)).alias("request_count")]
    if spec.hosts:
        distinct = F.approx_count_distinct if spec.approximate_hosts else F.count_distinct
        out.append(distinct("host").alias("unique_hosts"))
    if spec.errors and "is_error" in rows.columns:
        flag = F.col("is_error").cast("int")
        out += [F.sum(flag).alias("error_count"), F.avg(flag).alias("error_rate")]
    if spec.errors and "is_success" in rows.columns:
        out.append(F.avg(F.col("is_success").cast("int")).alias("success_rate"))
    if spec.sizes and "bytes" in rows.columns:
        out += [F.sum("bytes").alias("bytes_total"), F.avg("bytes").alias("bytes_avg"), F.max("bytes").alias("bytes_max")]
    return out


def window_counts(rows: DataFrame, spec: SeriesSpec, keys: Sequence[str] = (), ts: str = "timestamp") -> DataFrame:
    """Measures of every window that has rows."""
    start = floor_time(F.col(ts), spec.step_seconds)
    return rows.groupBy(*keys, start.alias("timestamp")).agg(*_measures(rows, spec))


def time_grid(df: DataFrame, keys: Sequence[str], step_seconds: int | Column, ts: str = "timestamp") -> DataFrame:
    """Every window start from the first to the last one of each series. The step may be a column of the keys.

    The span is cut into blocks first and each block expanded, so no single row holds a whole long series.
    """
    step = (step_seconds if isinstance(step_seconds, Column) else F.lit(step_seconds)).cast("bigint")
    ends = df.groupBy(*keys).agg(F.min(epoch_seconds(F.col(ts))).alias("__lo"), F.max(epoch_seconds(F.col(ts))).alias("__hi"))
    blocks = ends.withColumn("__from", F.explode(F.sequence("__lo", "__hi", step * 4096)))
    steps = F.sequence("__from", F.least(F.col("__hi"), F.col("__from") + step * 4095), step)
    return blocks.select(*keys, F.explode(steps).alias("__at")).select(*keys, from_epoch(F.col("__at")).alias(ts))


def fill_grid(df: DataFrame, keys: Sequence[str], step_seconds: int | Column, ts: str = "timestamp") -> DataFrame:
    """Left join of the measures to the full grid. Rows without a key or a time belong to no series."""
    known = with_known(df, [*keys, ts])
    return time_grid(whole_rows(known), keys, step_seconds, ts).join(known, on=[*keys, ts], how="left")


def zero_fill(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in cols})


def forward_fill(df: DataFrame, keys: Sequence[str], cols: Sequence[str], step_seconds: int, ts: str = "timestamp", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    filled = running(df, keys, ts, step_seconds, {f"__f_{c}": ("last", c) for c in cols}, chunk_rows)
    return filled.withColumns({c: F.col(f"__f_{c}") for c in cols}).drop(*[f"__f_{c}" for c in cols])


def backward_fill(df: DataFrame, keys: Sequence[str], cols: Sequence[str], step_seconds: int, ts: str = "timestamp", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Takes values from later rows: not for training data."""
    filled = running(df, keys, ts, step_seconds, {f"__f_{c}": ("next", c) for c in cols}, chunk_rows)
    return filled.withColumns({c: F.col(f"__f_{c}") for c in cols}).drop(*[f"__f_{c}" for c in cols])


def interpolate(df: DataFrame, keys: Sequence[str], cols: Sequence[str], step_seconds: int, ts: str = "timestamp", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Linear between known values; the tail keeps the last one, the head stays null."""
    known = {f"__p_{c}": F.when(F.col(c).isNotNull(), F.struct(F.col(c).cast("double").alias("v"), epoch_seconds(F.col(ts)).alias("t"))) for c in cols}
    marks = df.withColumns(known)
    wanted = {}
    for c in cols:
        wanted[f"__l_{c}"] = ("last", f"__p_{c}")
        wanted[f"__n_{c}"] = ("next", f"__p_{c}")
    near = running(marks, keys, ts, step_seconds, wanted, chunk_rows)
    now = epoch_seconds(F.col(ts))
    out = {}
    for c in cols:
        left, right = F.col(f"__l_{c}"), F.col(f"__n_{c}")
        slope = F.try_divide(right["v"] - left["v"], right["t"] - left["t"])
        out[c] = F.when(F.col(c).isNotNull(), F.col(c).cast("double")).otherwise(
            left["v"] + F.coalesce(slope * (now - left["t"]), F.lit(0.0))
        )
    return near.withColumns(out).drop(*known, *wanted)


def with_ratios(df: DataFrame) -> DataFrame:
    """Requests per host and bytes per request; 0 where there is nothing to divide by."""
    out = {}
    if "unique_hosts" in df.columns:
        out["requests_per_host"] = ratio_or_zero(F.col("request_count"), F.col("unique_hosts"))
    if "bytes_total" in df.columns:
        out["bytes_per_request"] = ratio_or_zero(F.col("bytes_total"), F.col("request_count"))
    return df.withColumns(out) if out else df


def traffic_series(rows: DataFrame, spec: SeriesSpec | None = None, keys: Sequence[str] = (), ts: str = "timestamp") -> DataFrame:
    """Windows, grid, fill and ratios. Counts and sums of an empty window are 0 under every fill; the fill method
    decides the averages and the maximum.
    """
    spec = spec or SeriesSpec()
    anchor = list(keys) or ["__all"]
    base = rows if keys else rows.withColumn("__all", F.lit(0))
    filled = fill_grid(window_counts(base, spec, anchor, ts), anchor, spec.step_seconds)
    filled = zero_fill(filled, [c for c in COUNTS if c in filled.columns])
    soft = [c for c in AVERAGES if c in filled.columns]
    if spec.fill == "zero":
        filled = zero_fill(filled, soft)
    elif spec.fill == "ffill" and soft:
        filled = forward_fill(filled, anchor, soft, spec.step_seconds)
    elif spec.fill == "interpolate" and soft:
        filled = interpolate(filled, anchor, soft, spec.step_seconds)
    out = with_ratios(filled)
    return out if keys else out.drop("__all")


def multi_series(rows: DataFrame, steps: Sequence[int] = (60, 300, 900), spec: SeriesSpec | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Several window lengths side by side, told apart by ``granularity`` (minutes).

    The rows are read and shuffled once, reduced to (host, shortest window); every length is then built from that.
    """
    spec = spec or SeriesSpec()
    base_step = math.gcd(*steps)
    sums = [F.count(F.lit(1)).alias("__n")]
    flags = [c for c in ("is_error", "is_success") if spec.errors and c in rows.columns]
    sums += [F.sum(F.col(c).cast("int")).alias(f"__{c}") for c in flags]
    sizes = spec.sizes and "bytes" in rows.columns
    if sizes:
        sums += [F.sum("bytes").alias("__sum"), F.max("bytes").alias("__max")]
    fine = rows.groupBy(*keys, "host", floor_time(F.col("timestamp"), base_step).alias("__t")).agg(*sums)
    spread = fine.withColumn("granularity", F.explode(F.array(*[F.lit(s // 60) for s in steps])))
    length = F.col("granularity") * F.lit(60)
    start = from_epoch(F.floor(epoch_seconds(F.col("__t")) / length) * length)
    n = F.sum("__n")
    measures = [n.alias("request_count")]
    if spec.hosts:
        distinct = F.approx_count_distinct if spec.approximate_hosts else F.count_distinct
        measures.append(distinct("host").alias("unique_hosts"))
    if "is_error" in flags:
        measures += [F.sum("__is_error").alias("error_count"), (F.sum("__is_error") / n).alias("error_rate")]
    if "is_success" in flags:
        measures.append((F.sum("__is_success") / n).alias("success_rate"))
    if sizes:
        measures += [F.sum("__sum").alias("bytes_total"), (F.sum("__sum") / n).alias("bytes_avg"), F.max("__max").alias("bytes_max")]
    by = [*keys, "granularity"]
    counted = spread.groupBy(*by, start.alias("timestamp")).agg(*measures)
    filled = fill_grid(counted, by, length)
    filled = zero_fill(filled, [c for c in COUNTS if c in filled.columns])
    soft = [c for c in AVERAGES if c in filled.columns]
    if spec.fill == "zero":
        filled = zero_fill(filled, soft)
    elif spec.fill in ("ffill", "interpolate") and soft:
        fill = forward_fill if spec.fill == "ffill" else interpolate
        filled = fill(filled, by, soft, base_step)
    return with_ratios(filled)


def event_counts(rows: DataFrame, keys: Sequence[str], step_seconds: int, ts: str, total: str | None = None) -> DataFrame:
    """Zero-filled counts ``y`` per key and window; ``total`` names an extra series over all keys (one key only)."""
    counts = rows.groupBy(*keys, floor_time(F.col(ts), step_seconds).alias("timestamp")).agg(F.count(F.lit(1)).alias("y"))
    if total is not None:
        (key,) = keys
        both = counts.withColumn(key, F.explode(F.array(F.col(key), F.lit(total))))
        counts = both.groupBy(key, "timestamp").agg(F.sum("y").alias("y"))
    return zero_fill(fill_grid(counts, keys, step_seconds), ["y"])
