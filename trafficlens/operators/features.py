"""Lag, rolling, exponentially weighted, trend and anomaly features of regular series.

All row-bounded features share one chunked window, so the series is shuffled once for all of them. Features whose
frame ends before the current row can feed a model; those that use the current row (differences, direction, streak,
trend, velocity) describe the row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from trafficlens.functions.values import epoch_seconds, ratio
from trafficlens.operators.scale import CHUNK, CHUNK_ROWS, halo, run_starts, running

# Default lags and windows per granularity in minutes.
LAGS = {1: (1, 5, 10, 30, 60, 1440), 5: (1, 3, 6, 12, 60, 288), 15: (1, 2, 4, 8, 24, 96)}
ROLLING = {1: (5, 15, 60), 5: (3, 12, 60), 15: (4, 16, 96)}
MIN_MAX_UP_TO = 12
EWM_SPANS = (5, 15, 30)
EWM_TOLERANCE = 1e-12

Columns = dict[str, Column]


def past(w: WindowSpec, rows: int) -> WindowSpec:
    return w.rowsBetween(-rows, -1)


def lag_columns(w: WindowSpec, y: str, lags: Sequence[int], name: str | None = None) -> Columns:
    name = name or y
    return {f"{name}_lag_{k}": F.lag(y, k).over(w) for k in lags}


def diff_columns(w: WindowSpec, y: str, lags: Sequence[int], name: str | None = None) -> Columns:
    name = name or y
    out = {}
    for k in lags:
        out[f"{name}_diff_{k}"] = F.col(y) - F.lag(y, k).over(w)
    for k in lags:
        base = F.lag(y, k).over(w)
        out[f"{name}_pct_change_{k}"] = ratio(F.col(y) - base, base)
    return out


def rolling_columns(w: WindowSpec, y: str, windows: Sequence[int], name: str | None = None) -> Columns:
    name = name or y
    out = {}
    for n in windows:
        frame = past(w, n)
        out[f"{name}_rolling_mean_{n}"] = F.avg(y).over(frame)
        out[f"{name}_rolling_std_{n}"] = F.stddev_samp(y).over(frame)
        if n <= MIN_MAX_UP_TO:
            low, high = F.min(y).over(frame), F.max(y).over(frame)
            out[f"{name}_rolling_min_{n}"] = low
            out[f"{name}_rolling_max_{n}"] = high
            out[f"{name}_rolling_range_{n}"] = high - low
    return out


def rolling_quantile_columns(w: WindowSpec, y: str, windows: Sequence[int], name: str | None = None) -> Columns:
    name = name or y
    out = {}
    for n in windows:
        frame = past(w, n)
        for label, p in (("median", 0.5), ("q25", 0.25), ("q75", 0.75)):
            out[f"{name}_rolling_{label}_{n}"] = F.percentile(y, F.lit(p)).over(frame)
        out[f"{name}_rolling_cv_{n}"] = ratio(F.stddev_samp(y).over(frame), F.avg(y).over(frame))
    return out


def spike_columns(w: WindowSpec, y: str, window: int = 15, threshold: float = 3.0) -> Columns:
    frame = past(w, window)
    score = F.coalesce(ratio(F.col(y) - F.avg(y).over(frame), F.stddev_samp(y).over(frame)), F.lit(0.0))
    return {
        "spike_score": score,
        "is_spike": (score > threshold).cast("int"),
        "is_dip": (score < -threshold).cast("int"),
        "spike_magnitude": F.greatest(F.lit(0.0), score - F.lit(threshold)),
    }


def volatility_columns(w: WindowSpec, y: str, window: int = 15, name: str | None = None) -> Columns:
    name = name or y
    frame = past(w, window)
    mean, std = F.avg(y).over(frame), F.stddev_samp(y).over(frame)
    return {
        f"{name}_cv": F.coalesce(ratio(std, mean), F.lit(0.0)),
        f"{name}_bb_upper": mean + 2 * std,
        f"{name}_bb_lower": mean - 2 * std,
        f"{name}_bb_width": (mean + 2 * std) - (mean - 2 * std),
    }


def trend_columns(w: WindowSpec, y: str, periods_per_day: int, window: int = 15, name: str | None = None) -> Columns:
    name = name or y
    diff = F.col(y) - F.lag(y, 1).over(w)
    yesterday = F.lag(y, periods_per_day).over(w)
    place = F.row_number().over(w)
    return {
        f"{name}_diff_1": diff,
        f"{name}_direction": F.signum(diff.cast("double")),
        "__place": place.cast("double"),
        f"{name}_vs_yesterday": F.col(y) - yesterday,
        f"{name}_vs_yesterday_pct": ratio(F.col(y) - yesterday, yesterday),
    }


def slope_column(w: WindowSpec, y: str, window: int = 15, name: str | None = None) -> Columns:
    """Least-squares slope over the last rows, the current one included; needs ``__place`` from ``trend_columns``."""
    name = name or y
    return {f"{name}_trend": F.regr_slope(F.col(y).cast("double"), F.col("__place")).over(w.rowsBetween(1 - window, 0))}


def rate_columns(w: WindowSpec, y: str, name: str | None = None) -> Columns:
    name = name or y
    last, before = F.lag(y, 1).over(w), F.lag(y, 2).over(w)
    # The sum of the last five velocities telescopes; near the start it reaches back to the first row.
    oldest = F.first(y).over(w.rowsBetween(-5, 0))
    return {
        f"{name}_velocity": F.col(y) - last,
        f"{name}_acceleration": (F.col(y) - last) - (last - before),
        f"{name}_momentum": F.when(last.isNotNull(), F.col(y) - oldest),
    }


def zscore_columns(w: WindowSpec, y: str, window: int = 60) -> Columns:
    """z-score against the previous rows; a zero deviation counts as 1."""
    frame = past(w, window)
    std = F.stddev_samp(y).over(frame)
    z = (F.col(y) - F.avg(y).over(frame)) / F.when(std == 0, F.lit(1.0)).otherwise(std)
    return {
        "is_anomaly_ml": F.coalesce((F.abs(z) > 3).cast("int"), F.lit(0)),
        "anomaly_score_ml": F.abs(z) / 3,
    }


def agreement(df: DataFrame) -> DataFrame:
    both = (F.col("is_spike") == 1) & (F.col("is_anomaly_ml") == 1)
    return df.withColumn("anomaly_agreement", both.cast("int"))


def streaks(
    df: DataFrame, keys: Sequence[str], step_seconds: int, y: str = "y", ts: str = "timestamp", name: str | None = None, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Signed length of the current run of rises or falls; 0 in flat runs."""
    name = name or y
    moved = halo(
        df, keys, ts, step_seconds,
        lambda w: {"__dir": F.signum((F.col(y) - F.lag(y, 1).over(w)).cast("double"))}, back=1, chunk_rows=chunk_rows,
    )
    marked = run_starts(moved, keys, ts, step_seconds, "__dir", chunk_rows)
    length = (epoch_seconds(F.col(ts)) - F.col("run_start")) / F.lit(step_seconds) + 1
    return marked.withColumn(f"{name}_streak", F.col("__dir") * length).drop("__dir", "run_start")


def pct_of_max(
    df: DataFrame, keys: Sequence[str], step_seconds: int, y: str = "y", ts: str = "timestamp", name: str | None = None, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Share of the highest earlier value."""
    name = name or y
    seen = running(df, keys, ts, step_seconds, {"__peak": ("max_before", y)}, chunk_rows)
    return seen.withColumn(f"{name}_pct_of_max", F.coalesce(ratio(F.col(y), F.col("__peak")), F.lit(0.0))).drop("__peak")


def ewm_reach(span: int) -> int:
    """Rows after which a weight falls below the tolerance."""
    return math.ceil(math.log(EWM_TOLERANCE) / math.log(1 - 2 / (span + 1)))


def ewm(
    df: DataFrame, keys: Sequence[str], step_seconds: int, y: str = "y", ts: str = "timestamp",
    spans: Sequence[int] = EWM_SPANS, name: str | None = None,
) -> DataFrame:
    """Exponentially weighted mean and bias-corrected deviation of the earlier rows.

    With r = 1 - alpha, a weight r^(t-j) splits into r^t and r^-j, so the weighted sums are plain running sums inside
    a chunk: one addition per row and span. Chunks are short enough for r^-j to stay a finite double.
    """
    name = name or y
    if min(spans) < 2:
        raise ValueError("spans below 2 leave no earlier weight")
    reach = max(ewm_reach(s) for s in spans)
    room = int(600 / -math.log(1 - 2 / (min(spans) + 1)))
    if len(spans) > 1 and 2 * reach > room:
        for span in spans:
            df = ewm(df, keys, step_seconds, y, ts, [span], name)
        return df

    def anchors(w: WindowSpec) -> Columns:
        whole = Window.partitionBy(*keys, CHUNK)
        first = F.min(epoch_seconds(F.col(ts))).over(whole)
        place = (epoch_seconds(F.col(ts)) - first) / F.lit(step_seconds) - F.lit(room / 2)
        return {"__place": place, "__shift": F.avg(y).over(whole)}

    def weighted(w: WindowSpec) -> Columns:
        earlier = w.rowsBetween(Window.unboundedPreceding, -1)
        x = F.col(y).cast("double") - F.col("__shift")
        now = F.col("__place") - 1
        out = {"__seen": F.count(y).over(earlier)}
        for span in spans:
            r = 1 - 2 / (span + 1)
            grow = F.when(F.col(y).isNotNull(), F.pow(F.lit(r), -F.col("__place")))
            shrink = F.pow(F.lit(r), now)
            out[f"__w_{span}"] = F.sum(grow).over(earlier) * shrink
            out[f"__w2_{span}"] = F.sum(grow * grow).over(earlier) * shrink * shrink
            out[f"__wx_{span}"] = F.sum(grow * x).over(earlier) * shrink
            out[f"__wxx_{span}"] = F.sum(grow * x * x).over(earlier) * shrink
        return out

    rows = halo(df, keys, ts, step_seconds, anchors, back=reach, chunk_rows=room - reach, then=weighted)
    final = {}
    for span in spans:
        w, w2, wx, wxx = (F.col(f"__{k}_{span}") for k in ("w", "w2", "wx", "wxx"))
        mean = F.try_divide(wx, w)
        variance = F.greatest(F.try_divide(wxx, w) - mean * mean, F.lit(0.0))
        unbias = F.when(F.col("__seen") > 1, F.try_divide(w * w, w * w - w2))
        final[f"{name}_ewm_mean_{span}"] = mean + F.col("__shift")
        final[f"{name}_ewm_std_{span}"] = F.sqrt(variance * unbias)
    helper = [f"__{k}_{s}" for s in spans for k in ("w", "w2", "wx", "wxx")]
    return rows.withColumns(final).drop("__place", "__shift", "__seen", *helper)


def event_features(df: DataFrame, calendar: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Look up each row's date in an event calendar (date, type, name, impact).

    The calendar has one row per special date. It is broadcast by the planner when its size allows.
    """
    days = calendar.select(
        F.col("date").alias("__date"),
        F.col("type").alias("event_type"),
        F.col("impact").alias("event_impact"),
        F.col("name").alias("event_name"),
        F.lit(1).alias("is_special_event"),
    )
    joined = df.withColumn("__day", F.to_date(ts)).join(days, F.col("__day") == F.col("__date"), "left")
    return joined.withColumns(
        {
            "event_type": F.coalesce("event_type", F.lit(0)),
            "is_special_event": F.coalesce("is_special_event", F.lit(0)),
            "event_impact": F.coalesce("event_impact", F.lit("normal")),
            "event_name": F.coalesce("event_name", F.lit("")),
        }
    ).drop("__day", "__date")


def estimated_metadata(df: DataFrame, y: str = "y") -> DataFrame:
    """Stand-ins for the log measures when only a load is known."""
    load = F.col(y)
    hosts = F.greatest(F.lit(1).cast("bigint"), F.floor(load * 0.7).cast("bigint"))
    errors = F.greatest(F.lit(0).cast("bigint"), F.floor(load * 0.02).cast("bigint"))
    divisor = F.greatest(F.lit(1.0), load.cast("double"))
    return df.withColumns(
        {
            "unique_hosts": hosts,
            "error_count": errors,
            "error_rate": errors / divisor,
            "success_rate": 1 - errors / divisor,
            "bytes_total": load * 5000,
            "bytes_avg": F.lit(5000),
            "bytes_max": F.lit(50000),
            "requests_per_host": load / F.greatest(F.lit(1).cast("bigint"), hosts),
            "bytes_per_request": load * 5000 / divisor,
        }
    )


def select_features(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Model columns in the given order: missing ones 0, no NaN or infinity."""
    out = []
    for name in names:
        if name in df.columns:
            value = F.col(name).cast("double")
            odd = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
            out.append(F.when(odd, F.lit(0.0)).otherwise(value).alias(name))
        else:
            out.append(F.lit(0.0).alias(name))
    return df.select(*keep, *out)


def scenario(
    df: DataFrame, step_seconds: int, multiplier: float, spike_position: float | None = None, spike_magnitude: float = 1.0,
    keys: Sequence[str] = ("series_id",), y: str = "y", ts: str = "timestamp",
) -> DataFrame:
    """Scaled load with an optional spike of n/20 rows around a relative position."""
    keys = list(keys)
    ends = df.groupBy(*keys).agg(F.min(epoch_seconds(F.col(ts))).alias("__lo"), F.count(F.lit(1)).alias("__n"))
    place = ((epoch_seconds(F.col(ts)) - F.col("__lo")) / F.lit(step_seconds)).cast("bigint")
    value = F.col(y) * F.lit(float(multiplier))
    if spike_position is not None:
        center = F.floor(F.col("__n") * F.lit(float(spike_position)))
        width = F.greatest(F.lit(1), F.floor(F.col("__n") / 20))
        half = F.floor(width / 2)
        inside = (place >= F.greatest(F.lit(0), center - half)) & (place < F.least(F.col("__n"), center + half))
        value = F.when(inside, value * F.lit(float(spike_magnitude))).otherwise(value)
    return df.join(ends, on=keys).withColumn("scenario", value).drop("__lo", "__n")


def traffic_features(
    df: DataFrame, keys: Sequence[str] = ("series_id",), step_seconds: int = 300, y: str = "y", ts: str = "timestamp",
    name: str = "request_count", lags: Sequence[int] | None = None, windows: Sequence[int] | None = None,
    calendar: DataFrame | None = None, extended: bool = False,
) -> DataFrame:
    """The whole feature table of a filled series: calendar, lags, rolling, weighted, trend, volatility, rates, events."""
    from trafficlens.functions.calendar import with_calendar

    minutes = max(1, step_seconds // 60)
    nearest = min(LAGS, key=lambda m: abs(m - minutes))
    lags, windows = lags or LAGS[nearest], windows or ROLLING[nearest]
    day = 86400 // step_seconds

    def build(w: WindowSpec) -> Columns:
        out = {**lag_columns(w, y, lags, name), **diff_columns(w, y, lags, name), **rolling_columns(w, y, windows, name)}
        if extended:
            out.update(rolling_quantile_columns(w, y, windows, name))
        out.update(spike_columns(w, y))
        out.update(trend_columns(w, y, day, name=name))
        out.update(volatility_columns(w, y, name=name))
        out.update(rate_columns(w, y, name))
        out.update(zscore_columns(w, y))
        return out

    reach = max(*lags, *windows, day, 60)
    rows = halo(df, keys, ts, step_seconds, build, back=reach, then=lambda w: slope_column(w, y, name=name)).drop("__place")
    rows = agreement(rows)
    rows = pct_of_max(rows, keys, step_seconds, y, ts, name)
    rows = streaks(rows, keys, step_seconds, y, ts, name)
    rows = ewm(rows, keys, step_seconds, y, ts, name=name)
    rows = with_calendar(rows, ts)
    return event_features(rows, calendar, ts) if calendar is not None else rows
