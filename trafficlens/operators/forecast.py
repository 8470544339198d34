"""Closed-form forecasts, intervals, splits, scaling and error metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.functions.values import epoch_seconds, from_epoch, ratio
from trafficlens.operators.scale import column_quantiles, quantiles

SID = ("series_id",)
# Interval factors per confidence level, and the baseline's shape.
Z = {0.80: 1.28, 0.90: 1.645, 0.95: 1.96, 0.99: 2.576}
BASE_ROWS, BASE_CYCLE, BASE_TREND, BASE_SWING, BASE_MIN_ROWS = 12, 12, 0.01, 0.1, 3
TAIL_LAGS = (1, 2, 3, 6, 12, 24, 48, 288)
TAIL_WINDOWS = (6, 12, 24)


def interval_factor(level: float) -> float:
    if level not in Z:
        raise ValueError(f"no interval for level {level}; known are {sorted(Z)}")
    return Z[level]


def last_rows(df: DataFrame, n: int, keys: Sequence[str] = SID, ts: str = "timestamp") -> DataFrame:
    """The last n rows per series with ``back`` = 1 for the latest. The group limit works before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(F.desc(ts))
    return df.withColumn("back", F.row_number().over(window)).where(F.col("back") <= n)


def future_grid(df: DataFrame, horizon: int, step_seconds: int, keys: Sequence[str] = SID, ts: str = "timestamp") -> DataFrame:
    """The next ``horizon`` timestamps after each series' last one, with ``step`` from 0."""
    ends = df.groupBy(*keys).agg(F.max(epoch_seconds(F.col(ts))).alias("__end"))
    steps = ends.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))))
    return steps.select(*keys, "step", from_epoch(F.col("__end") + (F.col("step") + 1) * F.lit(step_seconds)).alias(ts))


def moving_average(df: DataFrame, horizon: int, step_seconds: int, keys: Sequence[str] = SID, y: str = "y", ts: str = "timestamp") -> DataFrame:
    """Mean of the last 12 rows with a small trend and cycle; series below three rows are left out."""
    if horizon < 1:
        raise ValueError("horizon must be at least 1")
    recent = last_rows(df, BASE_ROWS, keys, ts).groupBy(*keys).agg(
        F.avg(y).alias("m"), F.stddev_pop(y).alias("s"), F.count(y).alias("n")
    ).where(F.col("n") >= BASE_MIN_ROWS)
    i = F.col("step")
    shape = 1 + F.lit(BASE_TREND) * i + F.lit(BASE_SWING) * ((i % BASE_CYCLE) - 6) / 6
    yhat = F.greatest(F.lit(0.0), F.col("m") * shape)
    return future_grid(df, horizon, step_seconds, keys, ts).join(recent, on=list(keys)).select(
        *keys, "step", ts, yhat.alias("yhat"),
        F.greatest(F.lit(0.0), yhat - F.lit(1.96) * F.col("s")).alias("lo"), (yhat + F.lit(1.96) * F.col("s")).alias("hi"),
    )


def seasonal_naive(df: DataFrame, horizon: int, step_seconds: int, period: int, cycles: int = 7, keys: Sequence[str] = SID, y: str = "y", ts: str = "timestamp") -> DataFrame:
    """Mean of the last values of the same phase; series shorter than a period get their mean. The phase runs on
    after the last row.
    """
    keys = list(keys)
    spans = df.groupBy(*keys).agg(
        F.min(epoch_seconds(F.col(ts))).alias("__lo"), F.count(F.lit(1)).alias("__n"), F.avg(y).alias("__mean")
    )

    def phase(at: Column) -> Column:
        return (((at - F.col("__lo")) / F.lit(step_seconds)) % period).cast("int")

    past = df.join(spans, on=keys).withColumn("phase", phase(epoch_seconds(F.col(ts))))
    means = last_rows(past, cycles, [*keys, "phase"], ts).groupBy(*keys, "phase").agg(F.avg(y).alias("__phase_mean"))
    ahead = future_grid(df, horizon, step_seconds, keys, ts).join(spans, on=keys).withColumn("phase", phase(epoch_seconds(F.col(ts))))
    yhat = F.when(F.col("__n") >= period, F.col("__phase_mean")).otherwise(F.col("__mean"))
    return ahead.join(means, on=[*keys, "phase"], how="left").select(*keys, "step", ts, yhat.alias("yhat"))


def with_interval(forecast: DataFrame, history: DataFrame, level: float = 0.95, rows: int = 288, keys: Sequence[str] = SID, y: str = "y", ts: str = "timestamp") -> DataFrame:
    """Bounds from the recent deviation, growing with the square root of the relative prediction."""
    keys = list(keys)
    spread = last_rows(history, rows, keys, ts).groupBy(*keys).agg(F.stddev_pop(y).alias("__s"))
    level_mean = forecast.groupBy(*keys).agg(F.avg(F.greatest(F.col("yhat"), F.lit(0.0))).alias("__m"))
    yhat = F.greatest(F.col("yhat"), F.lit(0.0))
    width = F.lit(interval_factor(level)) * F.col("__s") * F.sqrt(yhat / (F.col("__m") + 1e-6))
    out = forecast.join(spread, on=keys).join(level_mean, on=keys)
    return out.withColumns({"yhat": yhat, "lo": F.greatest(yhat - width, F.lit(0.0)), "hi": yhat + width}).drop("__s", "__m")


def ensemble(forecasts: DataFrame, history: DataFrame, level: float = 0.95, rows: int = 100, keys: Sequence[str] = SID, y: str = "y", ts: str = "timestamp") -> DataFrame:
    """Mean over models (at least two) with bounds from their spread and the recent deviation."""
    keys = list(keys)
    spread = last_rows(history, rows, keys, ts).groupBy(*keys).agg(F.stddev_pop(y).alias("__s"))
    both = forecasts.groupBy(*keys, ts).agg(
        F.avg("yhat").alias("yhat"), F.stddev_pop("yhat").alias("__m"), F.count(F.lit(1)).alias("models")
    ).where(F.col("models") >= 2)
    width = F.lit(interval_factor(level)) * F.sqrt(F.col("__m") * F.col("__m") + F.col("__s") * F.col("__s"))
    out = both.join(spread, on=keys)
    return out.withColumns({"lo": F.greatest(F.col("yhat") - width, F.lit(0.0)), "hi": F.col("yhat") + width}).drop("__m", "__s")


def hour_medians(df: DataFrame, keys: Sequence[str] = SID, y: str = "y", ts: str = "timestamp") -> DataFrame:
    return quantiles(df.withColumn("hour", F.hour(ts)), [*keys, "hour"], y, {"median": 0.5})


def future_features(
    df: DataFrame, horizon: int, step_seconds: int, lags: Sequence[int] = (1, 3, 6, 12, 60, 288), windows: Sequence[int] = (3, 12, 60),
    spans: Sequence[int] = (5, 15, 30), keys: Sequence[str] = SID, y: str = "y", ts: str = "timestamp",
) -> DataFrame:
    """Feature rows of the coming periods from hour-of-day medians, and the blend 0.7 seasonal + 0.3 recent.

    The medians of a series are one array of 24 values, so every looked-back value is an array access.
    """
    keys = list(keys)
    medians = hour_medians(df, keys, y, ts).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("hour", "median"))).alias("__byhour"))
    recent = last_rows(df, 12, keys, ts).groupBy(*keys).agg(F.avg(y).alias("__recent"))
    rows = future_grid(df, horizon, step_seconds, keys, ts).join(medians, on=keys).join(recent, on=keys)
    hour = F.hour(ts)
    by_hour = F.col("__byhour")
    fallback = F.col("__recent")

    def at_hour(h: Column) -> Column:
        return F.coalesce(F.try_element_at(by_hour, F.pmod(h, F.lit(24)).cast("int")), fallback)

    estimate = 0.7 * at_hour(hour) + 0.3 * F.col("__recent")
    rows = rows.withColumn("estimate", estimate)
    out = {}
    for k in lags:
        value = at_hour(F.hour(from_epoch(epoch_seconds(F.col(ts)) - F.lit(step_seconds * k))))
        out[f"lag_{k}"] = value
        out[f"diff_{k}"] = F.col("estimate") - value
        out[f"pct_change_{k}"] = F.coalesce(ratio(F.col("estimate") - value, F.when(value > 0, value)), F.lit(0.0))
    for n in windows:
        # Hours repeat every 24 places: count how often each of them falls into the window.
        weights = [n // 24 + (1 if i < n % 24 else 0) for i in range(min(n, 24))]
        values = [at_hour(hour - i) for i in range(min(n, 24))]
        mean = sum((v * w for v, w in zip(values[1:], weights[1:])), values[0] * weights[0]) / n
        square = sum((v * v * w for v, w in zip(values[1:], weights[1:])), values[0] * values[0] * weights[0]) / n
        out[f"rolling_mean_{n}"] = mean
        out[f"rolling_std_{n}"] = F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))
        if n <= 12:
            out[f"rolling_min_{n}"] = F.least(*values)
            out[f"rolling_max_{n}"] = F.greatest(*values)
    for span in spans:
        import math

        n = span * 2
        raw = [math.exp(-i / span) for i in range(n)]
        total = sum(raw)
        folded = [sum(raw[j] for j in range(i, n, 24)) / total for i in range(min(n, 24))]
        values = [at_hour(hour - i) for i in range(min(n, 24))]
        out[f"ewm_mean_{span}"] = sum((v * w for v, w in zip(values[1:], folded[1:])), values[0] * folded[0])
    return rows.withColumns(out).drop("__byhour", "__recent")


def trend_slope(df: DataFrame, rows: int = 288, keys: Sequence[str] = SID, y: str = "y", ts: str = "timestamp") -> DataFrame:
    """Least-squares slope over the last rows; 0 below ten of them."""
    recent = last_rows(df, rows, keys, ts)
    slope = F.regr_slope(F.col(y).cast("double"), -F.col("back").cast("double"))
    out = recent.groupBy(*keys).agg(F.count(y).alias("n"), slope.alias("__s"))
    return out.select(*keys, "n", F.when(F.col("n") >= 10, F.coalesce("__s", F.lit(0.0))).otherwise(0.0).alias("slope"))


def with_split(df: DataFrame, step_seconds: int, share: float = 0.2, keys: Sequence[str] = SID, ts: str = "timestamp") -> DataFrame:
    """Mark the last share of every regular series as ``validation``."""
    keys = list(keys)
    ends = df.groupBy(*keys).agg(F.min(epoch_seconds(F.col(ts))).alias("__lo"), F.count(F.lit(1)).alias("__n"))
    place = (epoch_seconds(F.col(ts)) - F.col("__lo")) / F.lit(step_seconds)
    cut = F.floor(F.col("__n") * F.lit(1 - share))
    return df.join(ends, on=keys).withColumn("split", F.when(place < cut, "train").otherwise("validation")).drop("__lo", "__n")


def robust_scale(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = SID, train: Column | None = None) -> DataFrame:
    """(x - median) / interquartile range of the training rows; a zero range counts as 1. One pass for all columns."""
    keys = list(keys)
    known = column_quantiles(df if train is None else df.where(train), keys, cols, {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    joined = df.join(known, on=keys, how="left")
    width = {c: F.col(f"{c}__q3") - F.col(f"{c}__q1") for c in cols}
    scaled = {f"{c}_scaled": (F.col(c) - F.col(f"{c}__q2")) / F.when(width[c] == 0, F.lit(1.0)).otherwise(width[c]) for c in cols}
    return joined.withColumns(scaled).drop(*[f"{c}__q{i}" for c in cols for i in (1, 2, 3)])


def median_fill(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = SID, train: Column | None = None) -> DataFrame:
    """Nulls become the training median of their column. One pass for all columns."""
    keys = list(keys)
    known = column_quantiles(df if train is None else df.where(train), keys, cols, {"q": 0.5})
    filled = {c: F.coalesce(F.col(c).cast("double"), F.col(f"{c}__q")) for c in cols}
    return df.join(known, on=keys, how="left").withColumns(filled).drop(*[f"{c}__q" for c in cols])


def mode_fill(df: DataFrame, numeric: Sequence[str], category: Sequence[str], keys: Sequence[str] = SID) -> DataFrame:
    """Numbers become 0, categories the most frequent value (the first of equals)."""
    keys = list(keys)
    out = df.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in numeric}) if numeric else df
    for c in category:
        counts = df.where(F.col(c).isNotNull()).groupBy(*keys, c).agg(F.count(F.lit(1)).alias("__n"))
        top = counts.groupBy(*keys).agg(F.min_by(c, F.struct(-F.col("__n"), F.col(c))).alias("__mode"))
        out = out.join(top, on=keys, how="left").withColumn(c, F.coalesce(F.col(c), F.col("__mode"))).drop("__mode")
    return out


def metrics(predictions: DataFrame, by: Sequence[str] = ("model",), y: str = "y", yhat: str = "yhat") -> DataFrame:
    """RMSE, MSE, MAE, MAPE, sMAPE and R2 in one aggregate."""
    a, p = F.col(y).cast("double"), F.col(yhat).cast("double")
    err = a - p
    share = F.when(F.abs(a) > 1e-10, F.abs(err / F.when(F.abs(a) > 1e-10, a)))
    sums = predictions.groupBy(*by).agg(
        F.avg(err * err).alias("mse"), F.avg(F.abs(err)).alias("mae"), (F.avg(share) * 100).alias("mape"),
        (F.avg(F.abs(err) / ((F.abs(a) + F.abs(p)) / 2 + 1e-10)) * 100).alias("smape"),
        F.var_pop(F.when(p.isNotNull(), a)).alias("__v"),
    )
    r2 = F.lit(1.0) - ratio(F.col("mse"), F.col("__v"))
    return sums.select(*by, F.sqrt("mse").alias("rmse"), "mse", "mae", "mape", "smape", r2.alias("r2"))


def compare_models(scores: DataFrame, by: Sequence[str] = ("granularity",)) -> DataFrame:
    """Rounded scores with the best model per group marked."""
    cols = ("rmse", "mse", "mae", "mape", "smape", "r2")
    best = scores.groupBy(*by).agg(F.min_by("model", F.struct("rmse", "model")).alias("best_model"))
    rounded = scores.withColumns({c: F.round(c, 4) for c in cols})
    return rounded.join(best, on=list(by)).withColumn("is_best", F.col("model") == F.col("best_model"))


def residual_points(predictions: DataFrame, by: Sequence[str], points: int = 20, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Residual quantiles for a Q-Q plot: (q, residual)."""
    rows = predictions.withColumn("resid", (F.col(y) - F.col(yhat)).cast("double"))
    probs = {f"q{i}": (i + 0.5) / points for i in range(points)}
    wide = quantiles(rows, by, "resid", probs)
    pairs = F.array(*[F.struct(F.lit(p).alias("q"), F.col(n).alias("residual")) for n, p in probs.items()])
    return wide.select(*by, F.explode(pairs).alias("p")).select(*by, "p.q", "p.residual")


def residual_interval(forecast: DataFrame, residuals: DataFrame, alpha: float = 0.05, keys: Sequence[str] = SID, resid: str = "resid") -> DataFrame:
    """Bounds from the validation residuals: the limit of resampling them."""
    q = quantiles(residuals, keys, resid, {"__lo": alpha / 2, "__hi": 1 - alpha / 2})
    out = forecast.join(q, on=list(keys))
    return out.withColumns({"lo": F.col("yhat") + F.col("__lo"), "hi": F.col("yhat") + F.col("__hi")}).drop("__lo", "__hi")


def simple_interval(forecast: DataFrame, keys: Sequence[str] = SID) -> DataFrame:
    """Bounds without residuals: 1.96 times a tenth of the deviation of the predictions."""
    spread = forecast.groupBy(*keys).agg((F.stddev_pop("yhat") * 0.1).alias("__s"))
    out = forecast.join(spread, on=list(keys))
    return out.withColumns({"lo": F.col("yhat") - 1.96 * F.col("__s"), "hi": F.col("yhat") + 1.96 * F.col("__s")}).drop("__s")


def split_ratios(scores: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Validation and test error relative to training, from scores with a ``split`` column."""
    def of(name: str) -> Column:
        return F.max(F.when(F.col("split") == name, F.col("rmse")))

    return scores.groupBy(*by).agg(
        of("train").alias("train_rmse"), of("validation").alias("validation_rmse"), of("test").alias("test_rmse"),
        ratio(of("validation"), of("train")).alias("validation_ratio"), ratio(of("test"), of("train")).alias("test_ratio"),
    )


def tail_features(df: DataFrame, keys: Sequence[str] = SID, y: str = "y", ts: str = "timestamp") -> DataFrame:
    """One row per series: last values at fixed lags (the latest one where history is short), and recent moments."""
    tail = last_rows(df, max(TAIL_LAGS), keys, ts)
    value = F.col(y).cast("double")
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))

    def back(k: int) -> Column:
        return F.max(F.when(F.col("back") == k, value))

    aggs = [back(k).alias(f"__l{k}") for k in TAIL_LAGS]
    for w in TAIL_WINDOWS:
        inside = F.when(F.col("back") <= w, value)
        aggs += [F.avg(inside).alias(f"__m{w}"), F.stddev_pop(inside).alias(f"__s{w}")]
    wide = tail.groupBy(*keys).agg(*aggs).join(n, on=list(keys))
    out = [F.when(F.col("__n") > k, F.col(f"__l{k}")).otherwise(F.col("__l1")).alias(f"lag_{k}") for k in TAIL_LAGS]
    for w in TAIL_WINDOWS:
        full = F.col("__n") >= w
        out += [
            F.when(full, F.col(f"__m{w}")).otherwise(F.col("__m")).alias(f"mean_{w}"),
            F.when(full, F.col(f"__s{w}")).otherwise(F.col("__s")).alias(f"std_{w}"),
        ]
    return wide.select(*keys, *out)
