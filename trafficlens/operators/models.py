"""Trained forecasters: boosted trees and random forests on lag features, and an additive seasonal regression."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.functions import calendar as cal
from trafficlens.functions.values import epoch_seconds
from trafficlens.operators.features import lag_columns, rolling_columns
from trafficlens.operators.forecast import metrics
from trafficlens.operators.scale import CHUNK, chunk_of, halo
from trafficlens.session import cut_lineage

SID = ("series_id",)
LAGS = (1, 2, 3, 24)
WINDOWS = (3, 12, 24)


def training_table(
    df: DataFrame, step_seconds: int, lags: Sequence[int] = LAGS, windows: Sequence[int] = WINDOWS,
    keys: Sequence[str] = SID, y: str = "y", ts: str = "timestamp",
) -> tuple[DataFrame, list[str]]:
    """Features known before each row (lags, rolling statistics of earlier rows, calendar), without incomplete rows.

    Written to the shared folder: tree learners read their input many times, and would redo the windows each time.
    """
    def build(w):
        return {**lag_columns(w, y, lags), **rolling_columns(w, y, windows)}

    rows = halo(df, keys, ts, step_seconds, build, back=max(*lags, *windows))
    stamps = {**cal.parts(F.col(ts)), **cal.flags(F.col(ts)), **cal.cycles(F.col(ts))}
    names = [c for c in rows.columns if c.startswith(f"{y}_")] + ["hour", "day_of_week", *cal.flags(F.col(ts)), *cal.cycles(F.col(ts))]
    out = rows.withColumns(stamps)
    return cut_lineage(df.sparkSession, out.dropna(subset=names), "training"), names


def with_place(df: DataFrame, step_seconds: int, keys: Sequence[str] = SID, ts: str = "timestamp") -> DataFrame:
    """Row position and count per regular series."""
    ends = df.groupBy(*keys).agg(F.min(epoch_seconds(F.col(ts))).alias("__lo"), F.count(F.lit(1)).alias("n_rows"))
    place = ((epoch_seconds(F.col(ts)) - F.col("__lo")) / F.lit(step_seconds)).cast("bigint")
    return df.join(ends, on=list(keys)).withColumn("place", place).drop("__lo")


@dataclass
class TreeModel:
    """A fitted tree ensemble with its feature names."""

    model: object
    features: list[str]

    def predict(self, df: DataFrame) -> DataFrame:
        """Add ``yhat``, never negative."""
        scored = self.model.transform(_vectors(df, self.features))
        return scored.withColumn("yhat", F.greatest(F.col("prediction"), F.lit(0.0))).drop("prediction", "__features")

    def importance(self, df: DataFrame) -> DataFrame:
        values = self.model.featureImportances.toArray()
        rows = [(name, float(v)) for name, v in zip(self.features, values)]
        return df.sparkSession.createDataFrame(rows, "feature string, importance double")

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)


def load_boosted(path: str, features: list[str]) -> TreeModel:
    return TreeModel(GBTRegressionModel.load(path), features)


def _vectors(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="__features", handleInvalid="keep").transform(df)


def fit_boosted(train: DataFrame, features: list[str], y: str = "y", validation: str | None = None, params: dict | None = None) -> TreeModel:
    """Gradient-boosted trees; a boolean ``validation`` column stops the boosting early."""
    settings = {"maxIter": 20, "maxDepth": 5, "stepSize": 0.1, "seed": 42, **(params or {})}
    learner = GBTRegressor(featuresCol="__features", labelCol=y, **settings)
    if validation:
        learner = learner.setValidationIndicatorCol(validation)
    return TreeModel(learner.fit(_vectors(train, features)), features)


def fit_forest(train: DataFrame, features: list[str], y: str = "y", trees: int = 100, depth: int = 10, seed: int = 42) -> TreeModel:
    learner = RandomForestRegressor(featuresCol="__features", labelCol=y, numTrees=trees, maxDepth=depth, seed=seed)
    return TreeModel(learner.fit(_vectors(train, features)), features)


def rolling_origin(df: DataFrame, fold: int, folds: int, gap: int) -> DataFrame:
    """Rows of one fold with ``part``: an expanding training span, a gap, then an equal share of the rows. Needs ``place``."""
    size = F.floor(F.col("n_rows") / (folds + 1))
    begin = F.col("n_rows") - (folds - fold) * size
    place = F.col("place")
    part = F.when(place < begin - gap, "train").when((place >= begin) & (place < begin + size), "validation")
    return df.withColumn("part", part).where(F.col("part").isNotNull())


FITS_AT_ONCE = 4


def _fold_predictions(
    df: DataFrame, features: list[str], step_seconds: int, runs: Sequence[tuple[str, dict]], folds: int, gap: int, keys: Sequence[str], y: str,
    use: Sequence[int] | None, parallelism: int,
) -> DataFrame:
    """Validation rows with (params, fold, y, yhat) of every run and fold; fits run side by side, each a distributed job."""
    placed = with_place(df, step_seconds, keys)
    tasks = [(label, params, fold) for label, params in runs for fold in (use if use is not None else range(folds))]

    def predict(task: tuple[str, dict, int]) -> DataFrame:
        label, params, fold = task
        rows = rolling_origin(placed, fold, folds, gap)
        model = fit_boosted(rows.where(F.col("part") == "train"), features, y, params=params)
        scored = model.predict(rows.where(F.col("part") == "validation"))
        return scored.select(F.lit(label).alias("params"), F.lit(fold).alias("fold"), y, "yhat")

    with ThreadPool(min(parallelism, len(tasks))) as pool:
        parts = pool.map(inheritable_thread_target(df.sparkSession)(predict), tasks)
    return reduce(DataFrame.unionByName, parts)


def cross_validate(
    df: DataFrame, features: list[str], step_seconds: int, folds: int = 5, gap: int = 12, keys: Sequence[str] = SID, y: str = "y",
    params: dict | None = None, use: Sequence[int] | None = None, parallelism: int = FITS_AT_ONCE,
) -> DataFrame:
    """Error per fold: the folds are a column, their models are fitted ``parallelism`` at a time."""
    found = _fold_predictions(df, features, step_seconds, [("", params or {})], folds, gap, keys, y, use, parallelism)
    return metrics(found, ("fold",), y)


def summarize_folds(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    cols = ("rmse", "mae", "mape")
    return scores.groupBy(*by).agg(
        *[F.avg(c).alias(f"{c}_mean") for c in cols], *[F.stddev_pop(c).alias(f"{c}_std") for c in cols]
    )


def search(
    df: DataFrame, features: list[str], step_seconds: int, grid: dict[str, Sequence], folds: int = 5, gap: int = 12,
    use: Sequence[int] | None = None, keys: Sequence[str] = SID, y: str = "y", parallelism: int = FITS_AT_ONCE,
) -> DataFrame:
    """Mean and deviation of the errors over the folds for every combination of the grid, with its ``place`` by mean RMSE."""
    learner = GBTRegressor()
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(getattr(learner, name), list(values))
    runs = []
    for combo in builder.build():
        params = {p.name: v for p, v in combo.items()}
        runs.append((",".join(f"{k}={v}" for k, v in sorted(params.items())), params))
    found = _fold_predictions(df, features, step_seconds, runs, folds, gap, keys, y, use, parallelism)
    scores = summarize_folds(metrics(found, ("params", "fold"), y), ("params",))
    return scores.withColumn("place", F.row_number().over(Window.orderBy("rmse_mean", "params")))  # a row per combination


@dataclass(frozen=True)
class SeasonalSpec:
    """Shape of the additive model: trend knots and Fourier orders."""

    knots: int = 10
    weekly: int = 3
    daily: int = 4
    ridge: float = 1.0
    span: float = 0.8
    periods: dict = field(default_factory=lambda: {"weekly": 7 * 86400, "daily": 86400})

    def waves(self, at: Column, name: str) -> list[Column]:
        order = getattr(self, name)
        angle = at * F.lit(2 * math.pi / self.periods[name])
        return [f(angle * k) for k in range(1, order + 1) for f in (F.sin, F.cos)]

    def trend(self, place: Column) -> list[Column]:
        """Constant, slope, and a bend at each knot of the first part of the history; ``place`` runs from 0 to 1."""
        bends = [F.greatest(place - F.lit(self.span * (i + 1) / (self.knots + 1)), F.lit(0.0)) for i in range(self.knots)]
        return [F.lit(1.0), place, *bends]

    def blocks(self) -> dict[str, tuple[int, int]]:
        first = 2 + self.knots
        return {"trend": (0, first), "weekly": (first, first + 2 * self.weekly), "daily": (first + 2 * self.weekly, first + 2 * self.weekly + 2 * self.daily)}

    def design(self, at: Column, place: Column) -> list[Column]:
        return [*self.trend(place), *self.waves(at, "weekly"), *self.waves(at, "daily")]


def fit_seasonal(df: DataFrame, step_seconds: int, spec: SeasonalSpec | None = None, keys: Sequence[str] = SID, y: str = "y", ts: str = "timestamp") -> DataFrame:
    """One row of coefficients per series.

    Every chunk of rows is reduced to its cross products in parallel; the products are added per series and one small
    ridge system is solved for each.
    """
    spec = spec or SeasonalSpec()
    keys = list(keys)
    ends = df.groupBy(*keys).agg(F.min(epoch_seconds(F.col(ts))).alias("t0"), F.max(epoch_seconds(F.col(ts))).alias("t1"))
    at = epoch_seconds(F.col(ts)).cast("double")
    width = F.greatest(F.col("t1") - F.col("t0"), F.lit(1))
    rows = df.join(ends, on=keys).select(
        *keys, chunk_of(F.col(ts), step_seconds).alias(CHUNK),
        F.array(*spec.design(at, (at - F.col("t0")) / width)).alias("x"), F.col(y).cast("double").alias("y"),
    )
    size = spec.blocks()["daily"][1]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["x"].to_numpy())
        joined = np.column_stack([x, pdf["y"].to_numpy()])
        flat = (joined.T @ joined).reshape(-1)
        out = pd.DataFrame({"cell": np.arange(len(flat)), "value": flat})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out

    parts = rows.groupBy(*keys, CHUNK).applyInPandas(products, f"{fields}, cell int, value double")
    cells = parts.groupBy(*keys, "cell").agg(F.sum("value").alias("value"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.sort_values("cell")["value"].to_numpy().reshape(size + 1, size + 1)
        penalty = np.eye(size) * spec.ridge
        penalty[0, 0] = 0.0
        beta = np.linalg.solve(m[:size, :size] + penalty, m[:size, size])
        out = {k: [pdf[k].iloc[0]] for k in keys}
        return pd.DataFrame({**out, "beta": [beta.tolist()]})

    solved = cells.groupBy(*keys).applyInPandas(solve, f"{fields}, beta array<double>")
    return solved.join(ends, on=keys)


def predict_seasonal(model: DataFrame, df: DataFrame, spec: SeasonalSpec | None = None, keys: Sequence[str] = SID, ts: str = "timestamp") -> DataFrame:
    """Add ``trend``, ``weekly``, ``daily`` and ``yhat`` to the rows of a time frame, past or future."""
    spec = spec or SeasonalSpec()
    at = epoch_seconds(F.col(ts)).cast("double")
    place = (at - F.col("t0")) / F.greatest(F.col("t1") - F.col("t0"), F.lit(1))
    terms = spec.design(at, place)
    parts = {}
    for name, (begin, end) in spec.blocks().items():
        total = F.lit(0.0)
        for i in range(begin, end):
            total = total + F.element_at("beta", i + 1) * terms[i]
        parts[name] = total
    out = df.join(model, on=list(keys)).withColumns(parts)
    return out.withColumn("yhat", F.col("trend") + F.col("weekly") + F.col("daily")).drop("beta", "t0", "t1")


def seasonal_components(model: DataFrame, spec: SeasonalSpec | None = None, keys: Sequence[str] = SID) -> DataFrame:
    """The weekly shape by weekday and the daily shape by 5 minutes."""
    spec = spec or SeasonalSpec()
    blocks = spec.blocks()

    def shape(name: str, at: Column) -> Column:
        total = F.lit(0.0)
        for i, term in enumerate(spec.waves(at, name)):
            total = total + F.element_at("beta", blocks[name][0] + i + 1) * term
        return total

    # 1970-01-05 is a Monday.
    day = model.select(*keys, "beta", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("slot"))
    weekly = day.select(*keys, F.lit("weekly").alias("component"), "slot", shape("weekly", (F.col("slot") + 4) * F.lit(86400.0)).alias("value"))
    minute = model.select(*keys, "beta", F.explode(F.sequence(F.lit(0), F.lit(287))).alias("slot"))
    daily = minute.select(*keys, F.lit("daily").alias("component"), "slot", shape("daily", F.col("slot") * F.lit(300.0)).alias("value"))
    return weekly.unionByName(daily)
