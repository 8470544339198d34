"""Queries over forecasts, trained models and error metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from trafficlens.operators import forecast as fc
from trafficlens.operators import models as mo
from trafficlens.operators import profiles as pr
from trafficlens.plans import views as v
from trafficlens.plans.registry import query
from trafficlens.session import scratch_path

SID = ["series_id"]
AT = "series_id:s timestamp:t"
HORIZON = 48
FUTURE = f"""SELECT series_id, step, last + (step + 1) * INTERVAL 1 HOUR AS ts FROM (SELECT series_id, max(ts) AS last, unnest(range({HORIZON})) AS step FROM series GROUP BY 1)"""

MOVING = f"""SELECT f.series_id, f.step, f.ts, greatest(0, m * (1 + 0.01 * step + 0.1 * ((step % 12) - 6) / 6)) AS yhat, s
    FROM ({FUTURE}) f JOIN (SELECT series_id, avg(y) AS m, stddev_pop(y) AS s FROM numbered WHERE back <= 12 GROUP BY 1) r ON r.series_id = f.series_id"""
NAIVE = f"""SELECT f.series_id, f.step, f.ts, CASE WHEN n >= 24 THEN p.yhat ELSE o.mean END AS yhat FROM ({FUTURE}) f
    JOIN (SELECT series_id, count(*) AS n, avg(y) AS mean FROM series GROUP BY 1) o ON o.series_id = f.series_id
    LEFT JOIN (SELECT series_id, phase, avg(y) AS yhat FROM (SELECT series_id, place % 24 AS phase, y, row_number() OVER (PARTITION BY series_id, place % 24 ORDER BY place DESC) AS k FROM numbered)
      WHERE k <= 7 GROUP BY 1, 2) p ON p.series_id = f.series_id AND p.phase = (n + step) % 24"""


def _moving(spark, d):
    return fc.moving_average(v.series(spark, d), HORIZON, v.HOUR)


def _naive(spark, d):
    return fc.seasonal_naive(v.series(spark, d), HORIZON, v.HOUR, 24)


@query(
    "m1_moving_average", f"{AT} yhat:d lo:d hi:d",
    f'SELECT series_id, ts AS "timestamp", yhat, greatest(0, yhat - 1.96 * s) AS lo, yhat + 1.96 * s AS hi FROM ({MOVING})', "numbered",
)
def m1(spark, d):
    return _moving(spark, d)


@query("m2_seasonal_naive", f"{AT} yhat:d", f'SELECT series_id, ts AS "timestamp", yhat FROM ({NAIVE})', "numbered")
def m2(spark, d):
    return _naive(spark, d)


@query(
    "m3_interval", f"{AT} yhat:d lo:d hi:d",
    f"""SELECT series_id, ts AS "timestamp", yhat, greatest(0, yhat - w) AS lo, yhat + w AS hi FROM (
      SELECT q.*, 1.645 * s * sqrt(yhat / (avg(yhat) OVER (PARTITION BY q.series_id) + 1e-6)) AS w FROM ({NAIVE}) q
      JOIN (SELECT series_id, stddev_pop(y) AS s FROM numbered WHERE back <= 288 GROUP BY 1) r ON r.series_id = q.series_id)""", "numbered",
)
def m3(spark, d):
    return fc.with_interval(_naive(spark, d), v.series(spark, d), 0.90)


@query(
    "m4_ensemble", f"{AT} yhat:d lo:d hi:d models:i",
    f"""SELECT e.series_id, ts AS "timestamp", yhat, greatest(0, yhat - 1.96 * sqrt(m * m + s * s)) AS lo, yhat + 1.96 * sqrt(m * m + s * s) AS hi, models FROM (
      SELECT series_id, ts, avg(yhat) AS yhat, stddev_pop(yhat) AS m, count(*) AS models FROM (
        SELECT series_id, ts, yhat FROM ({MOVING}) UNION ALL SELECT series_id, ts, yhat FROM ({NAIVE})) GROUP BY 1, 2) e
    JOIN (SELECT series_id, stddev_pop(y) AS s FROM numbered WHERE back <= 100 GROUP BY 1) r ON r.series_id = e.series_id""", "numbered",
)
def m4(spark, d):
    cols = ["series_id", "timestamp", "yhat"]
    return fc.ensemble(_moving(spark, d).select(*cols).unionByName(_naive(spark, d).select(*cols)), v.series(spark, d))


@query(
    "m5_future_features", f"{AT} estimate:d lag_1:d lag_12:d diff_1:d pct_change_1:d rolling_mean_3:d rolling_std_3:d rolling_max_3:d rolling_mean_60:d ewm_mean_30:d",
    f"""WITH h AS (SELECT series_id, hour(ts) AS hour, quantile_cont(CAST(y AS DOUBLE), 0.5) AS m FROM series GROUP BY 1, 2)
    SELECT f.series_id, f.ts AS "timestamp", 0.7 * h0.m + 0.3 * r.m AS estimate, h1.m AS lag_1, h12.m AS lag_12, 0.7 * h0.m + 0.3 * r.m - h1.m AS diff_1,
      coalesce((0.7 * h0.m + 0.3 * r.m - h1.m) / nullif(h1.m, 0), 0) AS pct_change_1, w.mean3 AS rolling_mean_3, w.std3 AS rolling_std_3, w.max3 AS rolling_max_3, w.mean60 AS rolling_mean_60, w.ewm30 AS ewm_mean_30
    FROM ({FUTURE}) f
    JOIN (SELECT series_id, avg(y) AS m FROM numbered WHERE back <= 12 GROUP BY 1) r ON r.series_id = f.series_id
    JOIN h h0 ON h0.series_id = f.series_id AND h0.hour = hour(f.ts)
    JOIN h h1 ON h1.series_id = f.series_id AND h1.hour = (hour(f.ts) + 23) % 24
    JOIN h h12 ON h12.series_id = f.series_id AND h12.hour = (hour(f.ts) + 12) % 24
    JOIN (SELECT a.series_id, a.hour, avg(b.m) FILTER (i < 3) AS mean3, stddev_pop(b.m) FILTER (i < 3) AS std3, max(b.m) FILTER (i < 3) AS max3, avg(b.m) AS mean60, sum(b.m * exp(-i / 30.0)) / sum(exp(-i / 30.0)) AS ewm30
      FROM h a CROSS JOIN (SELECT unnest(range(60)) AS i) k JOIN h b ON b.series_id = a.series_id AND b.hour = (a.hour - i + 72) % 24 GROUP BY 1, 2) w
      ON w.series_id = f.series_id AND w.hour = hour(f.ts)""",
    "numbered",
)
def m5(spark, d):
    return fc.future_features(v.series(spark, d), HORIZON, v.HOUR)


@query("m6_trend_slope", "series_id:s n:i slope:d", "SELECT series_id, count(*) AS n, regr_slope(y, place) AS slope FROM numbered WHERE back <= 288 GROUP BY 1", "numbered")
def m6(spark, d):
    return fc.trend_slope(v.series(spark, d))


def _train(spark, d):
    rows, names = mo.training_table(v.series(spark, d), v.HOUR)
    rows = fc.with_split(rows, v.HOUR).withColumn("validation", F.col("split") == "validation")
    return rows, names


@query("m7_boosted_trees", "split:s rmse:d mae:d mape:d r2:d")
def m7(spark, d):
    rows, names = _train(spark, d)
    model = mo.fit_boosted(rows, names, validation="validation")
    return fc.metrics(model.predict(rows), ("split",))


@query("m7_importance", "feature:s importance:d")
def m7_importance(spark, d):
    rows, names = _train(spark, d)
    return mo.fit_boosted(rows.where(F.col("split") == "train"), names).importance(rows)


@query("m8_seasonal_model", f"{AT} y:i trend:d weekly:d daily:d yhat:d")
def m8(spark, d):
    rows = v.series(spark, d)
    return mo.predict_seasonal(mo.fit_seasonal(rows, v.HOUR), rows)


@query("m8_seasonal_forecast", f"{AT} yhat:d")
def m8_forecast(spark, d):
    rows = v.series(spark, d)
    return mo.predict_seasonal(mo.fit_seasonal(rows, v.HOUR), fc.future_grid(rows, HORIZON, v.HOUR))


@query("m9_seasonal_components", "series_id:s component:s slot:i value:d")
def m9(spark, d):
    return mo.seasonal_components(mo.fit_seasonal(v.series(spark, d), v.HOUR))


@query("m10_rolling_origin_cv", "fold:i rmse:d mae:d mape:d")
def m10(spark, d):
    rows, names = mo.training_table(v.series(spark, d), v.HOUR)
    return mo.cross_validate(rows, names, v.HOUR, folds=5, gap=12)


@query("m10_cv_summary", "rmse_mean:d rmse_std:d mae_mean:d mae_std:d mape_mean:d mape_std:d")
def m10_summary(spark, d):
    rows, names = mo.training_table(v.series(spark, d), v.HOUR)
    return mo.summarize_folds(mo.cross_validate(rows, names, v.HOUR, folds=5, gap=12))


@query("m11_parameter_search", "params:s place:i rmse_mean:d rmse_std:d mae_mean:d mae_std:d mape_mean:d mape_std:d")
def m11(spark, d):
    rows, names = mo.training_table(v.series(spark, d), v.HOUR)
    return mo.search(rows, names, v.HOUR, {"maxDepth": [3, 5], "maxIter": [10, 20]}, folds=5, gap=12)


@query(
    "m12_split", f"{AT} split:s",
    "SELECT series_id, ts AS \"timestamp\", CASE WHEN place < floor(n_rows * 0.8::DOUBLE) THEN 'train' ELSE 'validation' END AS split FROM numbered", "numbered",
)
def m12(spark, d):
    return fc.with_split(v.series(spark, d), v.HOUR)


@query(
    "m13_robust_scale", f"{AT} y_scaled:d",
    """SELECT s.series_id, ts AS "timestamp", (y - q2) / CASE WHEN q3 = q1 THEN 1 ELSE q3 - q1 END AS y_scaled FROM series s JOIN (
      SELECT series_id, quantile_cont(CAST(y AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(y AS DOUBLE), 0.5) AS q2, quantile_cont(CAST(y AS DOUBLE), 0.75) AS q3
      FROM series WHERE ts < TIMESTAMP '2024-01-24 00:00:00' GROUP BY 1) q ON q.series_id = s.series_id""",
    "series",
)
def m13(spark, d):
    train = F.col("timestamp") < F.lit("2024-01-24 00:00:00").cast("timestamp_ntz")
    return fc.robust_scale(v.series(spark, d), ["y"], train=train)


METRICS = """sqrt(avg((y - yhat) * (y - yhat))) AS rmse, avg((y - yhat) * (y - yhat)) AS mse, avg(abs(y - yhat)) AS mae,
    avg(abs((y - yhat) / y)) FILTER (abs(y) > 1e-10) * 100 AS mape, avg(abs(y - yhat) / ((abs(y) + abs(yhat)) / 2 + 1e-10::DOUBLE)) * 100 AS smape,
    1 - avg((y - yhat) * (y - yhat)) / var_pop(y) AS r2"""


@query("m14_metrics", "model:s series_id:s rmse:d mse:d mae:d mape:d4 smape:d4 r2:d", f"SELECT model, series_id, {METRICS} FROM predictions GROUP BY 1, 2", "predictions")
def m14(spark, d):
    return fc.metrics(v.predictions(spark, d), ("model", "series_id"))


@query(
    "m15_compare_models", "series_id:s model:s rmse:d4 mae:d4 best_model:s is_best:b",
    f"""SELECT m.*, b.best_model, m.model = b.best_model AS is_best FROM (SELECT series_id, model, {METRICS} FROM predictions GROUP BY 1, 2) m
    JOIN (SELECT series_id, arg_min(model, (rmse, model)) AS best_model FROM (SELECT series_id, model, {METRICS} FROM predictions GROUP BY 1, 2) GROUP BY 1) b ON b.series_id = m.series_id""",
    "predictions",
)
def m15(spark, d):
    return fc.compare_models(fc.metrics(v.predictions(spark, d), ("series_id", "model")), SID)


@query("m16_residuals", f"model:s {AT} resid:d", 'SELECT model, series_id, ts AS "timestamp", y - yhat AS resid FROM predictions', "predictions")
def m16(spark, d):
    return v.predictions(spark, d).withColumn("resid", F.col("y") - F.col("yhat"))


@query(
    "m16_residual_histogram", "model:s bin:i n:i",
    """SELECT model, least(49, floor((resid - lo) * 50 / (hi - lo))) AS bin, count(*) AS n FROM (
      SELECT *, min(resid) OVER (PARTITION BY model) AS lo, max(resid) OVER (PARTITION BY model) AS hi FROM (SELECT model, CAST(y - yhat AS DOUBLE) AS resid FROM predictions)) GROUP BY 1, 2""",
    "predictions",
)
def m16_histogram(spark, d):
    rows = v.predictions(spark, d).withColumn("resid", F.col("y") - F.col("yhat"))
    return pr.histogram(rows, "resid", 50, ["model"])


QQ = ", ".join(str((i + 0.5) / 20) for i in range(20))


@query(
    "m16_qq_points", "model:s q:d residual:d",
    f"SELECT model, unnest([{QQ}]) AS q, unnest(quantile_cont(CAST(y - yhat AS DOUBLE), [{QQ}])) AS residual FROM predictions GROUP BY model",
    "predictions",
)
def m16_qq(spark, d):
    return fc.residual_points(v.predictions(spark, d), ["model"])


@query(
    "m17_residual_interval", f"{AT} yhat:d lo:d hi:d",
    f"""SELECT q.series_id, ts AS "timestamp", yhat, yhat + lo AS lo, yhat + hi AS hi FROM ({NAIVE}) q JOIN (
      SELECT series_id, quantile_cont(CAST(y - yhat AS DOUBLE), 0.025) AS lo, quantile_cont(CAST(y - yhat AS DOUBLE), 0.975) AS hi FROM predictions WHERE model = 'seasonal' GROUP BY 1) r ON r.series_id = q.series_id""",
    "numbered predictions",
)
def m17(spark, d):
    resid = v.predictions(spark, d).where(F.col("model") == "seasonal").withColumn("resid", F.col("y") - F.col("yhat"))
    return fc.residual_interval(_naive(spark, d), resid)


@query(
    "m17_simple_interval", f"{AT} lo:d hi:d",
    f"""SELECT series_id, ts AS "timestamp", yhat - 0.196 * s AS lo, yhat + 0.196 * s AS hi FROM (SELECT *, stddev_pop(yhat) OVER (PARTITION BY series_id) AS s FROM ({NAIVE}))""", "numbered",
)
def m17_simple(spark, d):
    return fc.simple_interval(_naive(spark, d))


@query(
    "m18_split_ratios", "model:s series_id:s train_rmse:d validation_rmse:d test_rmse:d validation_ratio:d test_ratio:d",
    """SELECT model, series_id, a AS train_rmse, b AS validation_rmse, c AS test_rmse, b / nullif(a, 0) AS validation_ratio, c / nullif(a, 0) AS test_ratio FROM (
      SELECT model, series_id, sqrt(avg(e) FILTER (day(ts) < 19)) AS a, sqrt(avg(e) FILTER (day(ts) BETWEEN 19 AND 24)) AS b, sqrt(avg(e) FILTER (day(ts) > 24)) AS c
      FROM (SELECT *, (y - yhat) * (y - yhat) AS e FROM predictions) GROUP BY 1, 2)""",
    "predictions",
)
def m18(spark, d):
    day = F.dayofmonth("timestamp")
    split = F.when(day < 19, "train").when(day <= 24, "validation").otherwise("test")
    scores = fc.metrics(v.predictions(spark, d).withColumn("split", split), ("model", "series_id", "split"))
    return fc.split_ratios(scores, ("model", "series_id"))


@query("m19_save_load", f"{AT} yhat:d")
def m19(spark, d):
    rows, names = _train(spark, d)
    path = scratch_path(spark, "model")
    mo.fit_boosted(rows.where(F.col("split") == "train"), names).save(path)
    return mo.load_boosted(path, names).predict(rows.where(F.col("split") == "validation"))


@query(
    "m20_tail_features", "series_id:s " + " ".join(f"lag_{k}:d" for k in fc.TAIL_LAGS) + " " + " ".join(f"mean_{w}:d std_{w}:d" for w in fc.TAIL_WINDOWS),
    "SELECT series_id, "
    + ", ".join(f"coalesce(max(y) FILTER (back = {k} AND n_rows > {k}), max(y) FILTER (back = 1)) AS lag_{k}" for k in fc.TAIL_LAGS)
    + ", "
    + ", ".join(f"avg(y) FILTER (back <= {w}) AS mean_{w}, stddev_pop(y) FILTER (back <= {w}) AS std_{w}" for w in fc.TAIL_WINDOWS)
    + " FROM numbered GROUP BY 1",
    "numbered",
)
def m20(spark, d):
    return fc.tail_features(v.series(spark, d))
