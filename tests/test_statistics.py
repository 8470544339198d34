"""Statistics, forecasts, models and the forest against numpy."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from trafficlens.operators import anomaly as an
from trafficlens.operators import forecast as fc
from trafficlens.operators import models as mo
from trafficlens.operators import reports as rp
from trafficlens.operators import stats as st

START = datetime(2024, 1, 1)


def frame(spark, values, step=3600):
    rows = [("a", START + timedelta(seconds=step * i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id string, timestamp timestamp_ntz, y double")


@pytest.fixture(scope="module")
def walk():
    rng = np.random.default_rng(11)
    noise = rng.normal(0, 1, 400)
    out = np.zeros(400)
    for i in range(1, 400):
        out[i] = 0.6 * out[i - 1] + noise[i]
    return out + 10


@pytest.mark.parametrize("t, df, p", [(0.0, 10, 0.5), (2.228139, 10, 0.025), (-2.228139, 10, 0.975), (1.644854, 1e7, 0.05), (12.7062, 1, 0.025)])
def test_t_tail(t, df, p):
    assert st.t_tail(t, df) == pytest.approx(p, abs=1e-6)


def test_unit_root_equals_least_squares(spark, walk):
    lags, dy = 2, np.diff(walk)
    n = len(dy) - lags
    x = np.column_stack([np.ones(n), walk[lags:-1], *[dy[lags - k : len(dy) - k] for k in range(1, lags + 1)]])
    target = dy[lags:]
    beta, *_ = np.linalg.lstsq(x, target, rcond=None)
    resid = target - x @ beta
    error = math.sqrt(resid @ resid / (n - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1])
    row = st.unit_root(frame(spark, walk), 3600, lags).first()
    assert row.n_obs == n and row.adf == pytest.approx(beta[1] / error, rel=1e-6) and row.stationary_5pct


def test_pacf_solves_yule_walker(spark, walk):
    r = [row.acf for row in st.acf(frame(spark, walk), 3600, 8).orderBy("lag").collect()]
    got = [row.pacf for row in st.pacf(st.acf(frame(spark, walk), 3600, 8), 8).orderBy("lag").collect()]
    for k in range(1, 9):
        toeplitz = np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)])
        assert got[k] == pytest.approx(np.linalg.solve(toeplitz, r[1 : k + 1])[-1], abs=1e-9)


def test_mutual_information_ranks_the_informative_column(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=2000)
    rows = spark.createDataFrame([(float(a), float(a * a + rng.normal() * 0.1), float(rng.normal())) for a in x], "good double, y double, bad double")
    scores = {r.feature: r.mi_score for r in st.mutual_information(rows, "y", ["good", "bad"]).collect()}
    assert scores["good"] > 0.5 > 0.1 > scores["bad"] >= 0


def test_pareto_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    points = [("a", float(c), float(v)) for c, v in zip(rng.integers(0, 30, 200), rng.integers(0, 30, 200))]
    out = rp.pareto(spark.createDataFrame(points, "series_id string, total_cost double, sla_violation_rate double")).collect()
    assert len(out) == 200
    for r in out:
        beaten = any(
            (c <= r.total_cost and v < r.sla_violation_rate) or (c < r.total_cost and v <= r.sla_violation_rate) for _, c, v in points
        )
        assert r.pareto_optimal == (not beaten)


def test_seasonal_model_recovers_its_own_shape(spark):
    t = np.arange(24 * 28)
    y = 50 + 0.05 * t + 10 * np.sin(2 * np.pi * t / 24) + 4 * np.cos(2 * np.pi * t / (24 * 7))
    df = frame(spark, y)
    spec = mo.SeasonalSpec(ridge=1e-6)
    model = mo.fit_seasonal(df, 3600, spec)
    worst = mo.predict_seasonal(model, df, spec).agg(F.max(F.abs(F.col("y") - F.col("yhat")))).first()[0]
    assert worst < 0.01
    ahead = mo.predict_seasonal(model, fc.future_grid(df, 48, 3600), spec).orderBy("timestamp").collect()
    late = np.arange(24 * 28, 24 * 28 + 48)
    want = 50 + 0.05 * late + 10 * np.sin(2 * np.pi * late / 24) + 4 * np.cos(2 * np.pi * late / (24 * 7))
    np.testing.assert_allclose([r.yhat for r in ahead], want, atol=0.1)
    assert mo.seasonal_components(model, spec).count() == 7 + 288


def test_rolling_origin_folds(spark):
    rows = mo.with_place(frame(spark, np.arange(120)), 3600)
    for fold in range(5):
        part = mo.rolling_origin(rows, fold, 5, 12)
        edges = {r.part: (r.lo, r.hi) for r in part.groupBy("part").agg(F.min("place").alias("lo"), F.max("place").alias("hi")).collect()}
        begin = 120 - (5 - fold) * 20
        assert edges["validation"] == (begin, begin + 19)
        assert edges.get("train", (0, begin - 13)) == (0, begin - 13)


def test_boosted_trees_beat_the_mean_and_reload(spark, tmp_path):
    rng = np.random.default_rng(6)
    y = 50 + 30 * np.sin(2 * np.pi * np.arange(500) / 24) + rng.normal(0, 2, 500)
    rows, names = mo.training_table(frame(spark, y), 3600)
    rows = fc.with_split(rows, 3600)
    model = mo.fit_boosted(rows.where("split = 'train'"), names, params={"maxIter": 5, "maxDepth": 4})
    test = model.predict(rows.where("split = 'validation'"))
    scores = fc.metrics(test.withColumn("model", F.lit("gbt"))).first()
    assert scores.r2 > 0.5
    model.save(str(tmp_path / "m"))
    again = mo.load_boosted(str(tmp_path / "m"), names).predict(rows.where("split = 'validation'"))
    assert again.agg(F.sum("yhat")).first()[0] == pytest.approx(test.agg(F.sum("yhat")).first()[0])


def test_metrics_skip_zero_actuals(spark):
    rows = spark.createDataFrame([("m", 0.0, 1.0), ("m", 10.0, 8.0), ("m", 20.0, 25.0)], "model string, y double, yhat double")
    r = fc.metrics(rows).first()
    assert r.rmse == pytest.approx(math.sqrt(30 / 3)) and r.mae == pytest.approx(8 / 3) and r.mape == pytest.approx((0.2 + 0.25) / 2 * 100)


def test_moving_average_limits(spark):
    with pytest.raises(ValueError):
        fc.moving_average(frame(spark, [1, 2, 3]), 0, 3600)
    assert fc.moving_average(frame(spark, [1, 2, 3]), 4032, 300).count() == 4032
    assert fc.moving_average(frame(spark, [1, 2]), 5, 3600).count() == 0
    assert fc.moving_average(frame(spark, [1, 2, 3]), 5, 3600).count() == 5


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(8)
    normal = np.column_stack([rng.normal(100, 10, 990), rng.normal(50, 5, 990), rng.normal(0.05, 0.01, 990)])
    odd = np.column_stack([rng.normal(400, 30, 10), rng.normal(5, 2, 10), rng.normal(0.6, 0.1, 10)])
    rows = [(i, *map(float, r)) for i, r in enumerate(np.vstack([normal, odd]))]
    return spark.createDataFrame(rows, "id bigint, a double, b double, c double")


def test_forest_finds_the_odd_rows(spark, blobs):
    out = an.IsolationForest(["a", "b", "c"], ["id"]).fit(blobs).transform(blobs).collect()
    flagged = {r.id for r in out if r.is_anomaly_ml}
    assert 5 <= len(flagged) <= 15 and len([i for i in flagged if i >= 990]) >= 8
    scores = {r.id: r.anomaly_score_ml for r in out}
    assert max(scores[i] for i in range(990, 1000)) < np.median(list(scores.values()))


def test_forest_repeats(spark, blobs):
    def scores():
        model = an.IsolationForest(["a", "b"], ["id"], trees=20).fit(blobs)
        return {r.id: r.anomaly_score_ml for r in model.transform(blobs).collect()}

    assert scores() == scores()


def test_every_tree_draws_from_all_rows(spark):
    rows = spark.range(5000).withColumn("a", F.col("id").cast("double"))
    draws = an.IsolationForest(["a"], ["id"], trees=20, samples=64)._draws(rows).collect()
    per_tree = {}
    for r in draws:
        per_tree.setdefault(r.tree, set()).add(r.id)
    assert len(per_tree) == 20 and {len(x) for x in per_tree.values()} == {64}
    assert len(set.union(*per_tree.values())) > 900  # of 20 x 64 draws with few repeats
    few = an.IsolationForest(["a"], ["id"], trees=3, samples=64)._draws(rows.where("id < 10"))
    assert few.count() == 30


def test_unknown_interval_levels_are_refused(spark):
    with pytest.raises(ValueError):
        fc.interval_factor(0.5)
    assert fc.interval_factor(0.99) == 2.576
