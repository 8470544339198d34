"""Mergeable sketches within their bounds, moments against numpy, the unit-root order against a loop of fits."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from trafficlens.operators import clean as cl
from trafficlens.operators import sketches as sk
from trafficlens.operators import stats as st
from trafficlens.operators.anomaly_ml import IsolationForestEstimator, IsolationForestModel
from trafficlens.operators.moments import correlation_of, pair_moments


def test_merged_quantile_sketches_stay_within_the_rank_error(spark):
    rng = np.random.default_rng(1)
    x = rng.lognormal(0, 3, 40_000)
    df = spark.createDataFrame([(i % 2, i % 50, float(v)) for i, v in enumerate(x)], "g int, hour int, x double").withColumn("x", F.when(F.col("hour") != 7, F.col("x")))
    merged = sk.merge_quantile_sketches(sk.quantile_sketches(df, ["g", "hour"], "x"), ["g"])
    probs = {"a": 0.1, "b": 0.5, "c": 0.9}
    for r in sk.sketch_quantiles(merged, ["g"], probs).collect():
        mine = np.sort([v for i, v in enumerate(x) if i % 2 == r["g"] and i % 50 != 7])
        assert r["n"] == len(mine)
        for name, p in probs.items():
            assert abs(np.searchsorted(mine, r[name]) / len(mine) - p) <= 2 * sk.rank_error()


def test_fences_from_sketches_are_near_the_exact_ones(spark):
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_011).cast("double").alias("bytes"))
    near, exact = cl.outlier_bounds(df, sketch_k=800).first(), cl.outlier_bounds(df).first()
    assert all(abs(near[c] - exact[c]) < 20_011 * 6 * sk.rank_error(800) for c in ("q1", "q3", "low", "high"))
    assert cl.outlier_bounds(df.where("bytes < 0"), sketch_k=800).count() <= 1


def test_frequent_items_stay_within_their_error(spark):
    rng = np.random.default_rng(2)
    items = np.where(rng.random(60_000) < 0.3, rng.integers(0, 5, 60_000), rng.integers(0, 30_000, 60_000))
    df = spark.createDataFrame([(i % 8, f"i{v}") for i, v in enumerate(items)], "part int, item string")
    merged = sk.merge_item_sketches(sk.item_sketches(df, ["part"], "item", 1000), [], 1000)
    got = {r["item"]: r for r in sk.frequent_items(merged, [], 50, 1000).collect()}
    exact = {f"i{v}": int((items == v).sum()) for v in range(5)}
    for item, n in exact.items():
        assert abs(got[item]["n"] - n) <= got[item]["max_error"]
    assert next(iter(got.values()))["max_error"] < 60_000 * 0.005


def test_moments_and_correlations_equal_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 6)) + [0, 1e7, 0, 5, 0, 0]
    x[:, 2] = x[:, 0] * 3 + rng.normal(size=400) * 0.01
    x[:, 4] = 0.1
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 4] = 0.1
    cols = list("abcdef")
    rows = [(f"k{i % 3}", *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "k string, " + ", ".join(f"{c} double" for c in cols)).repartition(5)
    for keys, groups in (([], {"": np.arange(400)}), (["k"], {f"k{j}": np.arange(400)[np.arange(400) % 3 == j] for j in range(3)})):
        got = {(r["k"] if keys else "", r["a"], r["b"]): r for r in pair_moments(df, cols, keys=keys).withColumn("r", correlation_of()).collect()}
        assert len(got) == 21 * len(groups)
        for key, mine in groups.items():
            for i, a in enumerate(cols):
                for j in range(i, 6):
                    both = x[mine][~np.isnan(x[mine][:, i]) & ~np.isnan(x[mine][:, j])]
                    r = got[key, a, cols[j]]
                    assert r["n"] == len(both)
                    if 4 in (i, j):
                        assert r["r"] is None
                    else:
                        assert r["r"] == pytest.approx(np.corrcoef(both[:, i], both[:, j])[0, 1], abs=1e-9)
    target = st.target_correlations(df, "b", ["a", "c"]).collect()
    assert {(r["a"], r["b"]) for r in target} == {("a", "b"), ("c", "b")}


def loop_of_fits(y, max_lag):
    """The order of least AIC over common rows, then its test on all rows it leaves."""
    dy = np.diff(y)

    def fit(lags, start):
        rows = range(start, len(dy))
        x = np.array([[1.0, y[t], *[dy[t - k] for k in range(1, lags + 1)]] for t in rows])
        z = dy[start:]
        beta, *_ = np.linalg.lstsq(x, z, rcond=None)
        rest = ((z - x @ beta) ** 2).sum()
        free = len(z) - x.shape[1]
        error = np.sqrt(rest / free * np.linalg.inv(x.T @ x)[1, 1])
        return len(z) * np.log(rest / len(z)) + 2 * x.shape[1], beta[1] / error, len(z)

    aic, lags = min((fit(p, max_lag)[0], p) for p in range(max_lag + 1))
    return lags, aic, *fit(lags, lags)[1:]


def test_unit_root_order_equals_a_loop_of_fits(spark):
    rng = np.random.default_rng(4)
    walk = np.cumsum(rng.normal(size=300)) + 1000
    wave = np.zeros(300)
    for t in range(3, 300):
        wave[t] = 0.5 * wave[t - 1] - 0.4 * wave[t - 3] + rng.normal()
    begin = datetime(2024, 1, 1)
    rows = [(s, begin + timedelta(hours=i), float(v)) for s, y in (("walk", walk), ("wave", wave)) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "series_id string, timestamp timestamp_ntz, y double")
    got = {r["series_id"]: r for r in st.unit_root_by_aic(df, 3600, 8).collect()}
    for name, y in (("walk", walk), ("wave", wave)):
        lags, aic, t, n = loop_of_fits(y, 8)
        assert (got[name]["used_lag"], got[name]["n_obs"]) == (lags, n)
        assert got[name]["adf"] == pytest.approx(t, rel=1e-7) and got[name]["aic"] == pytest.approx(aic, rel=1e-7)
    assert got["wave"]["stationary_5pct"] and not got["walk"]["stationary_5pct"]


def test_forest_model_is_saved_with_its_pipeline(spark, tmp_path):
    rng = np.random.default_rng(5)
    points = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(600, 2)))] + [(1000, 9.0, 9.0), (1001, None, -9.0)]
    df = spark.createDataFrame(points, "id long, a double, b double")
    learner = IsolationForestEstimator(inputCols=["a", "b"], idCols=["id"], numTrees=20, samplesPerTree=64, contamination=0.02, scoreCol="s", predictionCol="odd")
    fitted = Pipeline(stages=[learner]).fit(df)
    path = str(tmp_path / "pipeline")
    fitted.write().save(path)
    again = PipelineModel.load(path)
    model = again.stages[0]
    assert isinstance(model, IsolationForestModel) and model.getScoreCol() == "s" and model.uid == fitted.stages[0].uid and model.cut == fitted.stages[0].cut
    want = {r["id"]: (r["s"], r["odd"]) for r in fitted.transform(df).collect()}
    assert {r["id"]: (r["s"], r["odd"]) for r in again.transform(df).collect()} == want
    assert want[1000][1] == 1 and sum(o for _, o in want.values()) == pytest.approx(0.02 * 602, abs=2)
    loaded = IsolationForestEstimator.load(_saved(learner, str(tmp_path / "learner")))
    assert loaded.getOrDefault(loaded.numTrees) == 20 and loaded.getIdCols() == ["id"]
    copied = learner.copy({learner.numTrees: 3}).fit(df)
    assert len(copied.forest.trees) == 3


def _saved(stage, path):
    stage.write().save(path)
    return path


def test_selected_columns_become_two_tables(spark, tmp_path):
    df = spark.createDataFrame([(i, i * 2, -i) for i in range(10)], "id int, good int, bad int")
    chosen = spark.createDataFrame([("good",)], "feature string")
    train, test = st.project_selected(df, chosen, F.col("id") < 7, str(tmp_path / "out"), ["id"])
    assert train.columns == test.columns == ["id", "good"] and (train.count(), test.count()) == (7, 3)
