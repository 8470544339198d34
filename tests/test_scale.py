"""Chunked windows, running values, quantiles and ranks against plain pandas and numpy, with tiny chunks."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trafficlens.operators import features as fe
from trafficlens.operators import scale as sc
from trafficlens.operators import series as se
from trafficlens.operators.downsample import largest_triangles

START = datetime(2024, 1, 1, 0, 20)
KEYS = ["series_id"]


def frame(spark, values, step=300, sid="a"):
    rows = [(sid, START + timedelta(seconds=step * i), None if v is None or np.isnan(v) else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id string, timestamp timestamp_ntz, y double")


def column(df, name):
    return np.array([np.nan if r[name] is None else r[name] for r in df.orderBy("series_id", "timestamp").collect()], dtype=float)


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(3)
    out = rng.poisson(20, 700).astype(float)
    out[50:60] = out[50]
    out[200:230] = 0
    return out


def test_halo_equals_plain_window(spark, values):
    df = frame(spark, values)
    s = pd.Series(values)

    def build(w):
        return {"std": F.stddev_samp("y").over(w.rowsBetween(-12, -1)), "lag": F.lag("y", 30).over(w), "peak": F.max("y").over(w.rowsBetween(0, 6))}

    out = sc.halo(df, KEYS, "timestamp", 300, build, back=30, ahead=6, chunk_rows=37)
    assert out.count() == len(values)
    np.testing.assert_allclose(column(out, "std"), s.shift(1).rolling(12, min_periods=1).std(), atol=1e-9)
    np.testing.assert_allclose(column(out, "lag"), s.shift(30), atol=0)
    np.testing.assert_allclose(column(out, "peak"), s[::-1].rolling(7, min_periods=1).max()[::-1], atol=0)


def test_running_equals_cumulative(spark, values):
    holes = values.copy()
    holes[[0, 1, 99, 100, 101, 650]] = np.nan
    df = frame(spark, holes)
    s = pd.Series(holes)
    spec = {"total": ("sum", "y"), "peak": ("max", "y"), "low": ("min", "y"), "before": ("max_before", "y"), "last": ("last", "y"), "next": ("next", "y")}
    out = sc.running(df, KEYS, "timestamp", 300, spec, chunk_rows=31)
    np.testing.assert_allclose(column(out, "total"), s.cumsum().ffill(), atol=1e-9)
    np.testing.assert_allclose(column(out, "peak"), s.cummax().ffill(), atol=0)
    np.testing.assert_allclose(column(out, "low"), s.cummin().ffill(), atol=0)
    np.testing.assert_allclose(column(out, "before"), s.shift(1).expanding().max(), atol=0)
    np.testing.assert_allclose(column(out, "last"), s.ffill(), atol=0)
    np.testing.assert_allclose(column(out, "next"), s.bfill(), atol=0)


def test_fills_equal_pandas(spark, values):
    holes = values.copy()
    holes[[0, 5, 6, 7, 300, 699]] = np.nan
    out = se.interpolate(frame(spark, holes), KEYS, ["y"], 300)
    np.testing.assert_allclose(column(out, "y"), pd.Series(holes).interpolate(), atol=1e-9)


@pytest.mark.parametrize("kind", ["counts", "heavy", "equal", "negative"])
def test_quantiles_are_exact(spark, kind):
    rng = np.random.default_rng(5)
    data = {
        "counts": rng.poisson(3, 500), "heavy": np.exp(rng.normal(0, 6, 500)), "equal": np.full(500, 7.0), "negative": rng.normal(-1e6, 10, 500),
    }[kind].astype(float)
    rows = spark.createDataFrame([("a", float(v)) for v in data] + [("b", 1.0), ("b", 2.0)], "k string, v double")
    probs = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r.k: r for r in sc.quantiles(rows, ["k"], "v", probs).collect()}
    np.testing.assert_allclose([got["a"][n] for n in probs], np.quantile(data, list(probs.values())), rtol=1e-12)
    assert got["b"].p50 == 1.5
    alone = sc.quantiles(rows.where("k = 'a'"), (), "v", {"m": 0.5}).first()
    assert alone.m == pytest.approx(np.median(data))


def test_window_features_equal_pandas(spark, values):
    out = fe.traffic_features(frame(spark, values), KEYS, 300).orderBy("timestamp").toPandas()
    s = pd.Series(values)
    past = s.shift(1)
    np.testing.assert_allclose(out["request_count_lag_288"], s.shift(288))
    np.testing.assert_allclose(out["request_count_rolling_mean_60"], past.rolling(60, min_periods=1).mean(), atol=1e-9)
    for span in (5, 15, 30):
        ewm = past.ewm(span=span, min_periods=1)
        np.testing.assert_allclose(out[f"request_count_ewm_mean_{span}"], ewm.mean(), atol=1e-7)
        np.testing.assert_allclose(out[f"request_count_ewm_std_{span}"], ewm.std(), atol=1e-6)
    slope = s.rolling(15, min_periods=2).apply(lambda x: np.polyfit(np.arange(len(x)), x, 1)[0], raw=True)
    np.testing.assert_allclose(out["request_count_trend"], slope, atol=1e-8)
    direction = np.sign(s.diff())
    np.testing.assert_allclose(out["request_count_streak"].astype(float), direction.groupby((direction != direction.shift()).cumsum()).cumsum())
    np.testing.assert_allclose(out["request_count_momentum"].astype(float), s.diff().rolling(5, min_periods=1).sum())
    score = ((s - past.rolling(15, min_periods=1).mean()) / past.rolling(15, min_periods=1).std().replace(0, np.nan)).fillna(0)
    np.testing.assert_allclose(out["spike_score"], score, atol=1e-8)


def test_ewm_over_many_chunks_and_spans(spark):
    rng = np.random.default_rng(9)
    data = rng.normal(1000, 5, 5000)
    out = fe.ewm(frame(spark, data), KEYS, 300, spans=(5, 100)).orderBy("timestamp").toPandas()
    for span in (5, 100):
        ewm = pd.Series(data).shift(1).ewm(span=span, min_periods=1)
        np.testing.assert_allclose(out[f"y_ewm_mean_{span}"], ewm.mean(), rtol=1e-9)
        np.testing.assert_allclose(out[f"y_ewm_std_{span}"], ewm.std(), rtol=1e-6)


def triangles(data, points):
    """The rule by brute force over all rows."""
    n, size, a, kept = len(data), (len(data) - 2) / (points - 2), 0, [0]
    for i in range(points - 2):
        begin, end = int((i + 1) * size) + 1, min(int((i + 2) * size) + 1, n - 1)
        ahead = data[int((i + 2) * size) + 1 : min(int((i + 3) * size) + 1, n)]
        goal = ahead.mean() if len(ahead) else data[-1]
        area = [abs((j - a) * (goal - data[a]) - (end - a) * (data[j] - data[a])) for j in range(begin, end)]
        a = begin + int(np.argmax(area)) if area else begin
        kept.append(a)
    return sorted(set([*kept, n - 1]))


@pytest.mark.parametrize("points", [5, 20, 61])
def test_largest_triangles(spark, values, points):
    rng = np.random.default_rng(1)
    data = values + rng.normal(0, 0.01, len(values))
    out = largest_triangles(frame(spark, data), points, 300).orderBy("idx").collect()
    assert [r.idx for r in out] == triangles(data, points)


def test_short_series_keep_all_rows(spark):
    assert largest_triangles(frame(spark, [1.0, 5.0, 2.0]), 10, 300).count() == 3


def test_no_window_sends_a_series_to_one_task(spark, values):
    df = frame(spark, values)
    plan = fe.traffic_features(df, KEYS, 300)._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if " Window [" in line and "__carry" not in line:
            assert sc.CHUNK in line


def test_value_chunks_are_small_however_values_lie(spark):
    """Most values within one unit, one far away: equal-width bins would put all but one into a single bin."""
    rows = [("a", 1e6 + i / 5000) for i in range(5000)] + [("a", 1e12)] + [("b", 3.0)] * 7
    df = spark.createDataFrame(rows, "series_id string, x double")
    distinct = df.distinct()
    chunks = sc.with_value_chunks(distinct, ["series_id"], "x", {"total": F.count(F.lit(1))}, cuts=64)
    sizes = {(r["series_id"], r[sc.CHUNK]): r["count"] for r in chunks.groupBy("series_id", sc.CHUNK).count().collect()}
    assert max(n for (k, _), n in sizes.items() if k == "a") < 5001 * 0.15
    order = [(r[sc.CHUNK]) for r in chunks.where("series_id = 'a'").orderBy("x").collect()]
    assert order == sorted(order) and len(set(order)) > 30
    ranks = sc.value_ranks(df, KEYS, "x", cuts=64).where("series_id = 'a'").orderBy("x").collect()
    assert [r["below"] for r in ranks] == list(range(5001))
    assert [tuple(r) for r in sc.value_ranks(df, KEYS, "x").where("series_id = 'b'").collect()] == [("b", 3.0, 7, 0, 7)]


def test_quantiles_of_many_columns_equal_numpy(spark):
    rng = np.random.default_rng(8)
    frames = pd.DataFrame({"series_id": ["a"] * 60 + ["b"] * 40, "p": rng.normal(size=100), "q": rng.integers(0, 5, 100).astype(float), "r": rng.exponential(size=100)})
    frames.loc[3, "p"] = np.nan
    df = spark.createDataFrame(frames.astype(object).where(frames.notna(), None).values.tolist(), "series_id string, p double, q double, r double")
    got = {r["series_id"]: r for r in sc.column_quantiles(df, KEYS, ["p", "q", "r"], {"lo": 0.25, "mid": 0.5}).collect()}
    for key, part in frames.groupby("series_id"):
        for c in "pqr":
            assert got[key][f"{c}__lo"] == pytest.approx(part[c].quantile(0.25)) and got[key][f"{c}__mid"] == pytest.approx(part[c].median())


def test_prefix_minimum_equals_plain_loop(spark):
    rng = np.random.default_rng(9)
    rows = [("a", float(x), float(y)) for x, y in zip(rng.choice([1e6, 1e6 + 1e-3, 5.0, 1e12, 7.25], 200), rng.normal(size=200), strict=True)] + [("a", None, -100.0)]
    df = spark.createDataFrame(rows, "series_id string, x double, y double")
    got = {r["x"]: (r["least_here"], r["least_before"]) for r in sc.prefix_min(df, KEYS, "x", "y", cuts=2).collect()}
    known = [r for r in rows if r[1] is not None]
    for x in {r[1] for r in known}:
        before = [r[2] for r in known if r[1] < x]
        assert got[x] == (min(r[2] for r in known if r[1] == x), min(before) if before else None)
