"""Queries over series: aggregation, profiles, fills, window features, downsampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from trafficlens.operators import features as fe
from trafficlens.operators import profiles as pr
from trafficlens.operators import series as se
from trafficlens.operators.downsample import largest_triangles
from trafficlens.operators.forecast import median_fill, mode_fill
from trafficlens.operators.reports import overload_episodes, running_cost
from trafficlens.operators.scale import halo, running
from trafficlens.plans import views as v
from trafficlens.plans import wide
from trafficlens.plans.registry import query

SID = ["series_id"]
AT = "series_id:s timestamp:t"
HEAD = 'series_id, ts AS "timestamp"'
BY = "PARTITION BY series_id ORDER BY ts"
W = f"WINDOW w AS ({BY})"

TRAFFIC = "timestamp:t request_count:i unique_hosts:i error_count:i error_rate:d success_rate:d bytes_total:i bytes_avg:d bytes_max:i"


@query(
    "a1_window_agg", TRAFFIC,
    """SELECT ts AS "timestamp", request_count, unique_hosts, error_count, coalesce(error_rate, 0) AS error_rate, coalesce(success_rate, 0) AS success_rate,
      bytes_total, coalesce(bytes_avg, 0) AS bytes_avg, coalesce(bytes_max, 0) AS bytes_max FROM traffic""",
    "traffic",
)
def a1(spark, d):
    return se.traffic_series(v.fixed(spark, d), se.SeriesSpec(v.HOUR))


@query("a2_counts_only", "timestamp:t request_count:i", 'SELECT ts AS "timestamp", request_count FROM traffic', "traffic")
def a2(spark, d):
    return se.traffic_series(v.fixed(spark, d), se.SeriesSpec(v.HOUR, hosts=False, errors=False, sizes=False))


@query(
    "a4_ratios", "timestamp:t requests_per_host:d bytes_per_request:d",
    """SELECT ts AS "timestamp", coalesce(request_count / nullif(unique_hosts, 0), 0) AS requests_per_host,
      coalesce(bytes_total / nullif(request_count, 0), 0) AS bytes_per_request FROM traffic""",
    "traffic",
)
def a4(spark, d):
    return se.traffic_series(v.fixed(spark, d), se.SeriesSpec(v.HOUR))


@query(
    "a5_series_stats", "series_id:s n_rows:i first_time:t last_time:t total:i mean:d max:i std:d zero_windows:i",
    """SELECT series_id, count(*) AS n_rows, min(ts) AS first_time, max(ts) AS last_time, sum(y) AS total, avg(y) AS mean, max(y) AS max,
      stddev_samp(y) AS std, count(*) FILTER (y = 0) AS zero_windows FROM series GROUP BY 1""",
    "series",
)
def a5(spark, d):
    return pr.series_stats(v.series(spark, d))


def _resample_sql(unit: str) -> str:
    return f"""SELECT series_id, CAST(date_trunc('{unit}', ts) AS TIMESTAMP) AS "timestamp", sum(y) AS total, avg(y) AS mean, max(y) AS max, stddev_samp(y) AS std FROM series GROUP BY 1, 2"""


@query("a6_daily", f"{AT} total:i mean:d max:i std:d", _resample_sql("day"), "series")
def a6(spark, d):
    return pr.resample(v.series(spark, d), v.DAY)


@query(
    "a7_hour_profile", "series_id:s hour:i mean:d std:d median:d min:i max:i",
    """SELECT series_id, hour(ts) AS hour, avg(y) AS mean, stddev_samp(y) AS std, quantile_cont(CAST(y AS DOUBLE), 0.5) AS median, min(y) AS min, max(y) AS max FROM series GROUP BY 1, 2""",
    "series",
)
def a7(spark, d):
    return pr.hour_profile(v.series(spark, d))


@query("a7_top_hours", "hour:i mean:d", "SELECT hour(ts) AS hour, avg(y) AS mean FROM series WHERE series_id = 'all' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5", "series")
def a7_top(spark, d):
    return pr.top_hours(v.all_traffic(spark, d))


@query(
    "a8_weekday_profile", "series_id:s day_of_week:i mean:d std:d total:i",
    "SELECT series_id, isodow(ts) - 1 AS day_of_week, avg(y) AS mean, stddev_samp(y) AS std, sum(y) AS total FROM series GROUP BY 1, 2",
    "series",
)
def a8(spark, d):
    return pr.weekday_profile(v.series(spark, d))


@query(
    "a9_heatmap", "series_id:s day_of_week:i " + " ".join(f"h{h}:d" for h in range(24)),
    "SELECT series_id, isodow(ts) - 1 AS day_of_week, " + ", ".join(f"avg(y) FILTER (hour(ts) = {h}) AS h{h}" for h in range(24)) + " FROM series GROUP BY 1, 2",
    "series",
)
def a9(spark, d):
    return pr.heatmap(v.series(spark, d))


@query(
    "a10_weekend_effect", "series_id:s weekday_avg:d weekend_avg:d drop_pct:d",
    """SELECT series_id, avg(y) FILTER (isodow(ts) < 6) AS weekday_avg, avg(y) FILTER (isodow(ts) >= 6) AS weekend_avg,
      (1 - avg(y) FILTER (isodow(ts) >= 6) / avg(y) FILTER (isodow(ts) < 6)) * 100 AS drop_pct FROM series GROUP BY 1""",
    "series",
)
def a10(spark, d):
    return pr.weekend_effect(v.series(spark, d))


@query(
    "a11_hourly_rollup", f"{AT} total:i",
    """SELECT event_type AS series_id, date_trunc('hour', ts) AS "timestamp", count(*) AS total FROM events GROUP BY 1, 2
    UNION ALL SELECT s.series_id, s.ts, 0 FROM series s WHERE s.series_id <> 'all' AND y = 0""",
    "series",
)
def a11(spark, d):
    fine = v.series(spark, d, 300).where(F.col("series_id") != "all")
    return pr.resample(fine, v.HOUR)


@query(
    "a12_histogram", "series_id:s bin:i n:i",
    """SELECT series_id, least(49, coalesce(floor((y - lo) * 50 / nullif(hi - lo, 0)), 0)) AS bin, count(*) AS n
    FROM (SELECT *, min(y) OVER (PARTITION BY series_id) AS lo, max(y) OVER (PARTITION BY series_id) AS hi FROM series) GROUP BY 1, 2""",
    "series",
)
def a12(spark, d):
    return pr.histogram(v.series(spark, d), "y", 50)


@query(
    "a13_describe", "series_id:s mean:d std:d std_sample:d min:i max:i q25:d median:d q75:d p95:d",
    """SELECT series_id, avg(y) AS mean, stddev_pop(y) AS std, stddev_samp(y) AS std_sample, min(y) AS min, max(y) AS max,
      quantile_cont(CAST(y AS DOUBLE), 0.25) AS q25, quantile_cont(CAST(y AS DOUBLE), 0.5) AS median, quantile_cont(CAST(y AS DOUBLE), 0.75) AS q75,
      quantile_cont(CAST(y AS DOUBLE), 0.95) AS p95 FROM series GROUP BY 1""",
    "series",
)
def a13(spark, d):
    return pr.describe(v.series(spark, d))


@query(
    "a14_box_by_hour", "series_id:s hour:i q25:d median:d q75:d",
    """SELECT series_id, hour(ts) AS hour, quantile_cont(CAST(y AS DOUBLE), 0.25) AS q25, quantile_cont(CAST(y AS DOUBLE), 0.5) AS median, quantile_cont(CAST(y AS DOUBLE), 0.75) AS q75
    FROM series GROUP BY 1, 2""",
    "series",
)
def a14(spark, d):
    return pr.box_stats(v.series(spark, d), "hour")


@query(
    "a15_host_entropy", "timestamp:t hosts:i entropy:d entropy_norm:d",
    """SELECT ts AS "timestamp", count(*) AS hosts, -sum(c / n * ln(c / n)) AS entropy, CASE WHEN count(*) > 1 THEN -sum(c / n * ln(c / n)) / ln(count(*)) ELSE 0 END AS entropy_norm
    FROM (SELECT *, sum(c) OVER (PARTITION BY ts) AS n FROM (SELECT date_trunc('hour', ts) AS ts, host, CAST(count(*) AS DOUBLE) AS c FROM fixed GROUP BY 1, 2)) GROUP BY 1""",
    "fixed",
)
def a15(spark, d):
    return pr.host_entropy(v.fixed(spark, d), v.HOUR)


@query(
    "a16_bucket_means", "series_id:s bucket:i mean:d",
    """SELECT series_id, place // greatest(1, n_rows // 100) AS bucket, avg(y) AS mean FROM numbered GROUP BY 1, 2""",
    "numbered",
)
def a16(spark, d):
    return pr.bucket_means(v.series(spark, d), v.HOUR, 100)


@query(
    "a17_bandwidth", "total_gb:d mean_mb:d peak_mb:d",
    "SELECT sum(bytes_total) / 1e9 AS total_gb, avg(bytes_total) / 1e6 AS mean_mb, max(bytes_total) / 1e6 AS peak_mb FROM traffic",
    "traffic",
)
def a17(spark, d):
    return pr.bandwidth(se.traffic_series(v.fixed(spark, d), se.SeriesSpec(v.HOUR, hosts=False, errors=False)))


@query("f1_grid", AT, f"SELECT {HEAD} FROM sparse", "sparse")
def f1(spark, d):
    return v.sparse(spark, d)


@query("f2_zero_fill", f"{AT} n:i x:d", f"SELECT {HEAD}, n, coalesce(x, 0) AS x FROM sparse", "sparse")
def f2(spark, d):
    return se.zero_fill(v.sparse(spark, d), ["x"])


@query("f3_ffill", f"{AT} n:i x:d", f"SELECT {HEAD}, n, last_value(x IGNORE NULLS) OVER ({BY} ROWS UNBOUNDED PRECEDING) AS x FROM sparse", "sparse")
def f3(spark, d):
    return se.forward_fill(v.sparse(spark, d), SID, ["x"], 900, chunk_rows=v.SHORT_CHUNK)


INTERPOLATED = """
    SELECT series_id, ts, n, coalesce(x, px + coalesce((nx - px) * (epoch(ts) - epoch(pt)) / nullif(epoch(nt) - epoch(pt), 0), 0)) AS x FROM (
      SELECT series_id, ts, n, x, last_value(x IGNORE NULLS) OVER p AS px, last_value(CASE WHEN x IS NOT NULL THEN ts END IGNORE NULLS) OVER p AS pt,
        first_value(x IGNORE NULLS) OVER f AS nx, first_value(CASE WHEN x IS NOT NULL THEN ts END IGNORE NULLS) OVER f AS nt
      FROM sparse
      WINDOW p AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             f AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query("f4_interpolate", f"{AT} n:i x:d", f"SELECT {HEAD}, n, x FROM ({INTERPOLATED})", "sparse")
def f4(spark, d):
    return se.interpolate(v.sparse(spark, d), SID, ["x"], 900, chunk_rows=v.SHORT_CHUNK)


@query("f5_bfill", f"{AT} n:i x:d", f"SELECT {HEAD}, n, first_value(x IGNORE NULLS) OVER ({BY} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x FROM sparse", "sparse")
def f5(spark, d):
    return se.backward_fill(v.sparse(spark, d), SID, ["x"], 900, chunk_rows=v.SHORT_CHUNK)


@query(
    "f6_median_fill", f"{AT} x:d",
    f"SELECT s.series_id, s.ts AS \"timestamp\", coalesce(x, m) AS x FROM sparse s JOIN (SELECT series_id, quantile_cont(x, 0.5) AS m FROM sparse WHERE ts < TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1) q ON q.series_id = s.series_id",
    "sparse",
)
def f6(spark, d):
    train = F.col("timestamp") < F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    return median_fill(v.sparse(spark, d), ["x"], train=train)


@query(
    "f7_mode_fill", "event_id:i event_type:s number:i kind:s",
    """SELECT e.event_id, e.event_type, coalesce(CASE WHEN event_id % 4 <> 0 THEN event_id END, 0) AS number, coalesce(CASE WHEN event_id % 3 <> 0 THEN 'k' || (k % 10) END, mode) AS kind
    FROM (SELECT *, CAST(regexp_extract(props, '(\\d+)', 1) AS INT) AS k FROM events) e
    JOIN (SELECT event_type, kind AS mode FROM (
        SELECT event_type, 'k' || (CAST(regexp_extract(props, '(\\d+)', 1) AS INT) % 10) AS kind, count(*) AS n FROM events WHERE event_id % 3 <> 0 GROUP BY 1, 2)
      QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY n DESC, kind) = 1) m ON m.event_type = e.event_type""",
)
def f7(spark, d):
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int") % 10
    rows = v.table(spark, d, "events").select(
        "event_id", "event_type", F.when(F.col("event_id") % 4 != 0, F.col("event_id")).alias("number"),
        F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("k"), k)).alias("kind"),
    )
    return mode_fill(rows, ["number"], ["kind"], ["event_type"])


def _windowed(spark, d, build, back, then=None):
    return halo(v.series(spark, d), SID, "timestamp", v.HOUR, build, back=back, chunk_rows=v.SHORT_CHUNK, then=then)


LAGS = (1, 3, 6, 12, 60, 288)


@query("w1_lags", f"{AT} " + " ".join(f"y_lag_{k}:i" for k in LAGS), f"SELECT {HEAD}, " + ", ".join(f"lag(y, {k}) OVER w AS y_lag_{k}" for k in LAGS) + f" FROM series {W}", "series")
def w1(spark, d):
    return _windowed(spark, d, lambda w: fe.lag_columns(w, "y", LAGS), 288)


@query("w2_diffs", f"{AT} " + " ".join(f"y_diff_{k}:i" for k in LAGS), f"SELECT {HEAD}, " + ", ".join(f"y - lag(y, {k}) OVER w AS y_diff_{k}" for k in LAGS) + f" FROM series {W}", "series")
def w2(spark, d):
    return _windowed(spark, d, lambda w: fe.diff_columns(w, "y", LAGS), 288)


@query(
    "w3_pct_change", f"{AT} " + " ".join(f"y_pct_change_{k}:d" for k in LAGS),
    f"SELECT {HEAD}, " + ", ".join(f"(y - lag(y, {k}) OVER w) / nullif(lag(y, {k}) OVER w, 0) AS y_pct_change_{k}" for k in LAGS) + f" FROM series {W}", "series",
)
def w3(spark, d):
    return _windowed(spark, d, lambda w: fe.diff_columns(w, "y", LAGS), 288)


def _frame(n: int) -> str:
    return f"({BY} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


ROLLS = (3, 12, 60)


@query(
    "w4_rolling", f"{AT} " + " ".join(f"y_rolling_mean_{n}:d y_rolling_std_{n}:d" for n in ROLLS),
    f"SELECT {HEAD}, " + ", ".join(f"avg(y) OVER {_frame(n)} AS y_rolling_mean_{n}, stddev_samp(y) OVER {_frame(n)} AS y_rolling_std_{n}" for n in ROLLS) + " FROM series", "series",
)
def w4(spark, d):
    return _windowed(spark, d, lambda w: fe.rolling_columns(w, "y", ROLLS), 60)


@query(
    "w5_rolling_range", f"{AT} " + " ".join(f"y_rolling_min_{n}:i y_rolling_max_{n}:i y_rolling_range_{n}:i" for n in (3, 12)),
    f"SELECT {HEAD}, " + ", ".join(
        f"min(y) OVER {_frame(n)} AS y_rolling_min_{n}, max(y) OVER {_frame(n)} AS y_rolling_max_{n}, max(y) OVER {_frame(n)} - min(y) OVER {_frame(n)} AS y_rolling_range_{n}" for n in (3, 12)
    ) + " FROM series", "series",
)
def w5(spark, d):
    return _windowed(spark, d, lambda w: fe.rolling_columns(w, "y", (3, 12)), 12)


@query(
    "w6_rolling_quantiles", f"{AT} " + " ".join(f"y_rolling_median_{n}:d y_rolling_q25_{n}:d y_rolling_q75_{n}:d" for n in ROLLS),
    f"SELECT {HEAD}, " + ", ".join(
        f"quantile_cont(CAST(y AS DOUBLE), {p}) OVER {_frame(n)} AS y_rolling_{label}_{n}" for n in ROLLS for label, p in (("median", 0.5), ("q25", 0.25), ("q75", 0.75))
    ) + " FROM series", "series",
)
def w6(spark, d):
    return _windowed(spark, d, lambda w: fe.rolling_quantile_columns(w, "y", ROLLS), 60)


@query(
    "w7_rolling_cv", f"{AT} " + " ".join(f"y_rolling_cv_{n}:d" for n in ROLLS),
    f"SELECT {HEAD}, " + ", ".join(f"stddev_samp(y) OVER {_frame(n)} / nullif(avg(y) OVER {_frame(n)}, 0) AS y_rolling_cv_{n}" for n in ROLLS) + " FROM series", "series",
)
def w7(spark, d):
    return _windowed(spark, d, lambda w: fe.rolling_quantile_columns(w, "y", ROLLS), 60)


def _ewm_sql(value: str) -> str:
    parts = []
    for span in fe.EWM_SPANS:
        r = 1 - 2 / (span + 1)
        k = fe.ewm_reach(span)
        parts.append(
            f"""SELECT a.series_id, a.ts, {span} AS span, sum(pow({r!r}, a.place - b.place - 1)) AS w, sum(pow({r!r}, 2 * (a.place - b.place - 1))) AS w2,
            sum(pow({r!r}, a.place - b.place - 1) * b.y) AS wx, sum(pow({r!r}, a.place - b.place - 1) * b.y * b.y) AS wxx, count(b.y) AS seen
            FROM numbered a LEFT JOIN numbered b ON a.series_id = b.series_id AND b.place BETWEEN a.place - {k} AND a.place - 1 GROUP BY 1, 2"""
        )
    picks = ", ".join(f"max({value}) FILTER (span = {s}) AS y_ewm_{{0}}_{s}" for s in fe.EWM_SPANS)
    return f'SELECT series_id, ts AS "timestamp", {picks} FROM ({" UNION ALL ".join(parts)}) GROUP BY 1, 2'


@query("w8_ewm_mean", f"{AT} " + " ".join(f"y_ewm_mean_{s}:d4" for s in fe.EWM_SPANS), _ewm_sql("wx / w").format("mean"), "numbered")
def w8(spark, d):
    return fe.ewm(v.series(spark, d), SID, v.HOUR)


@query(
    "w9_ewm_std", f"{AT} " + " ".join(f"y_ewm_std_{s}:d4" for s in fe.EWM_SPANS),
    _ewm_sql("CASE WHEN seen > 1 THEN sqrt(greatest(wxx / w - (wx / w) * (wx / w), 0) * w * w / (w * w - w2)) END").format("std"), "numbered",
)
def w9(spark, d):
    return fe.ewm(v.series(spark, d), SID, v.HOUR)


@query("w10_spikes", f"{AT} spike_score:d is_spike:i is_dip:i spike_magnitude:d", f"SELECT {HEAD}, spike_score, is_spike, is_dip, spike_magnitude FROM marked", "marked")
def w10(spark, d):
    return v.marked(spark, d)


@query("w11_direction", f"{AT} y_diff_1:i y_direction:d", f"SELECT {HEAD}, y - lag(y, 1) OVER w AS y_diff_1, sign(y - lag(y, 1) OVER w) AS y_direction FROM series {W}", "series")
def w11(spark, d):
    return _windowed(spark, d, lambda w: fe.trend_columns(w, "y", 24), 24)


@query(
    "w12_streak", f"{AT} y_streak:d",
    f"""SELECT {HEAD}, dir * row_number() OVER (PARTITION BY series_id, run ORDER BY ts) AS y_streak FROM (
      SELECT *, sum(changed) OVER ({BY} ROWS UNBOUNDED PRECEDING) AS run FROM (
        SELECT *, CASE WHEN dir IS DISTINCT FROM lag(dir) OVER w THEN 1 ELSE 0 END AS changed FROM (SELECT *, sign(y - lag(y) OVER w) AS dir FROM series {W}) {W}))""",
    "series",
)
def w12(spark, d):
    return fe.streaks(v.series(spark, d), SID, v.HOUR, chunk_rows=v.SHORT_CHUNK)


@query(
    "w13_trend", f"{AT} y_trend:d4",
    f"SELECT {HEAD}, regr_slope(y, place) OVER ({BY} ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) AS y_trend FROM numbered", "numbered",
)
def w13(spark, d):
    return _windowed(spark, d, lambda w: fe.trend_columns(w, "y", 24), 24, lambda w: fe.slope_column(w, "y"))


@query(
    "w14_vs_yesterday", f"{AT} y_vs_yesterday:i y_vs_yesterday_pct:d",
    f"SELECT {HEAD}, y - lag(y, 24) OVER w AS y_vs_yesterday, (y - lag(y, 24) OVER w) / nullif(lag(y, 24) OVER w, 0) AS y_vs_yesterday_pct FROM series {W}", "series",
)
def w14(spark, d):
    return _windowed(spark, d, lambda w: fe.trend_columns(w, "y", 24), 24)


@query(
    "w15_volatility", f"{AT} y_cv:d y_bb_upper:d y_bb_lower:d y_bb_width:d",
    f"""SELECT {HEAD}, coalesce(s / nullif(m, 0), 0) AS y_cv, m + 2 * s AS y_bb_upper, m - 2 * s AS y_bb_lower, 4 * s AS y_bb_width
    FROM (SELECT *, avg(y) OVER {_frame(15)} AS m, stddev_samp(y) OVER {_frame(15)} AS s FROM series)""", "series",
)
def w15(spark, d):
    return _windowed(spark, d, lambda w: fe.volatility_columns(w, "y"), 15)


@query(
    "w16_pct_of_max", f"{AT} y_pct_of_max:d",
    f"SELECT {HEAD}, coalesce(y / nullif(max(y) OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS y_pct_of_max FROM series", "series",
)
def w16(spark, d):
    return fe.pct_of_max(v.series(spark, d), SID, v.HOUR, chunk_rows=v.SHORT_CHUNK)


@query(
    "w17_rates", f"{AT} y_velocity:i y_acceleration:i y_momentum:i",
    f"""SELECT {HEAD}, v AS y_velocity, v - lag(v) OVER w AS y_acceleration, sum(v) OVER ({BY} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS y_momentum
    FROM (SELECT *, y - lag(y) OVER w AS v FROM series {W}) {W}""", "series",
)
def w17(spark, d):
    return _windowed(spark, d, lambda w: fe.rate_columns(w, "y"), 5)


@query(
    "w18_zscore", f"{AT} is_anomaly_ml:i anomaly_score_ml:d anomaly_agreement:i",
    f"SELECT {HEAD}, is_anomaly_ml, anomaly_score_ml, CAST(is_spike = 1 AND is_anomaly_ml = 1 AS INT) AS anomaly_agreement FROM marked", "marked",
)
def w18(spark, d):
    return fe.agreement(v.marked(spark, d))


@query("w19_cumulative_cost", f"{AT} cumulative_cost:d", f"SELECT {HEAD}, sum(load * 0.85) OVER ({BY} ROWS UNBOUNDED PRECEDING) AS cumulative_cost FROM loads", "loads")
def w19(spark, d):
    rows = v.loads(spark, d).withColumn("cost", F.col("load") * 0.85)
    return running_cost(rows, v.HOUR, SID, chunk_rows=v.SHORT_CHUNK)


@query(
    "w20_overload_episodes", "series_id:s start:t minutes:d max_utilization:d",
    """SELECT series_id, min(ts) AS start, count(*) * 60 AS minutes, max(used) AS max_utilization FROM (
      SELECT series_id, ts, used, place - row_number() OVER (PARTITION BY series_id ORDER BY ts) AS island
      FROM (SELECT *, y / 3.0 AS used FROM numbered) WHERE used > 1) GROUP BY series_id, island""",
    "numbered",
)
def w20(spark, d):
    rows = v.series(spark, d).withColumn("utilization", F.col("y") / F.lit(3.0))
    return overload_episodes(rows, v.HOUR, SID)


@query(
    "w21_top_spikes", f"{AT} spike_score:d",
    f"SELECT {HEAD}, spike_score FROM marked ORDER BY round(spike_score, 9) DESC, series_id, ts LIMIT 10", "marked",
)
def w21(spark, d):
    return v.marked(spark, d).orderBy(F.desc(F.round("spike_score", 9)), "series_id", "timestamp").limit(10)


@query(
    "w21_daily_peak", "series_id:s day:t peak_at:t peak:i",
    """SELECT series_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, ts AS peak_at, y AS peak FROM series
    QUALIFY row_number() OVER (PARTITION BY series_id, date_trunc('day', ts) ORDER BY y DESC, ts) = 1""",
    "series",
)
def w21_peak(spark, d):
    day = F.date_trunc("day", "timestamp").alias("day")
    return v.series(spark, d).groupBy("series_id", day).agg(
        F.min_by("timestamp", F.struct(-F.col("y"), F.col("timestamp"))).alias("peak_at"), F.max("y").alias("peak")
    )


@query("w22_largest_triangles", f"{AT} idx:i y:d")
def w22(spark, d):
    return largest_triangles(v.series(spark, d), 100, v.HOUR)


@query(
    "feature_table", f"{AT} y:i " + " ".join(f"{c}:{kind}" for c, (kind, _) in wide.COLUMNS.items()),
    'SELECT *, ts AS "timestamp" FROM wide', "wide",
)
def feature_table(spark, d):
    return wide.table(spark, d)


@query("f3_running_max", f"{AT} peak:d", f"SELECT {HEAD}, max(x) OVER ({BY} ROWS UNBOUNDED PRECEDING) AS peak FROM sparse", "sparse")
def f3_max(spark, d):
    return running(v.sparse(spark, d), SID, "timestamp", 900, {"peak": ("max", "x")}, v.SHORT_CHUNK)
