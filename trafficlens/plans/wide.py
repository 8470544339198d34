"""The whole feature table of the series: its columns, and each of them as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trafficlens.operators import features as fe
from trafficlens.plans import views as v

LAGS = (1, 2, 3, 6, 12, 24)
WINDOWS = (3, 12, 24)
NAME = "request_count"


def _past(n: int) -> str:
    return f"(PARTITION BY series_id ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def _columns() -> dict[str, tuple[str, str]]:
    """Column: kind and SQL over the rows of ``base`` (the series with events, marks, streaks and weighted moments)."""
    out: dict[str, tuple[str, str]] = {}
    lag = "lag(y, {k}) OVER w".format
    for k in LAGS:
        out[f"{NAME}_lag_{k}"] = ("i", lag(k=k))
    for k in LAGS:
        out[f"{NAME}_diff_{k}"] = ("i", f"y - {lag(k=k)}")
    for k in LAGS:
        out[f"{NAME}_pct_change_{k}"] = ("d", f"(y - {lag(k=k)}) / nullif({lag(k=k)}, 0)")
    for n in WINDOWS:
        out[f"{NAME}_rolling_mean_{n}"] = ("d", f"avg(y) OVER {_past(n)}")
        out[f"{NAME}_rolling_std_{n}"] = ("d", f"stddev_samp(y) OVER {_past(n)}")
        if n <= fe.MIN_MAX_UP_TO:
            low, high = f"min(y) OVER {_past(n)}", f"max(y) OVER {_past(n)}"
            out |= {f"{NAME}_rolling_min_{n}": ("i", low), f"{NAME}_rolling_max_{n}": ("i", high), f"{NAME}_rolling_range_{n}": ("i", f"{high} - {low}")}
    for n in WINDOWS:
        for label, p in (("median", 0.5), ("q25", 0.25), ("q75", 0.75)):
            out[f"{NAME}_rolling_{label}_{n}"] = ("d", f"quantile_cont(CAST(y AS DOUBLE), {p}) OVER {_past(n)}")
        out[f"{NAME}_rolling_cv_{n}"] = ("d", f"stddev_samp(y) OVER {_past(n)} / nullif(avg(y) OVER {_past(n)}, 0)")
    out |= {"spike_score": ("d", "spike_score"), "is_spike": ("i", "is_spike"), "is_dip": ("i", "is_dip"), "spike_magnitude": ("d", "spike_magnitude")}
    day = lag(k=24)
    out |= {
        f"{NAME}_direction": ("i", f"sign(y - {lag(k=1)})"),
        f"{NAME}_vs_yesterday": ("i", f"y - {day}"),
        f"{NAME}_vs_yesterday_pct": ("d", f"(y - {day}) / nullif({day}, 0)"),
    }
    mean, std = f"avg(y) OVER {_past(15)}", f"stddev_samp(y) OVER {_past(15)}"
    out |= {
        f"{NAME}_cv": ("d", f"coalesce({std} / nullif({mean}, 0), 0)"),
        f"{NAME}_bb_upper": ("d", f"{mean} + 2 * {std}"), f"{NAME}_bb_lower": ("d", f"{mean} - 2 * {std}"), f"{NAME}_bb_width": ("d", f"4 * {std}"),
        f"{NAME}_velocity": ("i", f"y - {lag(k=1)}"),
        f"{NAME}_acceleration": ("i", f"y - 2 * {lag(k=1)} + {lag(k=2)}"),
        f"{NAME}_momentum": ("i", f"CASE WHEN {lag(k=1)} IS NOT NULL THEN y - first_value(y) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) END"),
        "is_anomaly_ml": ("i", "is_anomaly_ml"), "anomaly_score_ml": ("d", "anomaly_score_ml"),
        f"{NAME}_trend": ("d4", "CASE WHEN place > 0 THEN regr_slope(y, place) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) END"),
        "anomaly_agreement": ("i", "CAST(is_spike = 1 AND is_anomaly_ml = 1 AS INT)"),
        f"{NAME}_pct_of_max": ("d", "coalesce(y / nullif(max(y) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)"),
        f"{NAME}_streak": ("d", "streak"),
    }
    for s in fe.EWM_SPANS:
        out |= {f"{NAME}_ewm_mean_{s}": ("d4", f"ewm_mean_{s}"), f"{NAME}_ewm_std_{s}": ("d4", f"ewm_std_{s}")}
    out |= {
        "year": ("i", "year(ts)"), "month": ("i", "month(ts)"), "day": ("i", "day(ts)"), "hour": ("i", "hour(ts)"), "minute": ("i", "minute(ts)"),
        "day_of_week": ("i", "isodow(ts) - 1"), "day_of_year": ("i", "dayofyear(ts)"), "week_of_year": ("i", "weekofyear(ts)"),
        "is_weekend": ("i", "CAST(isodow(ts) >= 6 AS INT)"), "is_business_hour": ("i", "CAST(hour(ts) BETWEEN 8 AND 17 AS INT)"), "is_peak_hour": ("i", "CAST(hour(ts) BETWEEN 11 AND 16 AS INT)"),
    }
    cycles = {"hour": ("hour(ts)", 24), "dow": ("(isodow(ts) - 1)", 7), "dom": ("day(ts)", 31), "month": ("month(ts)", 12), "mod": ("(hour(ts) * 60 + minute(ts))", 1440)}
    for name, (value, period) in cycles.items():
        out |= {f"{name}_{f}": ("d", f"{f}({value} * (2 * pi() / {period}))") for f in ("sin", "cos")}
    return out | {"event_type": ("i", "event_type"), "is_special_event": ("i", "is_special_event")}


COLUMNS = _columns()
FEATURES = tuple(COLUMNS)


def _weighted_sql() -> str:
    """Weighted means and deviations of the earlier rows, a self-join back to where a weight fades."""
    parts = []
    for span in fe.EWM_SPANS:
        r, reach = 1 - 2 / (span + 1), fe.ewm_reach(span)
        weight = f"pow({r!r}, a.place - b.place - 1)"
        parts.append(
            f"""SELECT a.series_id, a.ts, {span} AS span, sum({weight}) AS w, sum({weight} * {weight}) AS w2, sum({weight} * b.y) AS wx, sum({weight} * b.y * b.y) AS wxx, count(b.y) AS seen
            FROM numbered a LEFT JOIN numbered b ON a.series_id = b.series_id AND b.place BETWEEN a.place - {reach} AND a.place - 1 GROUP BY 1, 2"""
        )
    std = "CASE WHEN seen > 1 THEN sqrt(greatest(wxx / w - (wx / w) * (wx / w), 0) * w * w / (w * w - w2)) END"
    picks = ", ".join(f"max(wx / w) FILTER (span = {s}) AS ewm_mean_{s}, max({std}) FILTER (span = {s}) AS ewm_std_{s}" for s in fe.EWM_SPANS)
    return f"SELECT series_id, ts, {picks} FROM ({' UNION ALL '.join(parts)}) GROUP BY 1, 2"


STREAKS = """SELECT series_id, ts, dir * row_number() OVER (PARTITION BY series_id, run ORDER BY ts) AS streak FROM (
  SELECT *, sum(changed) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM (
    SELECT *, CASE WHEN dir IS DISTINCT FROM lag(dir) OVER w THEN 1 ELSE 0 END AS changed FROM (
      SELECT series_id, ts, sign(y - lag(y) OVER w) AS dir FROM series WINDOW w AS (PARTITION BY series_id ORDER BY ts)) WINDOW w AS (PARTITION BY series_id ORDER BY ts)))"""

TABLE_SQL = (
    "SELECT series_id, ts, y, " + ", ".join(f"{sql} AS {name}" for name, (_, sql) in COLUMNS.items())
    + f""" FROM (SELECT e.*, place, spike_score, is_spike, is_dip, spike_magnitude, is_anomaly_ml, anomaly_score_ml, streak, {", ".join(f"ewm_mean_{s}, ewm_std_{s}" for s in fe.EWM_SPANS)}
      FROM eventful e JOIN numbered n ON n.series_id = e.series_id AND n.ts = e.ts JOIN marked m ON m.series_id = e.series_id AND m.ts = e.ts
      JOIN ({STREAKS}) k ON k.series_id = e.series_id AND k.ts = e.ts JOIN ({_weighted_sql()}) x ON x.series_id = e.series_id AND x.ts = e.ts)
    WINDOW w AS (PARTITION BY series_id ORDER BY ts)"""
)

#: The table in long form without nulls: (series_id, ts, y, i, f, x), i being the place of column f.
LONG_SQL = (
    f"SELECT * FROM (SELECT series_id, ts, CAST(y AS DOUBLE) AS y, unnest(range({len(FEATURES)})) AS i, unnest([{', '.join(f'{chr(39)}{c}{chr(39)}' for c in FEATURES)}]) AS f, "
    f"unnest([{', '.join(f'round(CAST({c} AS DOUBLE), 6)' for c in FEATURES)}]) AS x FROM wide) WHERE x IS NOT NULL"
)

VIEWS = {"wide": ("eventful numbered marked series", TABLE_SQL), "wide_long": ("wide", LONG_SQL)}


def table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table of all series: keys, ``y``, every column of ``FEATURES`` and the names of events."""
    return fe.traffic_features(v.series(spark, sf_dir), ("series_id",), v.HOUR, lags=LAGS, windows=WINDOWS, calendar=v.calendar(spark), extended=True)
