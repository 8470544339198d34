"""The stand-in views in SQL, for checking the Spark queries with another engine."""

from __future__ import annotations

from trafficlens.functions.logfields import EXTENSION_PATTERN, LINE_PATTERN, URL_RULES, VALID_STATUS
from trafficlens.operators.capacity import ScalingConfig


def extension_sql(url: str) -> str:
    return f"coalesce(nullif(lower(regexp_extract({url}, '{EXTENSION_PATTERN}', 1)), ''), 'none')"


def category_sql(url: str) -> str:
    rules = " ".join(f"WHEN regexp_matches({url}, '{p}') THEN '{label}'" for p, label in reversed(URL_RULES))
    return f"CASE {rules} ELSE 'other' END"


def status_class_sql(status: str) -> str:
    return (
        f"CASE WHEN {status} BETWEEN 1 AND 199 THEN '1xx' WHEN {status} BETWEEN 200 AND 299 THEN '2xx' "
        f"WHEN {status} BETWEEN 300 AND 399 THEN '3xx' WHEN {status} BETWEEN 400 AND 499 THEN '4xx' "
        f"WHEN {status} BETWEEN 500 AND 599 THEN '5xx' END"
    )


VALID_SQL = "(" + ", ".join(map(str, VALID_STATUS)) + ")"


def _part(i: int) -> str:
    return f"regexp_extract(value, '{LINE_PATTERN}', {i})"


# name -> (views it needs, SQL)
VIEWS: dict[str, tuple[str, str]] = {
    "lines": (
        "",
        """
        SELECT event_id * 2 + copy AS line_no,
          CASE WHEN event_id % 101 = 0 THEN 'garbage line ' || event_id ELSE
            'h' || user_id || '.example.com - - [' || strftime(date_trunc('second', ts), '%d/%b/%Y:%H:%M:%S') || ' -0400] "'
            || CASE event_type WHEN 'purchase' THEN 'POST' WHEN 'signup' THEN 'HEAD' ELSE 'GET' END || ' '
            || CASE event_type WHEN 'view' THEN '/images/i' || k || '.GIF'
                 WHEN 'click' THEN '/shuttle/p' || k || '.html?x=' || k
                 WHEN 'purchase' THEN '/cgi-bin/form' WHEN 'signup' THEN '/' ELSE '/history/x' || k END
            || ' HTTP/1.0" '
            || CASE WHEN event_id % 89 = 0 THEN 999 WHEN event_type = 'error' AND k < 50 THEN 404
                 WHEN event_type = 'error' THEN 500 WHEN event_type = 'click' AND k < 20 THEN 304 ELSE 200 END || ' '
            || CASE WHEN event_id % 31 = 0 THEN '-' WHEN event_id % 97 = 0 THEN '-1'
                 ELSE CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) END
          END AS value
        FROM (
          SELECT *, CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS k,
            unnest(CASE WHEN event_id % 50 = 0 THEN [0, 1] ELSE [0] END) AS copy
          FROM events
        )""",
    ),
    "parsed": (
        "lines",
        f"""
        SELECT line_no, {_part(1)} AS host, strptime(substr({_part(2)}, 1, 20), '%d/%b/%Y:%H:%M:%S') AS ts,
          substr({_part(2)}, 22) AS utc_offset, {_part(3)} AS method, {_part(4)} AS url, {_part(5)} AS protocol,
          CAST({_part(6)} AS INTEGER) AS status,
          CASE WHEN {_part(7)} = '-' THEN 0 ELSE CAST({_part(7)} AS BIGINT) END AS bytes
        FROM lines WHERE regexp_matches(value, '{LINE_PATTERN}')""",
    ),
    "dedup": (
        "parsed",
        "SELECT * FROM parsed QUALIFY row_number() OVER (PARTITION BY host, ts, url, method ORDER BY line_no) = 1",
    ),
    "fixed": (
        "dedup",
        f"""
        SELECT * REPLACE (greatest(bytes, 0) AS bytes), status IN {VALID_SQL} AS status_valid,
          {status_class_sql('status')} AS status_category, status >= 400 AS is_error, status = 200 AS is_success,
          {extension_sql('url')} AS extension, {category_sql('url')} AS url_category
        FROM dedup""",
    ),
    "fences": (
        "fixed",
        """
        SELECT q1, q3, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high
        FROM (SELECT quantile_cont(CAST(bytes AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(bytes AS DOUBLE), 0.75) AS q3 FROM fixed)""",
    ),
    "cleaned": ("fixed fences", "SELECT fixed.*, bytes < low OR bytes > high AS bytes_outlier FROM fixed, fences"),
    "traffic": (
        "cleaned",
        """
        SELECT g.ts, coalesce(n, 0) AS request_count, coalesce(hosts, 0) AS unique_hosts, coalesce(errors, 0) AS error_count,
          error_rate, success_rate, coalesce(total, 0) AS bytes_total, bytes_avg, bytes_max
        FROM (SELECT unnest(generate_series(min(date_trunc('hour', ts)), max(date_trunc('hour', ts)), INTERVAL 1 HOUR)) AS ts FROM cleaned) g
        LEFT JOIN (
          SELECT date_trunc('hour', ts) AS ts, count(*) AS n, count(DISTINCT host) AS hosts, sum(CAST(is_error AS INT)) AS errors,
            avg(CAST(is_error AS INT)) AS error_rate, avg(CAST(is_success AS INT)) AS success_rate,
            sum(bytes) AS total, avg(bytes) AS bytes_avg, max(bytes) AS bytes_max
          FROM cleaned GROUP BY 1) c ON c.ts = g.ts""",
    ),
    "series": (
        "",
        """
        SELECT g.series_id, g.ts, CAST(coalesce(c.y, 0) AS BIGINT) AS y
        FROM (
          SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts
          FROM (SELECT unnest([event_type, 'all']) AS series_id, date_trunc('hour', ts) AS ts FROM events) GROUP BY 1) g
        LEFT JOIN (
          SELECT series_id, ts, count(*) AS y
          FROM (SELECT unnest([event_type, 'all']) AS series_id, date_trunc('hour', ts) AS ts FROM events) GROUP BY 1, 2) c
        ON c.series_id = g.series_id AND c.ts = g.ts""",
    ),
    "numbered": (
        "series",
        """
        SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS place,
          count(*) OVER (PARTITION BY series_id) AS n_rows,
          row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS back FROM series""",
    ),
    "daily": (
        "",
        """
        SELECT g.series_id, g.ts, CAST(coalesce(c.y, 0) AS BIGINT) AS y
        FROM (SELECT l_returnflag AS series_id,
                unnest(generate_series(CAST(min(date_trunc('day', l_shipdate)) AS TIMESTAMP), CAST(max(date_trunc('day', l_shipdate)) AS TIMESTAMP), INTERVAL 1 DAY)) AS ts
              FROM lineitem GROUP BY 1) g
        LEFT JOIN (SELECT l_returnflag AS series_id, CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS ts, count(*) AS y FROM lineitem GROUP BY 1, 2) c
        ON c.series_id = g.series_id AND c.ts = g.ts""",
    ),
    "sparse": (
        "",
        """
        SELECT g.series_id, g.ts, coalesce(c.n, 0) AS n, c.x
        FROM (SELECT event_type AS series_id,
                unnest(generate_series(time_bucket(INTERVAL 15 MINUTE, min(ts)), time_bucket(INTERVAL 15 MINUTE, max(ts)), INTERVAL 15 MINUTE)) AS ts
              FROM events GROUP BY 1) g
        LEFT JOIN (SELECT event_type AS series_id, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, count(*) AS n, max(value) / 7.0::DOUBLE AS x FROM events GROUP BY 1, 2) c
        ON c.series_id = g.series_id AND c.ts = g.ts""",
    ),
    "loads": ("series", "SELECT series_id, ts, CAST(y * 100 AS DOUBLE) AS load FROM series"),
    "calendar": (
        "",
        """
        SELECT CAST(d AS DATE) AS date, type, name, impact FROM (VALUES
          ('2024-01-01', 1, 'New Year', 'low_traffic'), ('2024-01-10', 3, 'Outage Day 1', 'outage'),
          ('2024-01-11', 3, 'Outage Day 2', 'outage'), ('2024-01-12', 3, 'Outage Day 3', 'outage'),
          ('2024-01-15', 2, 'Campaign Day 1', 'high_traffic'), ('2024-01-16', 2, 'Campaign Day 2', 'high_traffic'),
          ('2024-01-17', 2, 'Campaign Day 3', 'high_traffic')) t(d, type, name, impact)""",
    ),
    "eventful": (
        "series calendar",
        """
        SELECT s.*, coalesce(type, 0) AS event_type, CASE WHEN type IS NULL THEN 0 ELSE 1 END AS is_special_event,
          coalesce(impact, 'normal') AS event_impact, coalesce(name, '') AS event_name
        FROM series s LEFT JOIN calendar ON calendar.date = CAST(s.ts AS DATE)""",
    ),
    "marked": (
        "series",
        """
        SELECT series_id, ts, y, spike_score, CAST(spike_score > 3 AS INT) AS is_spike, CAST(spike_score < -3 AS INT) AS is_dip,
          greatest(0, spike_score - 3) AS spike_magnitude,
          coalesce(CAST(abs(z) > 3 AS INT), 0) AS is_anomaly_ml, abs(z) / 3 AS anomaly_score_ml
        FROM (
          SELECT series_id, ts, y,
            coalesce((y - avg(y) OVER w15) / nullif(stddev_samp(y) OVER w15, 0), 0) AS spike_score,
            (y - avg(y) OVER w60) / CASE WHEN stddev_samp(y) OVER w60 = 0 THEN 1 ELSE stddev_samp(y) OVER w60 END AS z
          FROM series
          WINDOW w15 AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING),
                 w60 AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))""",
    ),
    "predictions": (
        "series",
        """
        SELECT model, series_id, ts, y, yhat FROM (
          SELECT 'seasonal' AS model, series_id, ts, y, CAST(lag(y, 24) OVER w AS DOUBLE) AS yhat FROM series
          WINDOW w AS (PARTITION BY series_id ORDER BY ts)
          UNION ALL
          SELECT 'moving', series_id, ts, y, avg(y) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) FROM series)
        WHERE yhat IS NOT NULL""",
    ),
    "features": (
        "series",
        """
        SELECT series_id, ts, y, lag(y, 1) OVER w AS lag_1, lag(y, 24) OVER w AS lag_24,
          avg(y) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS mean_3,
          avg(y) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS mean_4,
          avg(y) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS mean_24,
          hour(ts) AS hour
        FROM series WINDOW w AS (PARTITION BY series_id ORDER BY ts)""",
    ),
}


def _number(value) -> str:
    return f"{value!r}::DOUBLE" if isinstance(value, float) else str(value)


def config_rows(configs: dict[str, ScalingConfig], extra: str = "") -> str:
    """Configurations as a VALUES table: config_id, the twelve fields, capacity."""
    names = ["config_id", *ScalingConfig().to_dict(), "capacity"]
    rows = ", ".join(
        "(" + ", ".join([f"'{n}'", *[_number(v) for v in c.to_dict().values()], str(c.capacity_per_server)]) + ")"
        for n, c in configs.items()
    )
    return f"SELECT * FROM (VALUES {rows}) t({', '.join(names)}){extra}"


def add_views(more: dict[str, tuple[str, str]]) -> None:
    VIEWS.update(more)


def with_views(names) -> str:
    """WITH clause of the named views and everything they need."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for need in VIEWS[name][0].split():
            visit(need)
        order.append(name)

    for name in names:
        visit(name)
    if not order:
        return ""
    recursive = "RECURSIVE " if any(VIEWS[n][1].lstrip().startswith("/* recursive */") for n in order) else ""
    return f"WITH {recursive}" + ", ".join(f"{n} AS ({VIEWS[n][1].strip()})" for n in order) + " "


def run_rows(configs: dict[str, ScalingConfig]) -> str:
    """(config_id, policy) with the parameters each policy changes, and whether it follows the trend."""
    return f"""
        SELECT config_id, 'balanced' AS policy, false AS trend, c.* EXCLUDE (config_id) FROM ({config_rows(configs)}) c
        UNION ALL SELECT config_id, 'reactive', false, c.* EXCLUDE (config_id) REPLACE (1 AS scale_out_consecutive, 2 AS scale_in_consecutive, 3 AS cooldown_minutes) FROM ({config_rows(configs)}) c
        UNION ALL SELECT config_id, 'predictive', true, c.* EXCLUDE (config_id) REPLACE (0.75::DOUBLE AS scale_out_threshold, 2 AS scale_out_consecutive) FROM ({config_rows(configs)}) c"""


# The rule row by row: one step of the recursion per period, all runs side by side.
DECIDED = """/* recursive */
    SELECT l.series_id, r.config_id, r.policy, CAST(-1 AS BIGINT) AS place, CAST(NULL AS TIMESTAMP) AS ts, 0.0::DOUBLE AS load, CAST(r.min_servers AS BIGINT) AS servers,
      CAST(NULL AS TIMESTAMP) AS acted_at, CAST(0 AS BIGINT) AS high, CAST(0 AS BIGINT) AS low, 'hold' AS action, CAST(0 AS BIGINT) AS current_servers,
      0.0::DOUBLE AS utilization, '' AS reason, 1.0::DOUBLE AS after, 0.0::DOUBLE AS cost
    FROM (SELECT DISTINCT series_id FROM signals) l CROSS JOIN runs r
    UNION ALL
    SELECT series_id, config_id, policy, place, ts, load, target, CASE WHEN target <> servers THEN ts ELSE acted_at END,
      CASE WHEN target <> servers THEN 0 ELSE h END, CASE WHEN target <> servers THEN 0 ELSE w END,
      CASE WHEN target > servers THEN 'scale_out' WHEN target < servers THEN 'scale_in' ELSE 'hold' END, servers, used,
      CASE WHEN jump THEN 'predictive_pre_scale_trend_' || printf('%.2f', ratio) WHEN cooling THEN 'cooldown_active'
        WHEN is_high AND target > servers THEN 'high_utilization_' || h || '_periods' WHEN is_high THEN 'waiting_scale_out_' || h || '/' || scale_out_consecutive
        WHEN is_low AND target < servers THEN 'low_utilization_' || w || '_periods' WHEN is_low THEN 'waiting_scale_in_' || w || '/' || scale_in_consecutive
        ELSE 'normal_utilization' END,
      load / (target * capacity), target * cost_per_server_per_hour * time_window_minutes / 60
    FROM (
      SELECT *, CASE WHEN jump THEN need
          WHEN is_high AND h >= scale_out_consecutive AND least(servers + scale_out_increment, max_servers) > servers THEN least(servers + scale_out_increment, max_servers)
          WHEN is_low AND w >= scale_in_consecutive AND greatest(servers - scale_in_decrement, min_servers) < servers THEN greatest(servers - scale_in_decrement, min_servers)
          ELSE servers END AS target
      FROM (
        SELECT *, CASE WHEN is_high THEN high + 1 WHEN cooling THEN high ELSE 0 END AS h, CASE WHEN is_low THEN low + 1 WHEN cooling THEN low ELSE 0 END AS w
        FROM (
          SELECT *, NOT cooling AND NOT jump AND used > scale_out_threshold AS is_high, NOT cooling AND NOT jump AND used < scale_in_threshold AS is_low
          FROM (
            SELECT *, trend AND ratio > 1.05 AND NOT cooling AND need > servers AS jump
            FROM (
              SELECT d.series_id, d.config_id, d.policy, s.place, s.ts, s.load, s.ratio, d.servers, d.acted_at, d.high, d.low, r.* EXCLUDE (config_id, policy),
                d.acted_at IS NOT NULL AND s.ts < d.acted_at + r.cooldown_minutes * INTERVAL 1 MINUTE AS cooling, s.load / (d.servers * r.capacity) AS used,
                CASE WHEN s.load * s.ratio * 1.15::DOUBLE <= 0 THEN r.min_servers ELSE
                  greatest(r.min_servers, least(r.max_servers, CAST(floor(s.load * s.ratio * 1.15::DOUBLE / (r.capacity * 0.7::DOUBLE)) AS BIGINT) + 1)) END AS need
              FROM decided d JOIN signals s ON s.series_id = d.series_id AND s.place = d.place + 1 JOIN runs r ON r.config_id = d.config_id AND r.policy = d.policy)))))"""

VIEWS["signals"] = (
    "loads",
    """
    SELECT series_id, ts, load, place, CASE WHEN place >= 11 AND older > 0 THEN recent / older ELSE 1.0::DOUBLE END AS ratio FROM (
      SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS place,
        avg(load) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS recent,
        avg(load) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 11 PRECEDING AND 6 PRECEDING) AS older FROM loads)""",
)


def register_sweep(name: str, configs: dict[str, ScalingConfig]) -> None:
    """The plain rule under many configurations, as view ``name``, and its report as ``name_report``."""
    VIEWS[f"{name}_runs"] = ("", f"SELECT config_id, 'balanced' AS policy, false AS trend, c.* EXCLUDE (config_id) FROM ({config_rows(configs)}) c")
    VIEWS[name] = (f"signals {name}_runs", DECIDED.replace("FROM decided d", f"FROM {name} d").replace("JOIN runs r", f"JOIN {name}_runs r"))
    VIEWS[f"{name}_report"] = (
        name,
        f"""SELECT series_id, config_id, sum(cost) AS total_cost, avg(after) AS avg_utilization, count(*) FILTER (after > 1) AS sla_violations,
          count(*) FILTER (after > 1) / count(*) AS sla_violation_rate, count(*) FILTER (action <> 'hold') AS scaling_events, avg(servers) AS avg_servers
        FROM {name} WHERE place >= 0 GROUP BY 1, 2""",
    )


def register_configs(configs: dict[str, ScalingConfig]) -> None:
    """Views that depend on the configurations in use."""
    summary = """sum(cost) AS total_cost, sum(cost) / sum(hours) AS avg_cost_per_hour, avg(servers) AS avg_servers, max(servers) AS max_servers, min(servers) AS min_servers,
        avg(used) AS avg_utilization, max(used) AS max_utilization, count(*) FILTER (used > 1) AS sla_violations, count(*) FILTER (used > 1) / count(*) AS sla_violation_rate,
        count(*) FILTER (used < 0.3) AS wasted_periods"""
    VIEWS["configs"] = ("", config_rows(configs))
    VIEWS["runs"] = ("", run_rows(configs))
    VIEWS["decided"] = ("signals runs", DECIDED)
    VIEWS["replayed"] = (
        "decided",
        f"""SELECT series_id, config_id, policy, config_id || '/' || policy AS run_id, {summary}, count(*) FILTER (action = 'scale_out') AS scale_out_events,
          count(*) FILTER (action = 'scale_in') AS scale_in_events, count(*) FILTER (action <> 'hold') AS scaling_events
        FROM (SELECT *, after AS used, 1 AS hours FROM decided WHERE place >= 0) GROUP BY 1, 2, 3""",
    )
    VIEWS["optimal"] = (
        "loads configs",
        """SELECT series_id, config_id, CASE WHEN m <= 0 THEN min_servers ELSE greatest(min_servers, least(max_servers, CAST(floor(m / (capacity * 0.7::DOUBLE)) AS BIGINT) + 1)) END AS n
        FROM (SELECT series_id, avg(load) AS m FROM loads GROUP BY 1) l CROSS JOIN configs""",
    )
    VIEWS["fixed_runs"] = (
        "loads configs optimal",
        f"""SELECT series_id, config_id, strategy, {summary} FROM (
          SELECT l.series_id, c.config_id, strategy, servers, load / (servers * capacity) AS used, servers * cost_per_server_per_hour * time_window_minutes / 60 AS cost, time_window_minutes / 60 AS hours
          FROM loads l CROSS JOIN configs c JOIN (
            SELECT o.series_id, o.config_id, unnest(['fixed_min', 'fixed_max', 'fixed_optimal', 'fixed_8']) AS strategy, unnest([min_servers, max_servers, n, 8]) AS servers
            FROM optimal o JOIN configs c ON c.config_id = o.config_id) s ON s.series_id = l.series_id AND s.config_id = c.config_id) GROUP BY 1, 2, 3""",
    )
    VIEWS["strategies"] = (
        "replayed fixed_runs",
        """SELECT series_id, config_id, 'autoscale_' || policy AS strategy, total_cost, avg_cost_per_hour, avg_servers, avg_utilization, sla_violations, sla_violation_rate, wasted_periods, scaling_events FROM replayed
        UNION ALL SELECT series_id, config_id, strategy, total_cost, avg_cost_per_hour, avg_servers, avg_utilization, sla_violations, sla_violation_rate, wasted_periods, 0 FROM fixed_runs""",
    )
    VIEWS["results"] = (
        "fixed_runs",
        """SELECT series_id || '/' || config_id || '/' || strategy AS id, 'Run ' || series_id || ' ' || config_id AS name, CASE WHEN strategy = 'fixed_8' THEN 'eight servers' END AS description,
          TIMESTAMP '2024-02-01 00:00:00' + CAST(avg_servers AS BIGINT) * INTERVAL 1 HOUR AS created_at, config_id AS config_preset, strategy AS policy_type,
          total_cost, avg_servers, sla_violations, sla_violation_rate FROM fixed_runs""",
    )
