"""Queries over capacity, scaling decisions, cost reports and the table of saved runs."""

from __future__ import annotations

from dataclasses import replace
from itertools import product

from pyspark.sql import functions as F

from trafficlens.operators import capacity as cp
from trafficlens.operators import forecast as fc
from trafficlens.operators import reports as rp
from trafficlens.operators import results as rs
from trafficlens.operators.decisions import decide
from trafficlens.plans import sqlviews
from trafficlens.plans import views as v
from trafficlens.plans.registry import query
from trafficlens.session import cut_lineage, scratch_path
from trafficlens.sources import tables as tb

SID = ["series_id"]
AT = "series_id:s timestamp:t"
MINUTES = 60
# The presets for hourly loads; cooldowns are long enough to cover whole rows.
CONFIGS = {
    name: replace(c, requests_per_server=10, time_window_minutes=MINUTES, cooldown_minutes=c.cooldown_minutes * 18)
    for name, c in cp.PRESETS.items()
}
GRID = cp.threshold_grid(CONFIGS["balanced"])
POLICIES = ("balanced", "reactive", "predictive")
FIXED = {"fixed_min": "min", "fixed_max": "max", "fixed_optimal": "optimal", "fixed_8": 8}
SWEEP = {
    f"cool{c}_out{o}_in{i}": replace(CONFIGS["balanced"], cooldown_minutes=c, scale_out_consecutive=o, scale_in_consecutive=i)
    for c, o, i in product((0, 60, 120, 240), (1, 2, 3), (2, 3, 6, 10))
}
sqlviews.register_configs(CONFIGS)
sqlviews.register_sweep("grid", GRID)
sqlviews.register_sweep("sweep", SWEEP)

LC = "loads l CROSS JOIN configs c"
RUN = "series_id:s config_id:s policy:s"


def _crossed(spark, d, configs=None):
    return cp.with_configs(v.loads(spark, d), configs or CONFIGS)


def _decided(spark, d, configs=None, policies=POLICIES):
    return decide(v.loads(spark, d), configs or CONFIGS, v.HOUR, policies)


def _replayed(spark, d):
    out = rp.replay_report(_decided(spark, d), MINUTES)
    return out.withColumn("run_id", F.concat_ws("/", "config_id", "policy"))


def _fixed(spark, d):
    return rp.fixed_report(v.loads(spark, d), CONFIGS, FIXED)


def _strategies(spark, d):
    return rp.strategy_table(_replayed(spark, d), _fixed(spark, d))


@query(
    "c1_configs", "series_id:s config_id:s min_servers:i max_servers:i scale_out_threshold:d scale_in_threshold:d scale_out_consecutive:i scale_in_consecutive:i cooldown_minutes:i capacity:i n:i",
    """SELECT series_id, config_id, min_servers, max_servers, scale_out_threshold, scale_in_threshold, scale_out_consecutive, scale_in_consecutive, cooldown_minutes, capacity, count(*) AS n
    FROM loads CROSS JOIN configs GROUP BY ALL""", "loads configs",
)
def c1(spark, d):
    cols = ["series_id", "config_id", "min_servers", "max_servers", "scale_out_threshold", "scale_in_threshold", "scale_out_consecutive", "scale_in_consecutive", "cooldown_minutes", "capacity"]
    return _crossed(spark, d).groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


@query(
    "c2_capacity", f"{AT} config_id:s capacity:i total_capacity:i",
    f'SELECT series_id, ts AS "timestamp", config_id, requests_per_server * time_window_minutes // 5 AS capacity, 4 * (requests_per_server * time_window_minutes // 5) AS total_capacity FROM {LC}', "loads configs",
)
def c2(spark, d):
    return _crossed(spark, d).withColumn("total_capacity", F.lit(4) * F.col("capacity"))


@query("c3_utilization", f"{AT} config_id:s utilization:d", f'SELECT series_id, ts AS "timestamp", config_id, load / (4 * capacity) AS utilization FROM {LC}', "loads configs")
def c3(spark, d):
    return _crossed(spark, d).withColumn("utilization", cp.utilization(F.col("load"), F.lit(4), F.col("capacity")))


NEED = "CASE WHEN {0} <= 0 THEN min_servers ELSE greatest(min_servers, least(max_servers, CAST(floor({0} / (capacity * 0.7::DOUBLE)) AS BIGINT) + 1)) END"


@query("c4_required", f"{AT} config_id:s required:i", f'SELECT series_id, ts AS "timestamp", config_id, {NEED.format("load")} AS required FROM {LC}', "loads configs")
def c4(spark, d):
    return _crossed(spark, d).withColumn("required", cp.required_servers(F.col("load")))


@query(
    "c5_period_cost", f"{AT} config_id:s cost:d",
    f'SELECT series_id, ts AS "timestamp", config_id, ({NEED.format("load")}) * cost_per_server_per_hour * time_window_minutes / 60 AS cost FROM {LC}', "loads configs",
)
def c5(spark, d):
    return _crossed(spark, d).withColumn("cost", cp.period_cost(cp.required_servers(F.col("load"))))


DECISION = f"{RUN} timestamp:t load:d action:s current_servers:i target_servers:i utilization:d reason:s"
DECISION_SQL = """SELECT series_id, config_id, policy, ts AS "timestamp", load, action, current_servers, servers AS target_servers, utilization, reason FROM decided WHERE place >= 0 AND policy = '{}'"""


@query("c6_threshold_rule", DECISION, DECISION_SQL.format("balanced"), "decided")
def c6(spark, d):
    return _decided(spark, d, policies=("balanced",))


@query("c7_reactive_rule", DECISION, DECISION_SQL.format("reactive"), "decided")
def c7(spark, d):
    return _decided(spark, d, policies=("reactive",))


@query("c8_trend_rule", DECISION, DECISION_SQL.format("predictive"), "decided")
def c8(spark, d):
    return _decided(spark, d, policies=("predictive",))


@query(
    "c9_effective_load", f"{AT} effective:d",
    """SELECT series_id, ts AS "timestamp", 0.7 * sum(load / (i + 1)) / sum(1.0::DOUBLE / (i + 1)) + 0.3 * max(load) AS effective FROM (
      SELECT a.series_id, a.place, a.ts, b.place - a.place AS i, b.y * 100.0::DOUBLE AS load FROM numbered a JOIN numbered b ON b.series_id = a.series_id AND b.place BETWEEN a.place AND a.place + 5)
    GROUP BY series_id, ts""",
    "numbered",
)
def c9(spark, d):
    from trafficlens.operators.scale import halo

    rows = halo(v.loads(spark, d), SID, "timestamp", v.HOUR, lambda w: {"ahead": F.collect_list("load").over(w.rowsBetween(0, 5))}, ahead=5)
    return rows.withColumn("effective", cp.effective_load(F.col("ahead")))


@query(
    "c10_forecast_peak", f"{AT} config_id:s peak:d required:i",
    f"""SELECT series_id, ts AS "timestamp", config_id, peak, {NEED.format("peak")} AS required FROM (
      SELECT *, max(load) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) * 1.15::DOUBLE AS peak FROM loads) l CROSS JOIN configs c""",
    "loads configs",
)
def c10(spark, d):
    from trafficlens.operators.scale import halo

    rows = halo(v.loads(spark, d), SID, "timestamp", v.HOUR, lambda w: {"peak": F.max("load").over(w.rowsBetween(0, 6)) * 1.15}, ahead=6)
    return cp.with_configs(rows, CONFIGS).withColumn("required", cp.required_servers(F.col("peak")))


@query("c10_forecast_rule", DECISION)
def c10_rule(spark, d):
    return _decided(spark, d, policies=("forecast",))


REPORT = (
    f"{RUN} total_cost:d4 avg_cost_per_hour:d avg_servers:d max_servers:i min_servers:i avg_utilization:d max_utilization:d sla_violations:i sla_violation_rate:d "
    "wasted_periods:i scale_out_events:i scale_in_events:i scaling_events:i"
)


@query("c11_replay_report", REPORT, "SELECT * FROM replayed", "replayed")
def c11(spark, d):
    return _replayed(spark, d)


@query(
    "c12_fixed_report",
    "series_id:s config_id:s strategy:s total_cost:d4 avg_cost_per_hour:d avg_servers:d avg_utilization:d max_utilization:d sla_violations:i sla_violation_rate:d wasted_periods:i",
    "SELECT * FROM fixed_runs", "fixed_runs",
)
def c12(spark, d):
    return _fixed(spark, d)


STRATEGY = "series_id:s config_id:s strategy:s total_cost:d4 avg_cost_per_hour:d avg_servers:d avg_utilization:d sla_violations:i sla_violation_rate:d wasted_periods:i scaling_events:i"


@query("c13_strategies", STRATEGY, "SELECT * FROM strategies", "strategies")
def c13(spark, d):
    return _strategies(spark, d)


@query(
    "c14_savings", "series_id:s config_id:s strategy:s cost_savings:d4 cost_savings_pct:d4 avg_servers_saved:d sla_impact:i",
    """SELECT s.series_id, s.config_id, s.strategy, f.total_cost - s.total_cost AS cost_savings, coalesce((f.total_cost - s.total_cost) * 100 / nullif(f.total_cost, 0), 0) AS cost_savings_pct,
      f.avg_servers - s.avg_servers AS avg_servers_saved, s.sla_violations - f.sla_violations AS sla_impact
    FROM strategies s JOIN strategies f ON f.series_id = s.series_id AND f.config_id = s.config_id AND f.strategy = 'fixed_max' WHERE s.strategy <> 'fixed_max'""",
    "strategies",
)
def c14(spark, d):
    return rp.savings(_strategies(spark, d))


GRID_COLUMNS = "series_id:s config_id:s total_cost:d4 avg_utilization:d sla_violations:i sla_violation_rate:d scaling_events:i avg_servers:d"


@query("c15_threshold_grid", GRID_COLUMNS, "SELECT * FROM grid_report", "grid_report")
def c15(spark, d):
    return rp.replay_report(_decided(spark, d, GRID, ("balanced",)), MINUTES)


@query(
    "c16_cheapest_within_sla", "series_id:s run_id:s total_cost:d4 sla_violation_rate:d meets_sla:b",
    """SELECT series_id, run_id, total_cost, sla_violation_rate, bool_or(sla_violation_rate <= 0.05) OVER (PARTITION BY series_id) AS meets_sla FROM replayed
    QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY sla_violation_rate > 0.05, CASE WHEN sla_violation_rate <= 0.05 THEN round(total_cost, 6) ELSE sla_violation_rate END, run_id) = 1""",
    "replayed",
)
def c16(spark, d):
    rows = _replayed(spark, d).withColumn("total_cost", F.round("total_cost", 6))
    return rp.best_under(rows, 0.05, label="run_id")


@query("c17_joint_sweep", GRID_COLUMNS, "SELECT * FROM sweep_report", "sweep_report")
def c17(spark, d):
    return rp.replay_report(_decided(spark, d, SWEEP, ("balanced",)), MINUTES)


@query(
    "c18_matrix_winners", "series_id:s best_cost:s best_sla:s best_balanced:s",
    """SELECT series_id, arg_min(run_id, (round(total_cost, 6), run_id)) AS best_cost, arg_min(run_id, (sla_violations, run_id)) AS best_sla, arg_min(run_id, (round(balance, 9), run_id)) AS best_balanced FROM (
      SELECT *, (total_cost - min(total_cost) OVER p) / (max(total_cost) OVER p - min(total_cost) OVER p + 1e-10::DOUBLE)
        + (sla_violations - min(sla_violations) OVER p) / (max(sla_violations) OVER p - min(sla_violations) OVER p + 1e-10::DOUBLE) AS balance
      FROM replayed WINDOW p AS (PARTITION BY series_id)) GROUP BY 1""",
    "replayed",
)
def c18(spark, d):
    rows = _replayed(spark, d).withColumn("total_cost", F.round("total_cost", 6))
    return rp.matrix_winners(rows)


@query(
    "c19_recommendation", "series_id:s run_id:s total_cost:d4 sla_violations:i sla_risk:s peak_risk:s savings:d4 savings_pct:d4 cost_spread:d4",
    """SELECT b.series_id, b.run_id, b.total_cost, b.sla_violations, CASE WHEN b.sla_violation_rate < 0.01 THEN 'low' WHEN b.sla_violation_rate < 0.05 THEN 'medium' ELSE 'high' END AS sla_risk,
      CASE WHEN peak / mean > 3 THEN 'high' WHEN peak / mean > 2 THEN 'medium' ELSE 'low' END AS peak_risk, f.total_cost - b.total_cost AS savings,
      (f.total_cost - b.total_cost) * 100 / f.total_cost AS savings_pct, spread AS cost_spread
    FROM (SELECT * FROM (SELECT *, bool_or(sla_violation_rate <= 0.05) OVER (PARTITION BY series_id) AS any_fit FROM replayed)
      QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY any_fit AND sla_violation_rate > 0.05, round(total_cost, 6), run_id) = 1) b
    JOIN (SELECT series_id, max(load) AS peak, avg(load) AS mean FROM loads GROUP BY 1) l ON l.series_id = b.series_id
    JOIN fixed_runs f ON f.series_id = b.series_id AND f.config_id = b.config_id AND f.strategy = 'fixed_max'
    JOIN (SELECT series_id, config_id, policy, stddev_pop(cost) * count(*) AS spread FROM decided WHERE place >= 0 GROUP BY 1, 2, 3) s
      ON s.series_id = b.series_id AND s.config_id = b.config_id AND s.policy = b.policy""",
    "replayed fixed_runs decided",
)
def c19(spark, d):
    # The decisions feed three reports: fold once, keep the result in the shared folder.
    decisions = cut_lineage(spark, _decided(spark, d), "decisions")
    reports = rp.replay_report(decisions, MINUTES).withColumns({"run_id": F.concat_ws("/", "config_id", "policy"), "total_cost": F.round("total_cost", 6)})
    fixed = _fixed(spark, d).where(F.col("strategy") == "fixed_max")
    return rp.recommend(reports, v.loads(spark, d), "cost", 0.05, fixed_max=fixed, decisions=decisions)


@query(
    "c20_cost_projection", "series_id:s config_id:s cost_7d:d4 cost_14d:d4 cost_30d:d4 total_cost:d4",
    f"""SELECT series_id, config_id, sum(cost) FILTER (step < 168) AS cost_7d, sum(cost) FILTER (step < 336) AS cost_14d, sum(cost) FILTER (step < 720) AS cost_30d, sum(cost) AS total_cost FROM (
      SELECT series_id, config_id, step, ({NEED.format("yhat")}) * cost_per_server_per_hour * time_window_minutes / 60 AS cost FROM (
        SELECT f.series_id, f.step, greatest(0, m * (1 + 0.01 * step + 0.1 * ((step % 12) - 6) / 6)) * 100 AS yhat
        FROM (SELECT series_id, unnest(range(800)) AS step FROM series GROUP BY 1) f JOIN (SELECT series_id, avg(y) AS m FROM numbered WHERE back <= 12 GROUP BY 1) r ON r.series_id = f.series_id)
      CROSS JOIN configs) GROUP BY 1, 2""",
    "numbered configs",
)
def c20(spark, d):
    ahead = fc.moving_average(v.series(spark, d), 800, v.HOUR).withColumn("yhat", F.col("yhat") * 100)
    return rp.cost_projection(ahead, CONFIGS, 24, (7, 14, 30))


@query(
    "c21_cost_report", "series_id:s config_id:s policy:s total_cost:d4 fixed_min:d4 fixed_max:d4 fixed_optimal:d4 saved_vs_max:d4 saved_pct:d4",
    """SELECT r.series_id, r.config_id, policy, r.total_cost, a.total_cost AS fixed_min, b.total_cost AS fixed_max, o.total_cost AS fixed_optimal, b.total_cost - r.total_cost AS saved_vs_max,
      coalesce((b.total_cost - r.total_cost) * 100 / nullif(b.total_cost, 0), 0) AS saved_pct
    FROM replayed r JOIN fixed_runs a ON a.series_id = r.series_id AND a.config_id = r.config_id AND a.strategy = 'fixed_min'
    JOIN fixed_runs b ON b.series_id = r.series_id AND b.config_id = r.config_id AND b.strategy = 'fixed_max'
    JOIN fixed_runs o ON o.series_id = r.series_id AND o.config_id = r.config_id AND o.strategy = 'fixed_optimal'""",
    "replayed fixed_runs",
)
def c21(spark, d):
    return rp.cost_report(_replayed(spark, d), _fixed(spark, d))


@query(
    "c22_hourly_costs", f"{RUN} mean:d std:d min:d max:d",
    "SELECT series_id, config_id, policy, avg(c) AS mean, stddev_pop(c) AS std, min(c) AS min, max(c) AS max FROM (SELECT series_id, config_id, policy, date_trunc('hour', ts) AS h, sum(cost) AS c FROM decided WHERE place >= 0 GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3",
    "decided",
)
def c22(spark, d):
    return rp.hourly_costs(_decided(spark, d))


@query(
    "c23_selection_score", "series_id:s run_id:s score:d4",
    "SELECT series_id, arg_min(run_id, (round(total_cost + sla_violations * 2.5, 6), run_id)) AS run_id, min(total_cost + sla_violations * 2.5) AS score FROM replayed GROUP BY 1", "replayed",
)
def c23(spark, d):
    return rp.config_scores(_replayed(spark, d).withColumn("total_cost", F.round("total_cost", 6)), 2.5)


@query(
    "c24_breach_runs", f"{AT} config_id:s utilization:d breach:s run_length:i",
    """SELECT series_id, ts AS "timestamp", config_id, utilization, breach, CASE WHEN breach = 'normal' THEN 0 ELSE row_number() OVER (PARTITION BY series_id, config_id, run ORDER BY ts) END AS run_length FROM (
      SELECT *, sum(changed) OVER (PARTITION BY series_id, config_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM (
        SELECT *, CASE WHEN breach IS DISTINCT FROM lag(breach) OVER (PARTITION BY series_id, config_id ORDER BY ts) THEN 1 ELSE 0 END AS changed FROM (
          SELECT series_id, ts, config_id, load / (4 * capacity) AS utilization,
            CASE WHEN load / (4 * capacity) > scale_out_threshold THEN 'over' WHEN load / (4 * capacity) < scale_in_threshold THEN 'under' ELSE 'normal' END AS breach FROM loads CROSS JOIN configs)))""",
    "loads configs",
)
def c24(spark, d):
    return rp.breach_runs(v.loads(spark, d), CONFIGS, 4, v.HOUR)


@query(
    "c25_overview", "series_id:s config_id:s strategy:s total_cost:d4 cost_per_server:d4",
    """SELECT series_id, config_id, strategy, total_cost, total_cost / avg_servers AS cost_per_server FROM strategies WHERE sla_violations <= 30
    QUALIFY row_number() OVER (PARTITION BY series_id, config_id ORDER BY round(total_cost, 6), strategy) = 1""",
    "strategies",
)
def c25(spark, d):
    return rp.overview(_strategies(spark, d).withColumn("total_cost", F.round("total_cost", 6)), 30)


@query("j4_loads_by_config", f"{AT} config_id:s load:d scale_out_threshold:d", f'SELECT series_id, ts AS "timestamp", config_id, load, scale_out_threshold FROM {LC}', "loads configs")
def j4(spark, d):
    return _crossed(spark, d)


@query(
    "j6_pareto_runs", "series_id:s run_id:s total_cost:d4 sla_violation_rate:d pareto_optimal:b",
    """SELECT series_id, run_id, total_cost, sla_violation_rate, NOT EXISTS (SELECT 1 FROM r o WHERE o.series_id = r.series_id AND
      ((o.total_cost <= r.total_cost AND o.sla_violation_rate < r.sla_violation_rate) OR (o.total_cost < r.total_cost AND o.sla_violation_rate <= r.sla_violation_rate))) AS pareto_optimal
    FROM r""".replace("FROM r", "FROM (SELECT series_id, run_id, round(total_cost, 6) AS total_cost, sla_violation_rate FROM replayed) r").replace(
        "FROM (SELECT series_id, run_id, round(total_cost, 6) AS total_cost, sla_violation_rate FROM replayed) r o",
        "FROM (SELECT series_id, round(total_cost, 6) AS total_cost, sla_violation_rate FROM replayed) o",
    ),
    "replayed",
)
def j6_runs(spark, d):
    return rp.pareto(_replayed(spark, d).withColumn("total_cost", F.round("total_cost", 6)))


def _runs(spark, d):
    at = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("avg_servers").cast("int"))
    return _fixed(spark, d).select(
        F.concat_ws("/", "series_id", "config_id", "strategy").alias("id"), F.concat(F.lit("Run "), "series_id", F.lit(" "), "config_id").alias("name"),
        F.when(F.col("strategy") == "fixed_8", "eight servers").alias("description"), at.alias("created_at"), F.col("config_id").alias("config_preset"),
        F.col("strategy").alias("policy_type"), "total_cost", "avg_servers", "sla_violations", "sla_violation_rate",
    )


def _saved(spark, d):
    path = scratch_path(spark, "runs")
    rs.save_runs(_runs(spark, d), path)
    return rs.load_runs(spark, path), path


RESULT = "id:s name:s created_at:t config_preset:s policy_type:s total_cost:d4 sla_violations:i"


@query("s16_save_runs", RESULT, "SELECT * FROM results", "results")
def s16(spark, d):
    return _saved(spark, d)[0]


@query(
    "s16_load_hash", "series_id:s data_hash:s",
    """SELECT series_id, sha256(string_agg(h, ',' ORDER BY b)) AS data_hash FROM (
      SELECT series_id, floor(epoch(ts) / (3600 * 4096)) AS b, sha256(string_agg(CAST(load AS VARCHAR), ',' ORDER BY ts)) AS h FROM loads GROUP BY 1, 2) GROUP BY 1""",
    "loads",
)
def s16_hash(spark, d):
    return rs.load_hash(v.loads(spark, d), SID)


@query("s15_export_report", "series_id:s config_id:s policy:s total_cost:d4 sla_violations:i", "SELECT * FROM replayed WHERE policy = 'balanced'", "replayed")
def s15(spark, d):
    decisions = cut_lineage(spark, _decided(spark, d, policies=("balanced",)), "decisions")
    report = rp.replay_report(decisions, MINUTES)
    paths = tb.export_report(report, decisions, scratch_path(spark, "export"))
    return tb.load(spark, paths["metrics"], "csv", report.schema)


@query("r1_get_run", RESULT, "SELECT * FROM results WHERE id = 'all/balanced/fixed_max'", "results")
def r1(spark, d):
    return rs.get_run(_saved(spark, d)[0], "all/balanced/fixed_max")


@query("r2_list_runs", RESULT, "SELECT * FROM results WHERE config_preset = 'balanced' AND (name ILIKE '%CLICK%' OR coalesce(description, '') ILIKE '%CLICK%') ORDER BY created_at DESC, id LIMIT 3 OFFSET 1", "results")
def r2(spark, d):
    return rs.list_runs(_saved(spark, d)[0], limit=3, offset=1, preset="balanced", search="CLICK")


@query("r3_delete_run", RESULT, "SELECT * FROM results WHERE id <> 'view/balanced/fixed_8'", "results")
def r3(spark, d):
    _, path = _saved(spark, d)
    rs.delete_run(spark, path, "view/balanced/fixed_8")
    return rs.load_runs(spark, path)


@query("r4_compare_runs", RESULT, "SELECT * FROM results WHERE id IN ('all/balanced/fixed_max', 'view/aggressive/fixed_8')", "results")
def r4(spark, d):
    return rs.compare_runs(_saved(spark, d)[0], ["all/balanced/fixed_max", "view/aggressive/fixed_8"])


@query("r5_totals", "total_results:i avg_cost:d4 avg_sla_violation_rate:d", "SELECT count(*) AS total_results, avg(total_cost) AS avg_cost, avg(sla_violation_rate) AS avg_sla_violation_rate FROM results", "results")
def r5(spark, d):
    return rs.totals(_saved(spark, d)[0])


@query("r5_counts", "field:s item:s n:i", "SELECT 'preset' AS field, config_preset AS item, count(*) AS n FROM results GROUP BY 2 UNION ALL SELECT 'policy', policy_type, count(*) FROM results GROUP BY 2", "results")
def r5_counts(spark, d):
    runs = _saved(spark, d)[0]
    preset = rs.counts_by(runs, "config_preset").select(F.lit("preset").alias("field"), F.col("config_preset").alias("item"), "n")
    return preset.unionByName(rs.counts_by(runs, "policy_type").select(F.lit("policy").alias("field"), F.col("policy_type").alias("item"), "n"))
