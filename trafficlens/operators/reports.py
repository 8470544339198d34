"""Cost, SLA and strategy reports over decisions or fixed capacities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.functions.values import epoch_seconds, floor_time, ratio
from trafficlens.operators.capacity import ScalingConfig, period_cost, required_servers, utilization, with_configs
from trafficlens.operators.scale import CHUNK_ROWS, prefix_min, run_starts, running

SID = ("series_id",)
RUN = ("config_id", "policy")


def _summary(servers: Column, used: Column, cost: Column, hours: Column) -> list[Column]:
    n = F.count(F.lit(1))
    over = F.count_if(used > 1.0)
    return [
        F.sum(cost).alias("total_cost"),
        ratio(F.sum(cost), F.sum(hours)).alias("avg_cost_per_hour"),
        F.avg(servers).alias("avg_servers"),
        F.max(servers).alias("max_servers"),
        F.min(servers).alias("min_servers"),
        F.avg(used).alias("avg_utilization"),
        F.max(used).alias("max_utilization"),
        over.alias("sla_violations"),
        (over / n).alias("sla_violation_rate"),
        F.count_if(used < 0.3).alias("wasted_periods"),
    ]


def replay_report(decisions: DataFrame, minutes: int, keys: Sequence[str] = SID) -> DataFrame:
    """Metrics of every run. Utilization counts after the decision took effect."""
    events = [F.count_if(F.col("action") == a).alias(f"{a}_events") for a in ("scale_out", "scale_in")]
    out = decisions.groupBy(*keys, *RUN).agg(
        *_summary(F.col("target_servers"), F.col("utilization_after"), F.col("cost"), F.lit(minutes / 60)), *events
    )
    return out.withColumn("scaling_events", F.col("scale_out_events") + F.col("scale_in_events"))


def fixed_report(
    loads: DataFrame, configs: dict[str, ScalingConfig], servers: dict[str, int | str], keys: Sequence[str] = SID, load: str = "load"
) -> DataFrame:
    """Metrics at constant capacity. ``servers`` maps a label to a count, or to ``min``, ``max`` or ``optimal``.

    ``optimal`` is the count the average load needs at 70 %.
    """
    keys = list(keys)
    mean = loads.groupBy(*keys).agg(F.avg(load).alias("__mean"))
    base = with_configs(loads.join(mean, on=keys).select(*keys, load, "__mean"), configs)
    kinds = {
        "min": F.col("min_servers"),
        "max": F.col("max_servers"),
        "optimal": required_servers(F.col("__mean")),
    }
    options = F.array(
        *[
            F.struct(F.lit(label).alias("label"), (kinds[n] if isinstance(n, str) else F.lit(n)).cast("bigint").alias("n"))
            for label, n in servers.items()
        ]
    )
    rows = base.withColumn("__s", F.explode(options)).withColumns({"strategy": F.col("__s.label"), "servers": F.col("__s.n")})
    count = F.col("servers")
    used = utilization(F.col(load), count, F.col("capacity"))
    return rows.groupBy(*keys, "config_id", "strategy").agg(
        *_summary(count, used, period_cost(count), F.col("time_window_minutes") / 60.0)
    )


def strategy_table(replayed: DataFrame, fixed: DataFrame, keys: Sequence[str] = SID) -> DataFrame:
    """Autoscaled and fixed runs side by side."""
    cols = [
        *keys, "config_id", "strategy", "total_cost", "avg_cost_per_hour", "avg_servers", "avg_utilization",
        "sla_violations", "sla_violation_rate", "wasted_periods", "scaling_events",
    ]
    auto = replayed.withColumn("strategy", F.concat(F.lit("autoscale_"), F.col("policy")))
    flat = fixed.withColumn("scaling_events", F.lit(0).cast("bigint"))
    return auto.select(*cols).unionByName(flat.select(*cols))


def savings(strategies: DataFrame, against: str = "fixed_max", keys: Sequence[str] = SID) -> DataFrame:
    """Cost and servers saved against one strategy of the same series and configuration."""
    by = [*keys, "config_id"]
    base = strategies.where(F.col("strategy") == against).select(
        *by,
        F.col("total_cost").alias("fixed_cost"),
        F.col("avg_servers").alias("__servers"),
        F.col("sla_violations").alias("__violations"),
    )
    rest = strategies.where(F.col("strategy") != against).join(base, on=by)
    return rest.select(
        *by, "strategy", "fixed_cost", F.col("total_cost").alias("autoscale_cost"),
        (F.col("fixed_cost") - F.col("total_cost")).alias("cost_savings"),
        F.coalesce(ratio((F.col("fixed_cost") - F.col("total_cost")) * 100, F.col("fixed_cost")), F.lit(0.0)).alias("cost_savings_pct"),
        (F.col("__servers") - F.col("avg_servers")).alias("avg_servers_saved"),
        (F.col("sla_violations") - F.col("__violations")).alias("sla_impact"),
    )


def best_under(reports: DataFrame, max_rate: float, by: Sequence[str] = SID, label: str = "config_id") -> DataFrame:
    """Cheapest row within the violation limit, else the one violating least. Ties go to the first label."""
    fits = F.col("sla_violation_rate") <= max_rate
    order = F.struct(
        (~fits).alias("a"),
        F.when(fits, F.col("total_cost")).otherwise(F.col("sla_violation_rate")).alias("b"),
        F.col(label).alias("c"),
    )
    picked = reports.groupBy(*by).agg(
        F.min_by(F.struct(label, "total_cost", "sla_violation_rate"), order).alias("p"), F.max(fits).alias("meets_sla")
    )
    return picked.select(*by, f"p.{label}", "p.total_cost", "p.sla_violation_rate", "meets_sla")


def with_balance(reports: DataFrame, by: Sequence[str] = SID) -> DataFrame:
    """Sum of min-max normalised cost and violations; lower is better."""
    by = list(by)
    span = reports.groupBy(*by).agg(
        F.min("total_cost").alias("__c0"), F.max("total_cost").alias("__c1"),
        F.min("sla_violations").alias("__v0"), F.max("sla_violations").alias("__v1"),
    )
    cost = (F.col("total_cost") - F.col("__c0")) / (F.col("__c1") - F.col("__c0") + 1e-10)
    sla = (F.col("sla_violations") - F.col("__v0")) / (F.col("__v1") - F.col("__v0") + 1e-10)
    return reports.join(span, on=by).withColumn("balance", cost + sla).drop("__c0", "__c1", "__v0", "__v1")


def matrix_winners(reports: DataFrame, by: Sequence[str] = SID, name: str = "run_id") -> DataFrame:
    """Best cost, best SLA and best balance per series; ties go to the first name."""
    scored = with_balance(reports, by)
    return scored.groupBy(*by).agg(
        F.min_by(name, F.struct("total_cost", name)).alias("best_cost"),
        F.min_by(name, F.struct("sla_violations", name)).alias("best_sla"),
        F.min_by(name, F.struct("balance", name)).alias("best_balanced"),
    )


def recommend(
    reports: DataFrame, loads: DataFrame, priority: str = "balanced", max_rate: float = 0.05, max_cost: float | None = None,
    fixed_max: DataFrame | None = None, decisions: DataFrame | None = None, keys: Sequence[str] = SID, name: str = "run_id", load: str = "load",
) -> DataFrame:
    """The run to choose per series: within the limits if any run is, by priority, with risk levels.

    ``fixed_max`` (series, config, total_cost) adds savings, ``decisions`` the spread of the period costs.
    """
    if priority not in ("cost", "sla", "balanced"):
        raise ValueError("priority must be cost, sla or balanced")
    keys = list(keys)
    fits = F.col("sla_violation_rate") <= max_rate
    if max_cost is not None:
        fits = fits & (F.col("total_cost") <= max_cost)
    marked = reports.withColumn("__fits", fits)
    relaxed = marked.groupBy(*keys).agg(F.max("__fits").alias("__any"))
    valid = marked.join(relaxed, on=keys).where(F.col("__fits") | ~F.col("__any"))
    scored = with_balance(valid, keys)
    measure = {"cost": "total_cost", "sla": "sla_violations", "balanced": "balance"}[priority]
    chosen = scored.groupBy(*keys).agg(
        F.min_by(
            F.struct(name, *RUN, "total_cost", "sla_violations", "sla_violation_rate", "avg_servers"),
            F.struct(measure, name),
        ).alias("p")
    ).select(*keys, "p.*")
    peaks = loads.groupBy(*keys).agg(F.max(load).alias("__peak"), F.avg(load).alias("__mean"))
    peak_ratio = F.coalesce(ratio(F.col("__peak"), F.when(F.col("__mean") > 0, F.col("__mean"))), F.lit(1.0))
    rate = F.col("sla_violation_rate")
    out = chosen.join(peaks, on=keys).withColumns(
        {
            "sla_risk": F.when(rate < 0.01, "low").when(rate < 0.05, "medium").otherwise("high"),
            "peak_risk": F.when(peak_ratio > 3, "high").when(peak_ratio > 2, "medium").otherwise("low"),
            "worst_case_cost": F.col("total_cost") * 1.2,
            "best_case_cost": F.col("total_cost") * 0.9,
        }
    ).drop("__peak", "__mean")
    if fixed_max is not None:
        base = fixed_max.select(*keys, "config_id", F.col("total_cost").alias("__fixed"))
        out = out.join(base, on=[*keys, "config_id"], how="left").withColumns(
            {
                "savings": F.col("__fixed") - F.col("total_cost"),
                "savings_pct": F.coalesce(ratio((F.col("__fixed") - F.col("total_cost")) * 100, F.col("__fixed")), F.lit(0.0)),
            }
        ).drop("__fixed")
    if decisions is not None:
        spread = decisions.groupBy(*keys, *RUN).agg((F.stddev_pop("cost") * F.count(F.lit(1))).alias("cost_spread"))
        out = out.join(spread, on=[*keys, *RUN], how="left")
    return out


def cost_projection(
    forecast: DataFrame, configs: dict[str, ScalingConfig], periods_per_day: int, days: Sequence[int] = (7, 14, 30),
    keys: Sequence[str] = SID, load: str = "yhat", step: str = "step",
) -> DataFrame:
    """Cost of meeting a forecast: in total and over the first days, NULL where the forecast is shorter."""
    rows = with_configs(forecast, configs)
    cost = period_cost(required_servers(F.col(load)))
    n = F.count(F.lit(1))
    parts = [
        F.when(n >= d * periods_per_day, F.sum(F.when(F.col(step) < d * periods_per_day, cost))).alias(f"cost_{d}d") for d in days
    ]
    return rows.groupBy(*keys, "config_id").agg(*parts, F.sum(cost).alias("total_cost"))


def hourly_costs(decisions: DataFrame, keys: Sequence[str] = SID, ts: str = "timestamp") -> DataFrame:
    """Mean, population deviation and range of the cost per hour."""
    by = [*keys, *RUN]
    hours = decisions.groupBy(*by, floor_time(F.col(ts), 3600).alias("__h")).agg(F.sum("cost").alias("c"))
    return hours.groupBy(*by).agg(
        F.avg("c").alias("mean"), F.stddev_pop("c").alias("std"), F.min("c").alias("min"), F.max("c").alias("max")
    )


def config_scores(reports: DataFrame, penalty: float, by: Sequence[str] = SID, name: str = "run_id") -> DataFrame:
    """The run with the lowest cost plus penalised violations."""
    score = F.col("total_cost") + F.col("sla_violations") * F.lit(float(penalty))
    scored = reports.withColumn("score", score)
    return scored.groupBy(*by).agg(
        F.min_by(name, F.struct("score", name)).alias(name), F.min("score").alias("score")
    )


def breach_runs(
    loads: DataFrame, configs: dict[str, ScalingConfig], servers: int, step_seconds: int, keys: Sequence[str] = SID, load: str = "load", ts: str = "timestamp"
) -> DataFrame:
    """Over/under tags at a fixed capacity, with the length of the current breach."""
    rows = with_configs(loads, configs)
    used = utilization(F.col(load), F.lit(servers), F.col("capacity"))
    tag = F.when(used > F.col("scale_out_threshold"), "over").when(used < F.col("scale_in_threshold"), "under").otherwise("normal")
    marked = rows.select(*keys, "config_id", ts, used.alias("utilization"), tag.alias("breach"))
    runs = run_starts(marked, [*keys, "config_id"], ts, step_seconds, "breach")
    length = (epoch_seconds(F.col(ts)) - F.col("run_start")) / F.lit(step_seconds) + 1
    return runs.withColumn("run_length", F.when(F.col("breach") == "normal", F.lit(0)).otherwise(length.cast("bigint")).cast("bigint"))


def overload_episodes(rows: DataFrame, step_seconds: int, keys: Sequence[str], used: str = "utilization", ts: str = "timestamp") -> DataFrame:
    """Stretches of consecutive rows above full utilization: start, minutes, peak."""
    marked = run_starts(rows.withColumn("__over", F.col(used) > 1.0), keys, ts, step_seconds, "__over")
    return marked.where(F.col("__over")).groupBy(*keys, "run_start").agg(
        F.min(ts).alias("start"),
        (F.count(F.lit(1)) * F.lit(step_seconds / 60)).alias("minutes"),
        F.max(used).alias("max_utilization"),
    ).drop("run_start")


def pareto(points: DataFrame, by: Sequence[str] = SID, cost: str = "total_cost", sla: str = "sla_violation_rate") -> DataFrame:
    """Mark the points no other point beats: none at lower cost with as few violations, none at this cost with fewer."""
    best = prefix_min(points, by, cost, sla)
    joined = points.join(best, on=[*by, cost])
    beaten = (F.coalesce(F.col("least_before"), F.lit(float("inf"))) <= F.col(sla)) | (F.col("least_here") < F.col(sla))
    return joined.withColumn("pareto_optimal", ~beaten).drop("least_before", "least_here")


def running_cost(
    rows: DataFrame, step_seconds: int, keys: Sequence[str], cost: str = "cost", ts: str = "timestamp", chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    return running(rows, keys, ts, step_seconds, {"cumulative_cost": ("sum", cost)}, chunk_rows)


def first_of(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key, in the given order."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__nth", F.row_number().over(window)).where(F.col("__nth") == 1).drop("__nth")


def overview(strategies: DataFrame, max_violations: int, keys: Sequence[str] = SID) -> DataFrame:
    """Cheapest strategy under a violation cap per series and configuration, with its cost per average server."""
    ok = strategies.where(F.col("sla_violations") <= max_violations)
    order = F.struct("total_cost", "strategy")
    best = ok.groupBy(*keys, "config_id").agg(F.min_by(F.struct("strategy", "total_cost", "avg_servers"), order).alias("p"))
    return best.select(
        *keys, "config_id", "p.strategy", "p.total_cost", ratio(F.col("p.total_cost"), F.col("p.avg_servers")).alias("cost_per_server")
    )


def cost_report(replayed: DataFrame, fixed: DataFrame, keys: Sequence[str] = SID) -> DataFrame:
    """Every run next to the fixed capacities of its configuration, and what it saves against the largest one."""
    by = [*keys, "config_id"]
    kinds = ("fixed_min", "fixed_max", "fixed_optimal")
    wide = fixed.groupBy(*by).agg(*[F.max(F.when(F.col("strategy") == k, F.col("total_cost"))).alias(k) for k in kinds])
    saved = F.col("fixed_max") - F.col("total_cost")
    return replayed.join(wide, on=by).withColumns(
        {"saved_vs_max": saved, "saved_pct": F.coalesce(ratio(saved * 100, F.col("fixed_max")), F.lit(0.0))}
    )
