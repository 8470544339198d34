"""The chunked fold against a plain row-by-row one, and the golden cases of the threshold rule."""

from dataclasses import replace
from datetime import datetime, timedelta

import numpy as np
import pytest

from trafficlens.operators.capacity import PRESETS, ScalingConfig
from trafficlens.operators.decisions import decide

START = datetime(2024, 1, 1)


def frame(spark, loads, minutes=5, sid="a"):
    rows = [(sid, START + timedelta(minutes=i * minutes), float(v)) for i, v in enumerate(loads)]
    return spark.createDataFrame(rows, "series_id string, timestamp timestamp_ntz, load double")


def plain_fold(config, loads, times, policy):
    """Row by row, one configuration, straight from the rule's description."""
    servers, last, high, low, memory, out = config.min_servers, None, 0, 0, [], []

    def need(x):
        if x <= 0:
            return config.min_servers
        n = int(x / (config.capacity_per_server * 0.7)) + 1
        return max(config.min_servers, min(n, config.max_servers))

    for i, (load, now) in enumerate(zip(loads, times)):
        before, act, why = servers, "hold", None
        ready = last is None or now >= last + timedelta(minutes=config.cooldown_minutes)
        used = load / (servers * config.capacity_per_server)
        if policy == "forecast" and ready:
            peak = max(loads[i : i + 7]) * 1.15
            if need(peak) > servers:
                servers, act, why = need(peak), "scale_out", f"predictive_scale_out_for_peak_{peak:.0f}"
        memory = (memory + [load])[-12:]
        if policy in ("predictive", "forecast") and why is None and ready and len(memory) == 12:
            older = np.mean(memory[:6])
            grown = np.mean(memory[6:]) / older if older > 0 else 1.0
            if grown > 1.05 and need(load * grown * 1.15) > servers:
                servers, act, why = need(load * grown * 1.15), "scale_out", f"predictive_pre_scale_trend_{grown:.2f}"
        if why is None and not ready:
            why = "cooldown_active"
        elif why is None and used > config.scale_out_threshold:
            high, low = high + 1, 0
            goal = min(servers + config.scale_out_increment, config.max_servers)
            if high >= config.scale_out_consecutive and goal > servers:
                servers, act, why = goal, "scale_out", f"high_utilization_{high}_periods"
            else:
                why = f"waiting_scale_out_{high}/{config.scale_out_consecutive}"
        elif why is None and used < config.scale_in_threshold:
            high, low = 0, low + 1
            goal = max(servers - config.scale_in_decrement, config.min_servers)
            if low >= config.scale_in_consecutive and goal < servers:
                servers, act, why = goal, "scale_in", f"low_utilization_{low}_periods"
            else:
                why = f"waiting_scale_in_{low}/{config.scale_in_consecutive}"
        elif why is None:
            high = low = 0
            why = "normal_utilization"
        if act != "hold":
            last, high, low = now, 0, 0
        out.append((act, before, servers, why))
    return out


@pytest.mark.parametrize("minutes, chunk", [(5, 17), (1, 23), (5, 100000)])
def test_chunked_fold_equals_row_by_row(spark, minutes, chunk):
    rng = np.random.default_rng(7)
    wave = 400 + 380 * np.sin(np.arange(300) / 9.0)
    loads = np.maximum(0, wave + rng.normal(0, 90, 300)).round()
    loads[100:130] = 5000
    loads[200:240] = 0
    times = [START + timedelta(minutes=i * minutes) for i in range(len(loads))]
    configs = {n: replace(c, time_window_minutes=minutes, max_servers=8) for n, c in PRESETS.items()}
    policies = ("balanced", "reactive", "predictive", "forecast")
    got = decide(frame(spark, loads, minutes), configs, minutes * 60, policies, chunk_rows=chunk).collect()
    assert len(got) == len(loads) * len(configs) * len(policies)
    table = {(r.config_id, r.policy, r.timestamp): (r.action, r.current_servers, r.target_servers, r.reason) for r in got}
    for name, config in configs.items():
        for policy in policies:
            changed = config.reactive() if policy == "reactive" else config
            changed = config.trend() if policy in ("predictive", "forecast") else changed
            want = plain_fold(changed, loads, times, policy)
            for now, expected in zip(times, want):
                assert table[(name, policy, now)] == expected, (name, policy, now)


def actions(spark, loads, config, minutes=5, **kw):
    rows = decide(frame(spark, loads, minutes), {"c": config}, minutes * 60, **kw).orderBy("timestamp").collect()
    return [(r.action, r.current_servers, r.target_servers, r.reason) for r in rows]


def test_two_high_rows_do_not_reach_three(spark):
    got = actions(spark, [90, 90], ScalingConfig(scale_out_consecutive=3))
    assert [g[0] for g in got] == ["hold", "hold"] and got[1][3] == "waiting_scale_out_2/3"


def test_scale_out_at_once(spark):
    got = actions(spark, [200], ScalingConfig(scale_out_consecutive=1, scale_out_increment=2), initial_servers=2)
    assert got == [("scale_out", 2, 4, "high_utilization_1_periods")]


def test_scale_in_at_once(spark):
    got = actions(spark, [100], ScalingConfig(scale_in_consecutive=1), initial_servers=10)
    assert got == [("scale_in", 10, 9, "low_utilization_1_periods")]


def test_cooldown_holds_and_then_allows(spark):
    config = ScalingConfig(scale_out_consecutive=1, cooldown_minutes=10)
    got = actions(spark, [200, 400], config, initial_servers=2)
    assert got[0][0] == "scale_out" and got[1][3] == "cooldown_active"
    config = replace(config, cooldown_minutes=5)
    assert [g[0] for g in actions(spark, [200, 400], config, minutes=10, initial_servers=2)][1] == "scale_out"


def test_never_above_the_limit(spark):
    config = ScalingConfig(max_servers=5, scale_out_increment=100, scale_out_consecutive=1)
    assert actions(spark, [4000], config, initial_servers=4)[0][2] == 5


@pytest.mark.parametrize(
    "change",
    [
        {"min_servers": 0}, {"min_servers": 5, "max_servers": 3}, {"scale_out_threshold": 1.5},
        {"scale_in_threshold": -0.1}, {"scale_in_threshold": 0.9}, {"scale_out_increment": 0}, {"scale_in_decrement": 0},
    ],
)
def test_config_rules(change):
    with pytest.raises(ValueError):
        ScalingConfig(**change)
    assert ScalingConfig.from_dict(ScalingConfig().to_dict()) == ScalingConfig()
