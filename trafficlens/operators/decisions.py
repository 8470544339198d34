"""Scaling decisions: an order-dependent rule per (series, configuration), run in parallel chunks of time.

The rule carries a small state from row to row: servers, end of the cooldown, and the counts of consecutive high or low
rows. A long series is cut into chunks, and the chunks are folded in three steps:

1. every chunk but a series' first is folded from all states it could start in at once (one array lane each; lanes that
   meet are merged), giving a map from start state to end state;
2. the maps of a series are chained: one short step per chunk;
3. every chunk is folded from its now known start state, giving the decisions.

The result equals the row-by-row fold over the whole series. No task holds more than one chunk of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.functions.values import epoch_micros, epoch_seconds, ratio
from trafficlens.operators.capacity import ScalingConfig
from trafficlens.operators.scale import CHUNK, halo

POLICIES = ("balanced", "reactive", "predictive", "forecast")
FOLD_ROWS = 16384
MERGE_EVERY = 32
NEVER = np.iinfo(np.int64).min

# Fixed values of the trend rule.
SAFETY, TREND_LIMIT, TREND_TARGET, HORIZON = 0.15, 1.05, 0.70, 6

STATE = ("servers", "expires", "high", "low")
ACTIONS = ("hold", "scale_out", "scale_in")
HOLD, OUT, IN = 0, 1, 2
COOLING, NORMAL, HIGH, WAIT_HIGH, LOW, WAIT_LOW, TREND, PEAK = range(8)


class Lanes:
    """Configurations as arrays, one entry per lane."""

    FIELDS = (
        "min_servers", "max_servers", "scale_out_threshold", "scale_in_threshold", "scale_out_consecutive",
        "scale_in_consecutive", "scale_out_increment", "scale_in_decrement",
    )

    def __init__(self, configs: Sequence[ScalingConfig], trend: Sequence[bool], peak: Sequence[bool]):
        for field in self.FIELDS:
            setattr(self, field, np.array([getattr(c, field) for c in configs]))
        self.capacity = np.array([c.capacity_per_server for c in configs], dtype=float)
        self.cooldown = np.array([c.cooldown_minutes * 60_000_000 for c in configs], dtype=np.int64)
        self.trend = np.array(trend, dtype=bool)
        self.peak = np.array(peak, dtype=bool)

    def take(self, index: np.ndarray) -> Lanes:
        out = object.__new__(Lanes)
        out.__dict__ = {k: v[index] for k, v in self.__dict__.items()}
        return out

    def required(self, load: float) -> np.ndarray:
        if not load > 0:
            return self.min_servers
        with np.errstate(divide="ignore"):
            wanted = np.floor(load / (self.capacity * TREND_TARGET)) + 1
        return np.clip(wanted, self.min_servers, self.max_servers).astype(np.int64)


def start_state(servers: np.ndarray) -> dict[str, np.ndarray]:
    n = len(servers)
    return {
        "servers": servers.astype(np.int64),
        "expires": np.full(n, NEVER, dtype=np.int64),
        "high": np.zeros(n, dtype=np.int64),
        "low": np.zeros(n, dtype=np.int64),
    }


def advance(state: dict, lanes: Lanes, load: float, at: int, trend_ratio: float = 1.0, peak: float = 0.0) -> tuple:
    """One row for all lanes. Changes the state; returns (action, servers before, utilization, reason, count)."""
    servers = state["servers"]
    total = servers * lanes.capacity
    with np.errstate(divide="ignore", invalid="ignore"):
        used = np.where(total > 0, load / total, np.inf)
    cooling = at < state["expires"]
    free = ~cooling
    reason = np.where(cooling, COOLING, NORMAL)
    target = servers
    if lanes.peak.any():
        wanted = lanes.required(peak * (1 + SAFETY))
        jump = free & lanes.peak & (wanted > servers)
        target, reason, free = np.where(jump, wanted, target), np.where(jump, PEAK, reason), free & ~jump
    if trend_ratio > TREND_LIMIT and lanes.trend.any():
        wanted = lanes.required(load * trend_ratio * (1 + SAFETY))
        jump = free & lanes.trend & (wanted > servers)
        target, reason, free = np.where(jump, wanted, target), np.where(jump, TREND, reason), free & ~jump
    is_high = free & (used > lanes.scale_out_threshold)
    is_low = free & ~is_high & (used < lanes.scale_in_threshold)
    high = np.where(is_high, state["high"] + 1, np.where(cooling, state["high"], 0))
    low = np.where(is_low, state["low"] + 1, np.where(cooling, state["low"], 0))
    up = np.minimum(servers + lanes.scale_out_increment, lanes.max_servers)
    down = np.maximum(servers - lanes.scale_in_decrement, lanes.min_servers)
    grow = is_high & (high >= lanes.scale_out_consecutive) & (up > servers)
    shrink = is_low & (low >= lanes.scale_in_consecutive) & (down < servers)
    target = np.where(grow, up, np.where(shrink, down, target))
    reason = np.where(is_high, np.where(grow, HIGH, WAIT_HIGH), np.where(is_low, np.where(shrink, LOW, WAIT_LOW), reason))
    count = np.where(is_high, high, np.where(is_low, low, 0))
    acted = target != servers
    state["servers"] = target
    state["expires"] = np.where(acted, at + lanes.cooldown, state["expires"])
    state["high"] = np.where(acted, 0, high)
    state["low"] = np.where(acted, 0, low)
    action = np.where(target > servers, OUT, np.where(target < servers, IN, HOLD))
    return action, servers, used, reason, count


def possible_starts(config: ScalingConfig, first_at: int, earlier: np.ndarray) -> pd.DataFrame:
    """Every state the rule can be in before a chunk whose first row is at ``first_at``.

    ``earlier`` holds the times of the rows before it. A counter at or above its limit happens only at the server limit;
    such a start is marked ``open`` and stands for all higher counts too.
    """
    cooldown = config.cooldown_minutes * 60_000_000
    ends = earlier[(earlier < first_at) & (earlier + cooldown > first_at)] + cooldown
    servers = np.arange(config.min_servers, config.max_servers + 1)
    counts = [(NEVER, 0, 0)]
    counts += [(NEVER, h, 0) for h in range(1, config.scale_out_consecutive)]
    counts += [(NEVER, 0, n) for n in range(1, config.scale_in_consecutive)]
    counts += [(int(e), 0, 0) for e in ends]
    rows = [(int(s), *c, 0) for c in counts for s in servers]
    rows.append((config.max_servers, NEVER, config.scale_out_consecutive, 0, 1))
    rows.append((config.min_servers, NEVER, 0, config.scale_in_consecutive, 1))
    return pd.DataFrame(rows, columns=[*STATE, "open"]).drop_duplicates(list(STATE)).reset_index(drop=True)


def chunk_map(config: ScalingConfig, trend: bool, peak: bool, rows: pd.DataFrame, earlier: np.ndarray) -> tuple[list, list]:
    """Fold a chunk from all its possible starts. Returns the distinct ends and, per start, which end it reaches."""
    starts = possible_starts(config, int(rows["at"].iloc[0]), earlier)
    state = {k: starts[k].to_numpy(dtype=np.int64).copy() for k in STATE}
    still_open = starts["open"].to_numpy(dtype=np.int64).copy()
    which = np.arange(len(starts))
    one = Lanes([config], [trend], [peak])
    lanes = one.take(np.zeros(len(starts), dtype=int))
    for i, (load, at, grown, top) in enumerate(zip(rows["load"], rows["at"], rows["trend_ratio"], rows["peak"])):
        advance(state, lanes, load, at, grown, top)
        still_open = np.where((state["high"] == 0) & (state["low"] == 0), 0, still_open)
        if i % MERGE_EVERY == 0 and len(still_open) > 1:
            expires = np.where(state["expires"] <= at, NEVER, state["expires"])
            table = np.stack([state["servers"], expires, state["high"], state["low"], still_open], axis=1)
            merged, inverse = np.unique(table, axis=0, return_inverse=True)
            inverse = inverse.reshape(-1)
            if len(merged) < len(table):
                state = {k: merged[:, j].copy() for j, k in enumerate(STATE)}
                still_open = merged[:, 4].copy()
                which = inverse[which]
                lanes = one.take(np.zeros(len(merged), dtype=int))
    table = np.stack([state[k] for k in STATE] + [still_open], axis=1)
    merged, inverse = np.unique(table, axis=0, return_inverse=True)
    which = inverse.reshape(-1)[which]
    return merged.tolist(), ([] if len(merged) == 1 else which.tolist())


def follow(config: ScalingConfig, state: tuple, first_at: int, earlier: np.ndarray, ends: list, which: list) -> tuple:
    """End state of a chunk for a known start."""
    servers, expires, high, low = state
    if expires <= first_at:
        expires = NEVER
    capped = (min(high, config.scale_out_consecutive), min(low, config.scale_in_consecutive))
    if which:
        starts = possible_starts(config, first_at, earlier)
        hit = (
            (starts["servers"] == servers) & (starts["expires"] == expires)
            & (starts["high"] == capped[0]) & (starts["low"] == capped[1])
        )
        end = ends[which[int(np.flatnonzero(hit.to_numpy())[0])]]
    else:
        end = ends[0]
    out = list(end[:4])
    if end[4]:
        out[2] += high - capped[0] if out[2] else 0
        out[3] += low - capped[1] if out[3] else 0
    return tuple(out)


def _signals(df: DataFrame, keys, ts, step_seconds, load) -> DataFrame:
    """Trend ratio of the last 6 rows to the 6 before, and the peak of the current and the next rows."""

    def build(w):
        recent, older = F.avg(load).over(w.rowsBetween(-5, 0)), F.avg(load).over(w.rowsBetween(-11, -6))
        full = F.count(load).over(w.rowsBetween(-11, 0)) == 12
        return {
            "trend_ratio": F.when(full, F.coalesce(ratio(recent, F.when(older > 0, older)), F.lit(1.0))).otherwise(1.0),
            "peak": F.max(load).over(w.rowsBetween(0, HORIZON)).cast("double"),
        }

    return halo(df, keys, ts, step_seconds, build, back=11, ahead=HORIZON)


def decide(
    df: DataFrame, configs: dict[str, ScalingConfig], step_seconds: int, policies: Sequence[str] = ("balanced",),
    keys: Sequence[str] = ("series_id",), load: str = "load", ts: str = "timestamp", initial_servers: int | None = None,
    chunk_rows: int = FOLD_ROWS, peak: str | None = None,
) -> DataFrame:
    """Decisions of every (series, configuration, policy): one row per input row and combination.

    Policies: ``balanced`` takes the configuration as it is; ``reactive`` and ``predictive`` change it as those rules
    do, the latter adding the trend jump; ``forecast`` also jumps for the peak of the coming rows (or of a given
    ``peak`` column, such as one computed from a forecast).
    """
    unknown = set(policies) - set(POLICIES)
    if unknown:
        raise ValueError(f"unknown policies: {sorted(unknown)}")
    runs = []
    for config_id, config in configs.items():
        for policy in policies:
            changed = config.reactive() if policy == "reactive" else config
            changed = config.trend() if policy in ("predictive", "forecast") else changed
            if initial_servers is not None and not changed.min_servers <= initial_servers <= changed.max_servers:
                raise ValueError("initial_servers must lie within the limits of every configuration")
            runs.append((config_id, policy, changed, policy in ("predictive", "forecast"), policy == "forecast"))
    first_servers = np.array([initial_servers or r[2].min_servers for r in runs])

    keys = list(keys)
    reach = max(r[2].cooldown_minutes * 60 for r in runs)
    rows_per_chunk = max(chunk_rows, -(-reach // step_seconds) + 1)
    length = rows_per_chunk * step_seconds
    base = df.select(*keys, ts, F.col(load).cast("double").alias("load"), *([F.col(peak).alias("__given")] if peak else []))
    base = _signals(base, keys, ts, step_seconds, "load")
    if peak:
        base = base.withColumn("peak", F.greatest(F.col("load"), F.col("__given").cast("double"))).drop("__given")
    seconds = epoch_seconds(F.col(ts))
    first = base.groupBy(*keys).agg(F.min(F.floor(seconds / length)).alias("__start"))
    own = F.floor(seconds / length)
    tail = seconds - own * length >= length - reach
    spread = (
        base.join(first, on=keys)
        .withColumn("at", epoch_micros(F.col(ts)))
        .withColumn("__own", own)
        .withColumn(CHUNK, F.explode(F.array_compact(F.array(own, F.when(tail, own + 1)))))
    )
    # A copied tail row of the last chunk opens no chunk of its own: groups without own rows give nothing.
    group = [*keys, CHUNK]
    key_fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)
    ends_type = "array<array<bigint>>"

    fold_first = _first_chunk_fold(runs, first_servers)

    def maps(pdf: pd.DataFrame) -> pd.DataFrame:
        """One row per run: the end of a series' first chunk, or the map from all starts of a later one."""
        pdf = pdf.sort_values("at")
        mine = pdf[pdf["__own"] == pdf[CHUNK]]
        earlier = pdf.loc[pdf["__own"] != pdf[CHUNK], "at"].to_numpy(dtype=np.int64)
        columns = [*keys, CHUNK, "run", "is_first", "first_at", "earlier", "ends", "which"]
        if not len(mine):
            return pd.DataFrame(columns=columns)
        is_first = int(mine[CHUNK].iloc[0]) == int(mine["__start"].iloc[0])
        if is_first:
            found = [(ends, []) for ends in fold_first(mine)]
        else:
            found = [chunk_map(config, trend, top, mine, earlier) for _, _, config, trend, top in runs]
        head = [mine[k].iloc[0] for k in keys] + [int(mine[CHUNK].iloc[0])]
        first_at = int(mine["at"].iloc[0])
        rows = [(*head, i, is_first, first_at, earlier.tolist(), ends, which) for i, (ends, which) in enumerate(found)]
        return pd.DataFrame(rows, columns=columns)

    summary = spread.groupBy(*group).applyInPandas(
        maps,
        f"{key_fields}, `{CHUNK}` bigint, run int, is_first boolean, first_at bigint, earlier array<bigint>, "
        f"ends {ends_type}, which array<int>",
    )

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(CHUNK)
        run = int(pdf["run"].iloc[0])
        config = runs[run][2]
        state = (int(first_servers[run]), int(NEVER), 0, 0)
        starts = []
        for is_first, first_at, earlier, ends, which in zip(
            pdf["is_first"], pdf["first_at"], pdf["earlier"], pdf["ends"], pdf["which"]
        ):
            starts.append(list(state))
            if is_first:
                state = tuple(int(v) for v in ends[0][:4])
            else:
                state = follow(
                    config, state, int(first_at), np.array(earlier, dtype=np.int64),
                    [[int(v) for v in e] for e in ends], list(which),
                )
        out = pdf[[*keys, CHUNK, "run"]].copy()
        out["start"] = starts
        return out

    begun = summary.groupBy(*keys, "run").applyInPandas(chain, f"{key_fields}, `{CHUNK}` bigint, run int, start array<bigint>")

    all_lanes = Lanes([r[2] for r in runs], [r[3] for r in runs], [r[4] for r in runs])

    def emit(pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        mine = pdf[pdf["__own"] == pdf[CHUNK]].sort_values("at")
        columns = [*keys, ts, "run", "load", "action", "current_servers", "target_servers", "utilization", "why", "count", "trend_ratio", "peak"]
        if not len(mine) or not len(known):
            return pd.DataFrame(columns=columns)
        known = known.sort_values("run")
        table = np.array([list(s) for s in known["start"]], dtype=np.int64)
        state = {k: table[:, j].copy() for j, k in enumerate(STATE)}
        parts = []
        for load_, at, grown, top in zip(mine["load"], mine["at"], mine["trend_ratio"], mine["peak"]):
            action, before, used, why, count = advance(state, all_lanes, load_, at, grown, top)
            parts.append((action, before, state["servers"], used, why, count))
        n, m = len(mine), len(runs)
        stacked = [np.stack([p[j] for p in parts]).reshape(-1) for j in range(6)]
        out = pd.DataFrame({c: np.repeat(mine[c].to_numpy(), m) for c in [*keys, ts, "load", "trend_ratio", "peak"]})
        out["run"] = np.tile(np.arange(m), n)
        for name, values in zip(["action", "current_servers", "target_servers", "utilization", "why", "count"], stacked):
            out[name] = values
        return out[columns]

    ts_type = df.schema[ts].dataType.simpleString()
    folded = spread.groupBy(*group).cogroup(begun.groupBy(*group)).applyInPandas(
        emit,
        f"{key_fields}, `{ts}` {ts_type}, run int, load double, action int, current_servers bigint, target_servers bigint, "
        "utilization double, why int, count bigint, trend_ratio double, peak double",
    )
    return _labelled(folded, runs, keys, ts)


def _first_chunk_fold(runs, first_servers):
    lanes_args = ([r[2] for r in runs], [r[3] for r in runs], [r[4] for r in runs])

    def fold(mine: pd.DataFrame) -> list:
        lanes, state = Lanes(*lanes_args), start_state(first_servers)
        for load, at, grown, top in zip(mine["load"], mine["at"], mine["trend_ratio"], mine["peak"]):
            advance(state, lanes, load, at, grown, top)
        return [[[int(state[k][i]) for k in STATE] + [0]] for i in range(len(runs))]

    return fold


def _labelled(folded: DataFrame, runs, keys, ts) -> DataFrame:
    """Names and reason texts from the codes."""
    ids = F.array(*[F.lit(r[0]) for r in runs])
    policies = F.array(*[F.lit(r[1]) for r in runs])
    n_out = F.array(*[F.lit(r[2].scale_out_consecutive) for r in runs])
    n_in = F.array(*[F.lit(r[2].scale_in_consecutive) for r in runs])
    capacity = F.array(*[F.lit(float(r[2].capacity_per_server)) for r in runs])
    price = F.array(*[F.lit(r[2].cost_per_server_per_hour * r[2].time_window_minutes / 60) for r in runs])
    place = F.col("run") + 1
    at = lambda values: F.element_at(values, place)
    count = F.col("count").cast("string")
    reason = (
        F.when(F.col("why") == COOLING, "cooldown_active")
        .when(F.col("why") == NORMAL, "normal_utilization")
        .when(F.col("why") == HIGH, F.concat(F.lit("high_utilization_"), count, F.lit("_periods")))
        .when(F.col("why") == WAIT_HIGH, F.concat(F.lit("waiting_scale_out_"), count, F.lit("/"), at(n_out).cast("string")))
        .when(F.col("why") == LOW, F.concat(F.lit("low_utilization_"), count, F.lit("_periods")))
        .when(F.col("why") == WAIT_LOW, F.concat(F.lit("waiting_scale_in_"), count, F.lit("/"), at(n_in).cast("string")))
        .when(F.col("why") == TREND, F.format_string("predictive_pre_scale_trend_%.2f", F.bround("trend_ratio", 2)))
        .otherwise(F.format_string("predictive_scale_out_for_peak_%.0f", F.bround(F.col("peak") * F.lit(1 + SAFETY), 0)))
    )
    action = F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), F.col("action") + 1)
    return folded.select(
        *keys, ts, at(ids).alias("config_id"), at(policies).alias("policy"), "load", action.alias("action"),
        "current_servers", "target_servers", "utilization", reason.alias("reason"),
        ratio(F.col("load"), F.col("target_servers") * at(capacity)).alias("utilization_after"),
        (F.col("target_servers") * at(price)).alias("cost"),
    )
