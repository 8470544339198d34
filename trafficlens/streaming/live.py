"""Streaming forms of parsing, counting, deduplication, decisions and gap detection."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trafficlens.operators import decisions as dec
from trafficlens.operators.capacity import ScalingConfig
from trafficlens.operators.parse import parse_lines
from trafficlens.session import STATE_STORE, scratch_path, state_settings

MEMORY = 12


def live_parse(lines: DataFrame, value: str = "value") -> DataFrame:
    """Valid lines as rows with an event time."""
    return parse_lines(lines, value).withColumn("event_time", F.col("timestamp").cast("timestamp"))


def live_dedup(rows: DataFrame, delay: str = "1 hour", keys: Sequence[str] = ("host", "timestamp", "url", "method")) -> DataFrame:
    """The first row to arrive of every key; the state of a key goes with the watermark."""
    return rows.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(list(keys))


def live_counts(rows: DataFrame, window: str = "5 minutes", delay: str = "1 hour", keys: Sequence[str] = (), exact_hosts: bool = False) -> DataFrame:
    """Requests, hosts, errors and bytes per window; rows later than the delay are dropped.

    Exact host counts keep every host of the open windows in state; the default sketch has a fixed size.
    """
    hosts = F.size(F.collect_set("host")) if exact_hosts else F.approx_count_distinct("host")
    status = F.col("status")
    windows = rows.withWatermark("event_time", delay).groupBy(*keys, F.window("event_time", window).alias("w"))
    return windows.agg(
        F.count(F.lit(1)).alias("request_count"),
        hosts.cast("bigint").alias("unique_hosts"),
        F.count_if(status >= 400).alias("error_count"),
        F.sum(F.greatest(F.col("bytes"), F.lit(0).cast("bigint"))).alias("bytes_total"),
    ).select(*keys, F.col("w.start").cast("timestamp_ntz").alias("timestamp"), "request_count", "unique_hosts", "error_count", "bytes_total")


class DecisionProcessor(StatefulProcessor):
    """The decision rule with its state per key: one entry per (configuration, policy), and the last loads."""

    STATE = "servers array<bigint>, expires array<bigint>, high array<bigint>, low array<bigint>, memory array<double>, last_at bigint"

    def __init__(self, runs: list, key: str):
        self.runs = runs
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("decisions", self.STATE)
        self.lanes = dec.Lanes([r[2] for r in self.runs], [r[3] for r in self.runs], [False] * len(self.runs))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("at")
        if self.state.exists():
            servers, expires, high, low, memory, last_at = self.state.get()
            state = {k: np.array(v, dtype=np.int64) for k, v in zip(dec.STATE, (servers, expires, high, low))}
            memory = list(memory)
        else:
            state = dec.start_state(np.array([r[2].min_servers for r in self.runs]))
            memory, last_at = [], dec.NEVER
        out = []
        for at, load in zip(batch["at"], batch["load"]):
            if at <= last_at:
                continue
            last_at = int(at)
            memory = (memory + [float(load)])[-MEMORY:]
            older = float(np.mean(memory[:6])) if len(memory) == MEMORY else 0.0
            grown = float(np.mean(memory[6:])) / older if older > 0 else 1.0
            action, before, used, _, _ = dec.advance(state, self.lanes, float(load), last_at, grown)
            for i, (config_id, policy, *_rest) in enumerate(self.runs):
                out.append((key[0], last_at, config_id, policy, float(load), dec.ACTIONS[action[i]], int(before[i]), int(state["servers"][i]), float(used[i])))
        self.state.update((*[state[k].tolist() for k in dec.STATE], memory, last_at))
        yield pd.DataFrame(out, columns=[self.key, "at", "config_id", "policy", "load", "action", "current_servers", "target_servers", "utilization"])

    def close(self) -> None:
        pass


def live_decisions(loads: DataFrame, configs: dict[str, ScalingConfig], policies: Sequence[str] = ("balanced",), key: str = "series_id", delay: str = "1 hour") -> DataFrame:
    """Decisions as rows arrive. Rows of a batch are taken in time order; a row older than one already seen is dropped."""
    runs = []
    for name, config in configs.items():
        for policy in policies:
            changed = {"reactive": config.reactive, "predictive": config.trend}.get(policy, lambda c=config: c)()
            runs.append((name, policy, changed, policy == "predictive"))
    rows = (
        loads.withColumn("event_time", F.col("timestamp").cast("timestamp"))
        .withWatermark("event_time", delay)
        .select(key, "event_time", F.unix_micros("event_time").alias("at"), F.col("load").cast("double").alias("load"))
    )
    key_type = loads.schema[key].dataType.simpleString()
    schema = (
        f"`{key}` {key_type}, at bigint, config_id string, policy string, load double, action string, "
        "current_servers bigint, target_servers bigint, utilization double"
    )
    out = rows.groupBy(key).transformWithStateInPandas(DecisionProcessor(runs, key), schema, "Append", "None")
    return out.withColumn("timestamp", F.timestamp_micros("at").cast("timestamp_ntz")).drop("at")


class GapProcessor(StatefulProcessor):
    """Last time seen per key; a bucket that begins too long after it closes a gap. One row per key and batch, with arrays."""

    OUT = "start_at array<bigint>, end_at array<bigint>"

    def __init__(self, key: str, threshold_micros: int):
        self.threshold = threshold_micros
        self.out = Row(key, "start_at", "end_at")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last = (self.last.get() or (None,))[0]
        gone, back = [], []
        for first, end in sorted((r.first_at, r.last_at) for r in rows):
            if last is not None and first - last > self.threshold:
                gone.append(last)
                back.append(first)
            last = end if last is None else max(last, end)
        self.last.update((last,))
        if gone:
            yield self.out(key[0], gone, back)

    def close(self) -> None:
        pass


def live_gaps(rows: DataFrame, key: str, threshold_seconds: int = 3600, delay: str = "1 hour") -> DataFrame:
    """Closed gaps per key. Rows are first reduced to the ends of every bucket, so a busy key sends few rows."""
    buckets = (
        rows.withWatermark("event_time", delay)
        .groupBy(key, F.window("event_time", f"{threshold_seconds} seconds").alias("w"))
        .agg(F.min(F.unix_micros("event_time")).alias("first_at"), F.max(F.unix_micros("event_time")).alias("last_at"))
        .select(key, "first_at", "last_at")
    )
    key_type = rows.schema[key].dataType.simpleString()
    found = buckets.groupBy(key).transformWithState(
        GapProcessor(key, threshold_seconds * 1_000_000), f"`{key}` {key_type}, {GapProcessor.OUT}", "Append", "None"
    )
    gaps = found.select(key, F.inline(F.arrays_zip("start_at", "end_at")))
    return gaps.select(
        key, F.timestamp_micros("start_at").cast("timestamp_ntz").alias("gap_start"), F.timestamp_micros("end_at").cast("timestamp_ntz").alias("gap_end")
    )


class SilenceProcessor(StatefulProcessor):
    """Last time seen per key with one timer: first the alarm behind it, then, once told, the end of the state.

    An alarm that is due when its row comes is told with the row, without a timer. Every call on state or timers is a
    message to the JVM: the timer's time follows from the state and is not asked for. One row per key and batch, with arrays.
    """

    OUT = "silent array<bigint>, start_at array<bigint>, end_at array<bigint>"

    def __init__(self, key: str, threshold_micros: int, keep_micros: int):
        self.threshold = threshold_micros
        self.keep = max(keep_micros, threshold_micros)
        self.out = Row(key, "silent", "start_at", "end_at")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "last_at bigint, told boolean")

    def _wake_at(self, last: int, told: bool) -> int:
        return -(-(last + (self.keep if told else self.threshold)) // 1000)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self.seen.get()
        last, told = before or (None, False)
        silent, gone, back = [], [], []
        for first, end in sorted((r.first_at, r.last_at) for r in rows):
            if last is not None and first - last > self.threshold:
                if not told:
                    silent.append(last)
                gone.append(last)
                back.append(first)
            if last is None or end > last:
                last, told = end, False
        mark = timerValues.getCurrentWatermarkInMs()
        if not told and self._wake_at(last, False) <= mark:
            silent.append(last)
            told = True
        wake, woke = self._wake_at(last, told), before and self._wake_at(*before)
        expired = told and wake <= mark
        if before and (expired or woke != wake):
            self.handle.deleteTimer(woke)
        if expired:
            self.seen.clear()
        elif before != (last, told):
            self.seen.update((last, told))
            if woke != wake:
                self.handle.registerTimer(wake)
        if silent or gone:
            yield self.out(key[0], silent, gone, back)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        before = self.seen.get()
        if before is None:
            return
        last, told = before
        if told or self.keep == self.threshold:
            self.seen.clear()
        else:
            self.seen.update((last, True))
            self.handle.registerTimer(self._wake_at(last, True))
        if not told:
            yield self.out(key[0], [last], [], [])

    def close(self) -> None:
        pass


def live_alarms(rows: DataFrame, key: str, threshold_seconds: int = 3600, delay: str = "1 hour", keep_seconds: int = 30 * 86400) -> DataFrame:
    """(key, kind, gap_start, gap_end): keys that fall silent, and the end of their silence if rows come again.

    A ``silent`` row comes once per gap: when the watermark passes the key's last row by the threshold, without any further
    row of the key, or with the row that ends the gap if that is seen first. A ``closed`` row follows with the end. The
    state of a key is two values and one timer, and goes ``keep_seconds`` after its last row: a key that returns later is
    new, and its gap is not closed. So state holds the keys of that span only. Rows without a key are left out.
    """
    buckets = (
        rows.where(F.col(key).isNotNull())
        .withWatermark("event_time", delay)
        .groupBy(key, F.window("event_time", f"{threshold_seconds} seconds").alias("w"))
        .agg(F.min(F.unix_micros("event_time")).alias("first_at"), F.max(F.unix_micros("event_time")).alias("last_at"))
        .select(key, F.window_time("w").alias("event_time"), "first_at", "last_at")
    )
    key_type = rows.schema[key].dataType.simpleString()
    processor = SilenceProcessor(key, threshold_seconds * 1_000_000, keep_seconds * 1_000_000)
    found = buckets.groupBy(key).transformWithState(processor, f"`{key}` {key_type}, {SilenceProcessor.OUT}", "Append", "EventTime")

    def told(kind: str, start: Column, end: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), start.alias("start_at"), end.cast("bigint").alias("end_at"))

    alarms = F.transform("silent", lambda at: told("silent", at, F.lit(None)))
    gaps = found.select(key, F.inline(F.concat(alarms, F.zip_with("start_at", "end_at", lambda a, b: told("closed", a, b)))))
    return gaps.select(
        key, "kind", F.timestamp_micros("start_at").cast("timestamp_ntz").alias("gap_start"), F.timestamp_micros("end_at").cast("timestamp_ntz").alias("gap_end")
    )


ROCKSDB = STATE_STORE["spark.sql.streaming.stateStore.providerClass"]
#: Counting a store's rows takes a look-up for each row written or removed; the count is only a metric.
UNCOUNTED = {"spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false"}


def run_available(spark: SparkSession, stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Process everything that is there into a parquet table and read it back."""
    out, checkpoint = scratch_path(spark, label), scratch_path(spark, f"{label}-state")
    settings = {**state_settings(spark, checkpoint), **UNCOUNTED}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        query = (
            stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
            .option("path", out).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(stream.schema).parquet(out)


def write_series(stream: DataFrame, path: str, checkpoint: str, step_minutes: int):
    """Write every batch of windows under its granularity. A replayed batch overwrites its own folder."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/granularity={step_minutes}/batch={batch_id}")

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
