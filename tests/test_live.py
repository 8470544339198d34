"""Streams over several batches, and the table of saved runs."""

import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from trafficlens.operators import results as rs
from trafficlens.operators.capacity import PRESETS
from trafficlens.operators.decisions import decide
from trafficlens.sources import logs as lg
from trafficlens.streaming import live

START = datetime(2024, 1, 1)


def write_logs(folder, batches):
    """One file per batch; modification times give the order."""
    for i, rows in enumerate(batches):
        path = folder / f"{i}.log"
        path.write_text("\n".join(f'{h} - - [{t:%d/%b/%Y:%H:%M:%S} -0400] "GET / HTTP/1.0" 200 5' for h, t in rows) + "\n")
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))


def test_late_rows_are_dropped(spark, tmp_path):
    """The watermark of a batch drops late rows from the batch after the next: rows may be kept longer, never shorter."""
    folder = tmp_path / "in"
    folder.mkdir()
    write_logs(
        folder,
        [
            [("a", START), ("b", START + timedelta(minutes=1)), ("a", START + timedelta(minutes=7))],
            [("a", START + timedelta(hours=5))],
            [("a", START + timedelta(hours=5, minutes=10))],
            [("late", START + timedelta(minutes=2)), ("a", START + timedelta(hours=9))],
        ],
    )
    rows = live.live_parse(lg.stream_lines(spark, str(folder), 1))
    out = live.run_available(spark, live.live_counts(rows, "5 minutes", "1 hour"), "late").orderBy("timestamp").collect()
    assert [(r.timestamp, r.request_count, r.unique_hosts) for r in out] == [
        (START, 2, 2), (START + timedelta(minutes=5), 1, 1), (START + timedelta(hours=5), 1, 1),
        (START + timedelta(hours=5, minutes=10), 1, 1),
    ]


def test_dedup_across_batches(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write_logs(folder, [[("a", START), ("b", START)], [("a", START), ("c", START)]])
    rows = live.live_dedup(live.live_parse(lg.stream_lines(spark, str(folder), 1)))
    assert sorted(r.host for r in live.run_available(spark, rows, "dedup").collect()) == ["a", "b", "c"]


def test_decisions_over_batches_equal_the_batch_fold(spark, tmp_path):
    loads = [(s, START + timedelta(minutes=5 * i), float((i * 37 + k * 90) % 700)) for k, s in enumerate("xy") for i in range(60)]
    schema = "series_id string, timestamp timestamp_ntz, load double"
    path = str(tmp_path / "in")
    for b in range(3):
        part = [r for r in loads if b * 20 <= (r[1] - START).total_seconds() / 300 < (b + 1) * 20]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    cols = ["series_id", "config_id", "policy", "timestamp", "action", "target_servers"]
    policies = ("balanced", "predictive")
    got = live.run_available(spark, live.live_decisions(stream, PRESETS, policies), "fold").select(*cols)
    want = decide(spark.createDataFrame(loads, schema), PRESETS, 300, policies).select(*cols)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_gap_over_batches(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    gone = START + timedelta(minutes=30)
    back = START + timedelta(hours=6)
    write_logs(folder, [[("a", START), ("a", gone)], [("a", back)], [("a", back + timedelta(hours=9))]])
    rows = live.live_parse(lg.stream_lines(spark, str(folder), 1))
    out = live.run_available(spark, live.live_gaps(rows, "host"), "gaps").collect()
    assert [(r.gap_start, r.gap_end) for r in out] == [(gone, back)]


def runs(spark):
    rows = [(f"r{i}", f"Run {i}", "Night test" if i == 2 else None, START + timedelta(hours=i), "balanced" if i % 2 else "aggressive", "reactive", 10.0 * i, 0.01 * i) for i in range(6)]
    return spark.createDataFrame(
        rows, "id string, name string, description string, created_at timestamp_ntz, config_preset string, policy_type string, total_cost double, sla_violation_rate double"
    )


def test_saved_runs(spark, tmp_path):
    path = str(tmp_path / "runs")
    rs.save_runs(runs(spark), path)
    table = rs.load_runs(spark, path)
    assert rs.get_run(table, "r3").count() == 1 and rs.get_run(table, "zz").count() == 0
    assert [r.id for r in rs.list_runs(table, limit=2, offset=1).collect()] == ["r4", "r3"]
    assert [r.id for r in rs.list_runs(table, search="night").collect()] == ["r2"]
    assert [r.id for r in rs.list_runs(table, preset="balanced").collect()] == ["r5", "r3", "r1"]
    assert rs.totals(table).first().avg_cost == 25.0
    assert rs.delete_run(spark, path, "r3") and not rs.delete_run(spark, path, "r3")
    assert sorted(r.id for r in rs.load_runs(spark, path).collect()) == ["r0", "r1", "r2", "r4", "r5"]
    empty = rs.totals(table.where("false")).first()
    assert (empty.total_results, empty.avg_cost, empty.avg_sla_violation_rate) == (0, 0.0, 0.0)


def test_deleting_is_safe_for_any_preset(spark, tmp_path):
    path = str(tmp_path / "runs")
    table = runs(spark)
    preset = F.when(F.col("id") == "r0", "a/b").when(F.col("id") == "r1", "a/b").when(F.col("id") == "r2", "007").when(F.col("id") == "r3", "x=y")
    rs.save_runs(table.withColumn("config_preset", preset), path)
    for gone in ("r1", "r2", "r5"):
        assert rs.delete_run(spark, path, gone)
    left = {r.id: r.config_preset for r in rs.load_runs(spark, path).collect()}
    assert left == {"r0": "a/b", "r3": "x=y", "r4": None}


def test_hash_depends_on_values_and_order(spark):
    rows = [("a", START, 1.0), ("a", START + timedelta(hours=1), 2.0), ("b", START, 2.0), ("b", START + timedelta(hours=1), 1.0)]
    loads = spark.createDataFrame(rows, "series_id string, timestamp timestamp_ntz, load double")
    first = {r.series_id: r.data_hash for r in rs.load_hash(loads, ["series_id"]).collect()}
    again = {r.series_id: r.data_hash for r in rs.load_hash(loads.orderBy(F.desc("timestamp")), ["series_id"]).collect()}
    assert first == again and first["a"] != first["b"]


def test_a_silent_key_alarms_without_a_further_row(spark, tmp_path):
    """Key b stops; only rows of a follow. Its alarm comes with the watermark, and its end once it is back."""
    folder = tmp_path / "in"
    folder.mkdir()
    hour = timedelta(hours=1)
    write_logs(
        folder,
        [
            [("a", START), ("b", START + timedelta(minutes=5))],
            [("a", START + k * hour / 2) for k in range(1, 13)],
            [("a", START + 6 * hour + k * hour / 2) for k in range(1, 9)],
            [("b", START + 11 * hour), ("a", START + 11 * hour), ("a", START + 20 * hour)],
            [("a", START + 20 * hour + timedelta(minutes=5))],
        ],
    )
    rows = live.live_parse(lg.stream_lines(spark, str(folder), 1))
    got = {(r.host, r.kind, r.gap_start, r.gap_end) for r in live.run_available(spark, live.live_alarms(rows, "host"), "alarms").collect()}
    silent = START + timedelta(minutes=5)
    assert {("b", "silent", silent, None), ("b", "closed", silent, START + 11 * hour), ("b", "silent", START + 11 * hour, None)} <= got
    assert ("a", "silent", START + 11 * hour, None) in got and len([g for g in got if g[0] == "b"]) == 3


def test_state_of_a_silent_key_expires(spark, tmp_path):
    """After ``keep_seconds`` the key is forgotten: its return closes no gap."""
    folder = tmp_path / "in"
    folder.mkdir()
    hour = timedelta(hours=1)
    write_logs(folder, [[("b", START)], [("a", START + 5 * hour)], [("a", START + 12 * hour)], [("a", START + 30 * hour)], [("b", START + 31 * hour), ("a", START + 31 * hour)], [("a", START + 40 * hour)]])
    rows = live.live_parse(lg.stream_lines(spark, str(folder), 1))
    got = [(r.kind, r.gap_start) for r in live.run_available(spark, live.live_alarms(rows, "host", keep_seconds=6 * 3600), "expiry").where("host = 'b'").collect()]
    assert sorted(got) == [("silent", START), ("silent", START + 31 * hour)]
