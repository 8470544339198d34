"""Streaming forms, run over everything that is there; results are read back as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trafficlens.operators.decisions import decide
from trafficlens.plans import views as v
from trafficlens.plans.queries_capacity import CONFIGS, DECISION_SQL
from trafficlens.plans.registry import query
from trafficlens.session import scratch_path
from trafficlens.streaming import live

HOURLY = "SELECT date_trunc('hour', ts) AS ts, count(*) AS n, count(DISTINCT host) AS hosts, sum(CAST(status >= 400 AS INT)) AS errors, sum(greatest(bytes, 0)) AS total FROM parsed GROUP BY 1"
CLOSED = f'SELECT ts AS "timestamp", n AS request_count, hosts AS unique_hosts, errors AS error_count, total AS bytes_total FROM ({HOURLY}) WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM parsed) - INTERVAL 1 HOUR'
COUNTS = "timestamp:t request_count:i unique_hosts:i error_count:i bytes_total:i"


def _stream(spark, d, name):
    schema = v.table(spark, d, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


def _rows(spark, d):
    return live.live_parse(v.lines_of(_stream(spark, d, "events")).drop("ts"))


@query(
    "g1_live_parse", "line_no:i host:s timestamp:t method:s url:s status:i bytes:i",
    'SELECT line_no, host, ts AS "timestamp", method, url, status, bytes FROM parsed', "parsed",
)
def g1(spark, d):
    return live.run_available(spark, _rows(spark, d), "live-parse")


@query("g2_live_counts", COUNTS, CLOSED, "parsed")
def g2(spark, d):
    return live.run_available(spark, live.live_counts(_rows(spark, d), "1 hour", exact_hosts=True), "live-counts")


@query(
    "g3_live_dedup", "host:s timestamp:t url:s method:s", 'SELECT DISTINCT host, ts AS "timestamp", url, method FROM parsed', "parsed",
)
def g3(spark, d):
    return live.run_available(spark, live.live_dedup(_rows(spark, d)), "live-dedup")


def _load_stream(spark, d):
    path = scratch_path(spark, "load-stream")
    v.loads(spark, d).write.parquet(path)
    return spark.readStream.schema(v.loads(spark, d).schema).parquet(path)


LIVE = "series_id:s config_id:s policy:s timestamp:t load:d action:s current_servers:i target_servers:i utilization:d"


@query("g4_live_decisions", LIVE, DECISION_SQL.format("balanced"), "decided")
def g4(spark, d):
    return live.run_available(spark, live.live_decisions(_load_stream(spark, d), CONFIGS), "live-decisions")


@query(
    "g4_stream_equals_batch", "in_batch:i in_stream:i differing:i",
    "SELECT n AS in_batch, n AS in_stream, 0 AS differing FROM (SELECT count(*) AS n FROM decided WHERE place >= 0 AND policy <> 'reactive')", "decided",
)
def g4_same(spark, d):
    policies = ("balanced", "predictive")
    cols = ["series_id", "config_id", "policy", "timestamp", "action", "current_servers", "target_servers"]
    batch = decide(v.loads(spark, d), CONFIGS, v.HOUR, policies).select(*cols)
    stream = live.run_available(spark, live.live_decisions(_load_stream(spark, d), CONFIGS, policies), "live-decisions").select(*cols)
    tagged = batch.withColumn("b", F.lit(1)).withColumn("s", F.lit(0)).unionByName(stream.withColumn("b", F.lit(0)).withColumn("s", F.lit(1)))
    rows = tagged.groupBy(*cols).agg(F.sum("b").alias("b"), F.sum("s").alias("s"))
    return rows.agg(F.sum("b").alias("in_batch"), F.sum("s").alias("in_stream"), F.count_if(F.col("b") != F.col("s")).alias("differing"))


@query(
    "g5_live_gaps", "host:s gap_start:t gap_end:t",
    """SELECT host, s AS gap_start, ts AS gap_end FROM (SELECT host, ts, lag(ts) OVER (PARTITION BY host ORDER BY ts, line_no) AS s FROM parsed)
    WHERE epoch(ts) - epoch(s) > 3600 AND time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM parsed) - INTERVAL 1 HOUR""",
    "parsed",
)
def g5(spark, d):
    return live.run_available(spark, live.live_gaps(_rows(spark, d), "host"), "live-gaps")


@query(
    "g5_live_alarms", "host:s kind:s gap_start:t gap_end:t",
    """WITH mark AS (SELECT max(ts) - INTERVAL 1 HOUR AS w FROM parsed),
    seen AS (SELECT host, ts, line_no FROM parsed, mark WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= w),
    gaps AS (SELECT host, s, ts FROM (SELECT host, ts, lag(ts) OVER (PARTITION BY host ORDER BY ts, line_no) AS s FROM seen) WHERE epoch(ts) - epoch(s) > 3600)
    SELECT host, 'closed' AS kind, s AS gap_start, ts AS gap_end FROM gaps UNION ALL SELECT host, 'silent', s, NULL FROM gaps
    UNION ALL SELECT host, 'silent', last, NULL FROM (SELECT host, max(ts) AS last FROM seen GROUP BY 1), mark WHERE last + INTERVAL 1 HOUR <= w""",
    "parsed",
)
def g5_alarms(spark, d):
    return live.run_available(spark, live.live_alarms(_rows(spark, d), "host", keep_seconds=366 * 86400), "live-alarms")


@query("g6_live_series_sink", f"granularity:i {COUNTS}", CLOSED.replace("SELECT ts", "SELECT 60 AS granularity, ts", 1), "parsed")
def g6(spark, d):
    path = scratch_path(spark, "live-series")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.ROCKSDB)
    counts = live.live_counts(_rows(spark, d), "1 hour", exact_hosts=True)
    live.write_series(counts, path, scratch_path(spark, "live-series-state"), 60).awaitTermination()
    return spark.read.parquet(path)
