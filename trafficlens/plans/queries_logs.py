"""Queries over log lines: sources, parsing, cleaning, data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from trafficlens.functions import calendar as cal
from trafficlens.functions import logfields as lf
from trafficlens.functions import values as val
from trafficlens.operators import clean as cl
from trafficlens.operators import features as fe
from trafficlens.operators import sketches as sk
from trafficlens.operators.parse import mark_lines, rejected_lines
from trafficlens.operators.series import SeriesSpec, multi_series
from trafficlens.plans import views as v
from trafficlens.plans.registry import query
from trafficlens.plans.sqlviews import VALID_SQL, category_sql, extension_sql, status_class_sql
from trafficlens.session import cut_lineage, scratch_path
from trafficlens.sources import loads as ld
from trafficlens.sources import logs as lg
from trafficlens.sources import tables as tb

PARSED = "host:s timestamp:t utc_offset:s method:s url:s protocol:s status:i bytes:i"
PARSED_SQL = 'SELECT host, ts AS "timestamp", utc_offset, method, url, protocol, status, bytes FROM parsed'
KEY = "line_no:i"


def _log_file(spark, d) -> str:
    path = scratch_path(spark, "log")
    v.reqlog_lines(spark, d).select("value").write.text(path)
    return path


@query("s1_read_lines", "value:s", "SELECT value FROM lines", "lines")
def s1(spark, d):
    return lg.read_lines(spark, _log_file(spark, d))


@query("s2_parse_file", PARSED, PARSED_SQL, "parsed")
def s2(spark, d):
    return lg.read_log(spark, _log_file(spark, d))


@query("s4_csv_loads", "series_id:s timestamp:t load:d", 'SELECT series_id, ts AS "timestamp", load FROM loads', "loads")
def s4(spark, d):
    path = scratch_path(spark, "loads-csv")
    stamp = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp")
    v.loads(spark, d).select("series_id", stamp, "load").write.option("header", True).csv(path)
    return ld.read_csv_loads(spark, path, keep=["series_id"])


@query(
    "s6_text_loads", "event_id:i part:i load:d",
    r"""
    SELECT event_id, part - 1 AS part, greatest(TRY_CAST(token AS DOUBLE), 0) AS load FROM (
      SELECT event_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS part FROM (
        SELECT event_id, string_split_regex(trim(line), '[,\s]+') AS tokens FROM (
          SELECT event_id, CASE event_id % 10 WHEN 0 THEN '# note ' || event_id WHEN 1 THEN '  ' WHEN 2 THEN c || ',' || (c + 1) || ' ' || (c + 2)
            WHEN 3 THEN 'n/a' WHEN 4 THEN '-' || c ELSE CAST(c AS VARCHAR) END AS line
          FROM (SELECT event_id, CAST(round(value * 100) AS BIGINT) AS c FROM events))
        WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#')))
    WHERE TRY_CAST(token AS DOUBLE) IS NOT NULL""",
)
def s6(spark, d):
    c = F.round(F.col("value") * 100).cast("bigint")
    kind = F.col("event_id") % 10
    line = (
        F.when(kind == 0, F.concat(F.lit("# note "), F.col("event_id")))
        .when(kind == 1, "  ")
        .when(kind == 2, F.concat(c, F.lit(","), c + 1, F.lit(" "), c + 2))
        .when(kind == 3, "n/a")
        .when(kind == 4, F.concat(F.lit("-"), c))
        .otherwise(c.cast("string"))
    )
    return ld.parse_text_loads(v.table(spark, d, "events").select("event_id", line.alias("value")))


@query(
    "s7_sniff", "source:s is_log:b",
    """SELECT 'lines' AS source, bool_or(contains(value, ' - - [') AND contains(value, '] "')) AS is_log FROM (SELECT value FROM lines ORDER BY line_no LIMIT 10)
    UNION ALL SELECT 'documents', bool_or(contains(text, ' - - [') AND contains(text, '] "')) FROM (SELECT text FROM documents ORDER BY doc_id LIMIT 10)""",
    "lines",
)
def s7(spark, d):
    lines = v.reqlog_lines(spark, d).orderBy("line_no")
    docs = v.table(spark, d, "documents").orderBy("doc_id").select(F.col("text").alias("value"))
    return (
        lg.is_log(lines).withColumn("source", F.lit("lines")).unionByName(lg.is_log(docs).withColumn("source", F.lit("documents")))
    )


@query(
    "s8_log_counts", "timestamp:t request_count:i",
    """
    SELECT g.ts AS "timestamp", coalesce(n, 0) AS request_count FROM (
      SELECT unnest(generate_series(time_bucket(INTERVAL 5 MINUTE, min(ts)), time_bucket(INTERVAL 5 MINUTE, max(ts)), INTERVAL 5 MINUTE)) AS ts FROM parsed) g
    LEFT JOIN (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS ts, count(*) AS n FROM parsed GROUP BY 1) c ON c.ts = g.ts""",
    "parsed",
)
def s8(spark, d):
    return lg.log_counts(v.reqlog_lines(spark, d))


@query("s10_sample_loads", "series_id:s timestamp:t load:d")
def s10(spark, d):
    return ld.sample_loads(v.series(spark, d))


@query("s11_timestamps", "period:i timestamp:t", "SELECT event_id AS period, TIMESTAMP '1995-07-01 00:00:00' + event_id * INTERVAL 5 MINUTE AS \"timestamp\" FROM events")
def s11(spark, d):
    return ld.with_timestamps(v.table(spark, d, "events").select(F.col("event_id").alias("period")), 5.0)


SERIES = "series_id:s timestamp:t y:i"
SERIES_SQL = 'SELECT series_id, ts AS "timestamp", y FROM series'


@query("s12_parquet_roundtrip", SERIES, SERIES_SQL, "series")
def s12(spark, d):
    path = scratch_path(spark, "series") + ".parquet"
    tb.save(v.series(spark, d), path)
    return tb.load(spark, path)


@query("s13_csv_roundtrip", SERIES, SERIES_SQL, "series")
def s13(spark, d):
    path = scratch_path(spark, "series") + ".csv"
    rows = v.series(spark, d)
    tb.save(rows, path, "csv")
    return tb.load(spark, path, schema=rows.schema)


def _granular_sql(minutes: int) -> str:
    step = f"INTERVAL {minutes} MINUTE"
    return f"""
    SELECT {minutes} AS granularity, g.ts AS "timestamp", coalesce(n, 0) AS request_count, coalesce(hosts, 0) AS unique_hosts,
      coalesce(errors, 0) AS error_count, coalesce(errors / n, 0) AS error_rate, coalesce(total, 0) AS bytes_total,
      coalesce(total / n, 0) AS bytes_avg, coalesce(top, 0) AS bytes_max, coalesce(n / nullif(hosts, 0), 0) AS requests_per_host
    FROM (SELECT unnest(generate_series(time_bucket({step}, min(ts)), time_bucket({step}, max(ts)), {step})) AS ts FROM fixed) g
    LEFT JOIN (SELECT time_bucket({step}, ts) AS ts, count(*) AS n, count(DISTINCT host) AS hosts, sum(CAST(is_error AS INT)) AS errors,
      sum(bytes) AS total, max(bytes) AS top FROM fixed GROUP BY 1) c ON c.ts = g.ts"""


GRANULAR = "granularity:i timestamp:t request_count:i unique_hosts:i error_count:i error_rate:d bytes_total:i bytes_avg:d bytes_max:i requests_per_host:d"


@query("s14_by_granularity", GRANULAR, " UNION ALL ".join(_granular_sql(m) for m in (5, 15)), "fixed")
def s14(spark, d):
    path = scratch_path(spark, "granular")
    tb.save_by_granularity(multi_series(v.fixed(spark, d), (300, 900)), path)
    return tb.load(spark, path, "parquet")


@query("a3_multi_granularity", GRANULAR, " UNION ALL ".join(_granular_sql(m) for m in (5, 15, 60)), "fixed")
def a3(spark, d):
    return multi_series(v.fixed(spark, d), (300, 900, 3600), SeriesSpec())


@query("p1_parse_log", f"{KEY} {PARSED}", 'SELECT line_no, host, ts AS "timestamp", utc_offset, method, url, protocol, status, bytes FROM parsed', "parsed")
def p1(spark, d):
    return v.parsed(spark, d)


@query("p2_rejects", f"{KEY} value:s", "SELECT line_no, value FROM lines WHERE starts_with(value, 'garbage')", "lines")
def p2(spark, d):
    return rejected_lines(v.reqlog_lines(spark, d))


@query("p3_wall_clock", f"{KEY} timestamp:t utc_offset:s", 'SELECT line_no, ts AS "timestamp", utc_offset FROM parsed', "parsed")
def p3(spark, d):
    return v.parsed(spark, d)


@query("p4_status_valid", f"{KEY} status:i status_valid:b", f"SELECT line_no, status, status IN {VALID_SQL} AS status_valid FROM parsed", "parsed")
def p4(spark, d):
    return cl.fix_values(v.parsed(spark, d))


@query("p5_negative_bytes", f"{KEY} bytes:i", "SELECT line_no, greatest(bytes, 0) AS bytes FROM parsed", "parsed")
def p5(spark, d):
    return cl.fix_values(v.parsed(spark, d))


@query("p6_status_class", f"{KEY} status_category:s", f"SELECT line_no, {status_class_sql('status')} AS status_category FROM parsed", "parsed")
def p6(spark, d):
    return cl.with_derived(v.parsed(spark, d))


@query("p7_outcome_flags", f"{KEY} is_error:b is_success:b", "SELECT line_no, status >= 400 AS is_error, status = 200 AS is_success FROM parsed", "parsed")
def p7(spark, d):
    return cl.with_derived(v.parsed(spark, d))


URLS_SQL = "SELECT 'log' || line_no AS id, url FROM parsed UNION ALL SELECT 'page' || page_id, url FROM pages"


def _urls(spark, d):
    log = v.parsed(spark, d).select(F.concat(F.lit("log"), "line_no").alias("id"), "url")
    pages = v.table(spark, d, "pages").select(F.concat(F.lit("page"), "page_id").alias("id"), "url")
    return log.unionByName(pages)


@query("p8_extension", "id:s extension:s", f"SELECT id, {extension_sql('url')} AS extension FROM ({URLS_SQL})", "parsed")
def p8(spark, d):
    return _urls(spark, d).withColumn("extension", lf.url_extension(F.col("url")))


@query("p9_url_category", "id:s url_category:s", f"SELECT id, {category_sql('url')} AS url_category FROM ({URLS_SQL})", "parsed")
def p9(spark, d):
    return _urls(spark, d).withColumn("url_category", lf.url_category(F.col("url")))


AT = "series_id:s timestamp:t"


@query(
    "p10_calendar_parts", f"{AT} year:i month:i day:i hour:i minute:i day_of_week:i day_of_year:i week_of_year:i",
    """SELECT series_id, ts AS "timestamp", year(ts) AS year, month(ts) AS month, day(ts) AS day, hour(ts) AS hour, minute(ts) AS minute,
      isodow(ts) - 1 AS day_of_week, dayofyear(ts) AS day_of_year, weekofyear(ts) AS week_of_year FROM daily""",
    "daily",
)
def p10(spark, d):
    return cal.with_calendar(v.daily(spark, d), cyclical=False)


@query(
    "p11_calendar_flags", f"{AT} is_weekend:i is_business_hour:i is_peak_hour:i",
    """SELECT series_id, ts AS "timestamp", CAST(isodow(ts) >= 6 AS INT) AS is_weekend,
      CAST(hour(ts) BETWEEN 8 AND 17 AS INT) AS is_business_hour, CAST(hour(ts) BETWEEN 11 AND 16 AS INT) AS is_peak_hour FROM series""",
    "series",
)
def p11(spark, d):
    return cal.with_calendar(v.series(spark, d), cyclical=False)


@query(
    "p12_day_parts", f"{AT} time_of_day:s part_of_day:s",
    """SELECT series_id, ts AS "timestamp",
      CASE WHEN hour(ts) <= 5 THEN 'night' WHEN hour(ts) <= 11 THEN 'morning' WHEN hour(ts) <= 17 THEN 'afternoon' WHEN hour(ts) <= 21 THEN 'evening' ELSE 'night_late' END AS time_of_day,
      CASE WHEN hour(ts) <= 6 THEN 'night' WHEN hour(ts) <= 12 THEN 'morning' WHEN hour(ts) <= 18 THEN 'afternoon' ELSE 'evening' END AS part_of_day FROM series""",
    "series",
)
def p12(spark, d):
    return cal.with_calendar(v.series(spark, d), cyclical=False)


_CYCLES = {"hour": ("hour(ts)", 24), "dow": ("(isodow(ts) - 1)", 7), "dom": ("day(ts)", 31), "month": ("month(ts)", 12), "mod": ("(hour(ts) * 60 + minute(ts))", 1440)}


@query(
    "p13_cycles", f"{AT} " + " ".join(f"{n}_sin:d {n}_cos:d" for n in _CYCLES),
    'SELECT series_id, ts AS "timestamp", '
    + ", ".join(f"sin(2 * pi() * {e} / {p}) AS {n}_sin, cos(2 * pi() * {e} / {p}) AS {n}_cos" for n, (e, p) in _CYCLES.items())
    + " FROM series",
    "series",
)
def p13(spark, d):
    return cal.with_calendar(v.series(spark, d))


@query(
    "p14_clean_load", "event_id:i load:d",
    "SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 5 = 0 THEN 0 ELSE value END AS load FROM events",
)
def p14(spark, d):
    raw = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).when(F.col("event_id") % 5 == 0, -F.col("value")).otherwise(F.col("value"))
    return v.table(spark, d, "events").withColumn("load", val.clean_load(raw))


@query(
    "p15_select_features", f"{AT} lag_24:d unknown:d y:d share:d",
    """SELECT series_id, ts AS "timestamp", coalesce(lag(y, 24) OVER w, 0) AS lag_24, 0 AS unknown, y, coalesce(y / nullif(lag(y, 1) OVER w, 0), 0) AS share
    FROM series WINDOW w AS (PARTITION BY series_id ORDER BY ts)""",
    "series",
)
def p15(spark, d):
    from trafficlens.operators.scale import halo

    def build(w):
        last = F.lag("y", 1).over(w)
        share = F.when(last == 0, F.lit(float("inf"))).otherwise(val.ratio(F.col("y"), last))
        return {"lag_24": F.lag("y", 24).over(w), "share": share}

    rows = halo(v.series(spark, d), ["series_id"], "timestamp", v.HOUR, build, back=24)
    return fe.select_features(rows, ["lag_24", "unknown", "y", "share"], keep=["series_id", "timestamp"])


@query(
    "p16_estimated_metadata", f"{AT} unique_hosts:i error_count:i error_rate:d success_rate:d bytes_total:i bytes_avg:i bytes_max:i requests_per_host:d bytes_per_request:d",
    """SELECT series_id, ts AS "timestamp", greatest(1, CAST(floor(y * 0.7::DOUBLE) AS BIGINT)) AS unique_hosts, greatest(0, CAST(floor(y * 0.02::DOUBLE) AS BIGINT)) AS error_count,
      floor(y * 0.02::DOUBLE) / greatest(1, y) AS error_rate, 1 - floor(y * 0.02::DOUBLE) / greatest(1, y) AS success_rate, y * 5000 AS bytes_total,
      5000 AS bytes_avg, 50000 AS bytes_max, y / greatest(1, CAST(floor(y * 0.7::DOUBLE) AS BIGINT)) AS requests_per_host, y * 5000 / greatest(1, y) AS bytes_per_request
    FROM series""",
    "series",
)
def p16(spark, d):
    return fe.estimated_metadata(v.series(spark, d))


@query(
    "p17_scenario", f"{AT} scenario:d",
    """SELECT series_id, ts AS "timestamp", y * 1.5 * CASE WHEN place >= greatest(0, floor(n_rows * 0.6) - floor(greatest(1, n_rows // 20) / 2))
      AND place < least(n_rows, floor(n_rows * 0.6) + floor(greatest(1, n_rows // 20) / 2)) THEN 3 ELSE 1 END AS scenario FROM numbered""",
    "numbered",
)
def p17(spark, d):
    return fe.scenario(v.series(spark, d), v.HOUR, 1.5, 0.6, 3.0)


@query(
    "p18_time_range", f"{KEY} timestamp:t url:s",
    "SELECT line_no, ts AS \"timestamp\", url FROM parsed WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-06 12:00:00'",
    "parsed",
)
def p18(spark, d):
    rows = v.parsed(spark, d)
    return rows.where(
        (F.col("timestamp") >= F.lit("2024-01-05 00:00:00").cast("timestamp_ntz")) & (F.col("timestamp") < F.lit("2024-01-06 12:00:00").cast("timestamp_ntz"))
    )


@query("q1_dedup", f"{KEY} {PARSED}", 'SELECT line_no, host, ts AS "timestamp", utc_offset, method, url, protocol, status, bytes FROM dedup', "dedup")
def q1(spark, d):
    return v.deduplicated(spark, d)


@query("q2_sorted", f"timestamp:t {KEY} host:s", 'SELECT ts AS "timestamp", line_no, host FROM dedup ORDER BY ts, line_no', "dedup")
def q2(spark, d):
    return v.deduplicated(spark, d).orderBy("timestamp", "line_no")


@query(
    "q3_gaps", "host:s gap_start:t gap_end:t gap_seconds:d",
    """SELECT * FROM (SELECT host, lag(ts) OVER h AS gap_start, ts AS gap_end, epoch(ts) - epoch(lag(ts) OVER h) AS gap_seconds FROM dedup
      WINDOW h AS (PARTITION BY host ORDER BY ts, line_no)) WHERE gap_seconds > 3600""",
    "dedup",
)
def q3(spark, d):
    return cl.find_gaps(v.deduplicated(spark, d), keys=["host"])


@query("q4_outliers", f"{KEY} bytes:i bytes_outlier:b", "SELECT line_no, bytes, bytes_outlier FROM cleaned", "cleaned")
def q4(spark, d):
    return v.cleaned(spark, d)


@query("q4_fences", "q1:d q3:d low:d high:d", "SELECT * FROM fences", "fences")
def q4_fences(spark, d):
    return cl.outlier_bounds(v.fixed(spark, d))


@query(
    "q5_cleaning_report", "original_rows:i final_rows:i duplicates_removed:i invalid_status:i negative_bytes_fixed:i missing_periods:i outliers_detected:i",
    f"""SELECT (SELECT count(*) FROM parsed) AS original_rows, (SELECT count(*) FROM cleaned) AS final_rows,
      (SELECT count(*) FROM parsed) - (SELECT count(*) FROM cleaned) AS duplicates_removed,
      (SELECT count(*) FROM dedup WHERE status NOT IN {VALID_SQL}) AS invalid_status, (SELECT count(*) FROM dedup WHERE bytes < 0) AS negative_bytes_fixed,
      (SELECT count(*) FROM (SELECT epoch(ts) - epoch(lag(ts) OVER (ORDER BY ts, line_no)) AS g FROM cleaned) WHERE g > 3600) AS missing_periods,
      (SELECT count(*) FROM cleaned WHERE bytes_outlier) AS outliers_detected""",
    "parsed cleaned",
)
def q5(spark, d):
    return cl.cleaning_report(v.parsed(spark, d))


@query(
    "q6_log_statistics", "total_records:i unique_hosts:i first_time:t last_time:t total_bytes:i avg_bytes:d parse_errors:i",
    """SELECT count(*) AS total_records, count(DISTINCT host) AS unique_hosts, min(ts) AS first_time, max(ts) AS last_time, sum(bytes) AS total_bytes,
      avg(bytes) AS avg_bytes, (SELECT count(*) FROM lines) - count(*) AS parse_errors FROM parsed""",
    "lines parsed",
)
def q6(spark, d):
    return cl.log_statistics(mark_lines(v.reqlog_lines(spark, d)))


@query(
    "q6_counts_by_value", "field:s item:s n:i",
    """SELECT 'status' AS field, CAST(status AS VARCHAR) AS item, count(*) AS n FROM parsed GROUP BY 2
    UNION ALL SELECT 'method', method, count(*) FROM parsed GROUP BY 2""",
    "parsed",
)
def q6_counts(spark, d):
    return cl.value_counts(v.parsed(spark, d), "status", "method")


@query(
    "q7_top_values", "field:s item:s n:i",
    """SELECT * FROM (SELECT 'url_category' AS field, url_category AS item, count(*) AS n FROM fixed GROUP BY 2)
    UNION ALL SELECT * FROM (SELECT 'extension', extension, count(*) AS n FROM fixed GROUP BY 2 ORDER BY n DESC, 2 LIMIT 15)
    UNION ALL SELECT * FROM (SELECT 'status', CAST(status AS VARCHAR), count(*) AS n FROM fixed GROUP BY 2 ORDER BY n DESC, 2 LIMIT 10)""",
    "fixed",
)
def q7(spark, d):
    counts = cl.value_counts(v.fixed(spark, d), "url_category", "extension", "status")
    return cl.top_values(counts, {"extension": 15, "status": 10})


@query(
    "q7_frequent_items", "field:s item:s n:i max_error:i",
    """SELECT field, item, n, ceil(total * 3.5 / 16384) AS max_error FROM (
      SELECT field, item, count(*) AS n, sum(count(*)) OVER (PARTITION BY field) AS total FROM (
        SELECT 'url_category' AS field, url_category AS item FROM fixed UNION ALL SELECT 'extension', extension FROM fixed
        UNION ALL SELECT 'status', CAST(status AS VARCHAR) FROM fixed) WHERE item IS NOT NULL GROUP BY 1, 2)""",
    "fixed",
)
def q7_frequent(spark, d):
    fields = ("url_category", "extension", "status")
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("item")) for f in fields])
    rows = v.fixed(spark, d).select(F.date_trunc("hour", "timestamp").alias("hour"), F.inline(pairs))
    hourly = sk.item_sketches(rows, ["hour", "field"], "item")
    return sk.frequent_items(sk.merge_item_sketches(hourly, ["field"]), ["field"], 1000)


@query(
    "z4_sketch_rollup", "status_category:s prob:d n:i within:b",
    "SELECT status_category, unnest([0.25, 0.5, 0.75, 0.95]) AS prob, count(bytes) AS n, true AS within FROM fixed WHERE bytes IS NOT NULL AND status_category IS NOT NULL GROUP BY status_category",
    "fixed",
)
def z4_sketches(spark, d):
    """Quantiles from hourly sketches that were written and merged; ``within``: twice the rank error around the exact ranks."""
    probs = {"q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95}
    rows = v.fixed(spark, d).where(F.col("status_category").isNotNull()).select("status_category", F.col("bytes").cast("double").alias("x"), F.date_trunc("hour", "timestamp").alias("hour"))
    hourly = cut_lineage(spark, sk.quantile_sketches(rows, ["status_category", "hour"], "x"), "hour-sketches")
    found = sk.sketch_quantiles(sk.merge_quantile_sketches(hourly, ["status_category"]), ["status_category"], probs)
    pairs = F.array(*[F.struct(F.lit(p).alias("prob"), F.col(c).alias("value")) for c, p in probs.items()])
    long = found.select("status_category", "n", F.inline(pairs))
    x, value = F.col("x"), F.col("value")
    ranks = rows.where(x.isNotNull()).join(long, "status_category").groupBy("status_category", "prob", "n").agg(F.avg((x < value).cast("int")).alias("lo"), F.avg((x <= value).cast("int")).alias("hi"))
    slack = 2 * sk.rank_error()
    return ranks.withColumn("within", (F.col("lo") - slack <= F.col("prob")) & (F.col("prob") <= F.col("hi") + slack))


@query(
    "q8_interval", "series_id:s n:i total_minutes:d interval_minutes:d",
    """SELECT series_id, count(ts) AS n, (epoch(max(ts)) - epoch(min(ts))) / 60 AS total_minutes, (epoch(max(ts)) - epoch(min(ts))) / 60 / (count(ts) - 1) AS interval_minutes
    FROM series GROUP BY 1""",
    "series",
)
def q8(spark, d):
    return cl.infer_interval(v.series(spark, d), keys=["series_id"])


@query(
    "q9_null_counts", "series_id:s x_nulls:i n_nulls:i zero_windows:i",
    "SELECT series_id, count(*) FILTER (x IS NULL) AS x_nulls, 0 AS n_nulls, count(*) FILTER (n = 0) AS zero_windows FROM sparse GROUP BY 1",
    "sparse",
)
def q9(spark, d):
    rows = v.sparse(spark, d)
    nulls = cl.null_counts(rows, ["x", "n"], ["series_id"])
    zeros = rows.groupBy("series_id").agg(F.count_if(F.col("n") == 0).alias("zero_windows"))
    return nulls.join(zeros, "series_id")


@query(
    "q10_size_histogram", "bin:i n:i",
    "SELECT floor(log10(bytes) / 0.5) AS bin, count(*) AS n FROM fixed WHERE bytes > 0 GROUP BY 1",
    "fixed",
)
def q10(spark, d):
    return cl.size_histogram(v.fixed(spark, d))


@query(
    "q10_sizes_by_class", "status_category:s q25:d median:d q75:d",
    """SELECT status_category, quantile_cont(CAST(bytes AS DOUBLE), 0.25) AS q25, quantile_cont(CAST(bytes AS DOUBLE), 0.5) AS median, quantile_cont(CAST(bytes AS DOUBLE), 0.75) AS q75
    FROM fixed WHERE status_category IS NOT NULL GROUP BY 1""",
    "fixed",
)
def q10_sizes(spark, d):
    from trafficlens.operators.scale import quantiles

    rows = v.fixed(spark, d).where(F.col("status_category").isNotNull())
    return quantiles(rows, ["status_category"], "bytes", {"q25": 0.25, "median": 0.5, "q75": 0.75})


@query(
    "z1_safe_division", "event_id:i share:d finite:d",
    "SELECT event_id, value / nullif(event_id % 3, 0) AS share, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS finite FROM events",
)
def z1(spark, d):
    odd = F.when(F.col("event_id") % 8 == 0, F.lit(float("nan"))).when(F.col("event_id") % 4 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    return v.table(spark, d, "events").withColumns({"share": val.ratio(F.col("value"), F.col("event_id") % 3), "finite": val.finite(odd)})


@query(
    "z2_safe_casts", "event_id:i number:d",
    "SELECT event_id, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'n/a' ELSE CAST(event_id AS VARCHAR) END AS DOUBLE) AS number FROM events",
)
def z2(spark, d):
    text = F.when(F.col("event_id") % 3 == 0, "n/a").otherwise(F.col("event_id").cast("string"))
    return v.table(spark, d, "events").withColumn("number", text.try_cast("double"))
