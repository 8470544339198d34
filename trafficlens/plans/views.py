"""Stand-in views: request-log lines, load series and the tables derived from them, out of the given parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.functions.values import floor_time
from trafficlens.operators import clean as cl
from trafficlens.operators import features as fe
from trafficlens.operators.parse import parse_lines
from trafficlens.operators.scale import halo
from trafficlens.operators.series import event_counts, fill_grid, zero_fill
from trafficlens.session import prepare

HOUR, DAY = 3600, 86400
# The series of the given tables are short: with chunks of this many rows the checks cross chunk borders.
SHORT_CHUNK = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines_of(events: DataFrame) -> DataFrame:
    """Access-log lines of an events frame, batch or stream."""
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    kind = F.col("event_type")
    stamp = F.date_trunc("second", "ts")
    url = (
        F.when(kind == "view", F.concat(F.lit("/images/i"), k, F.lit(".GIF")))
        .when(kind == "click", F.concat(F.lit("/shuttle/p"), k, F.lit(".html?x="), k))
        .when(kind == "purchase", "/cgi-bin/form")
        .when(kind == "signup", "/")
        .otherwise(F.concat(F.lit("/history/x"), k))
    )
    status = (
        F.when(F.col("event_id") % 89 == 0, 999)
        .when((kind == "error") & (k < 50), 404)
        .when(kind == "error", 500)
        .when((kind == "click") & (k < 20), 304)
        .otherwise(200)
    )
    size = (
        F.when(F.col("event_id") % 31 == 0, "-")
        .when(F.col("event_id") % 97 == 0, "-1")
        .otherwise(F.round(F.col("value") * 100).cast("bigint").cast("string"))
    )
    method = F.when(kind == "purchase", "POST").when(kind == "signup", "HEAD").otherwise("GET")
    line = F.concat(
        F.lit("h"), F.col("user_id"), F.lit(".example.com - - ["), F.date_format(stamp, "dd/MMM/yyyy:HH:mm:ss"),
        F.lit(' -0400] "'), method, F.lit(" "), url, F.lit(' HTTP/1.0" '), status, F.lit(" "), size,
    )
    value = F.when(F.col("event_id") % 101 == 0, F.concat(F.lit("garbage line "), F.col("event_id"))).otherwise(line)
    # A generator on top keeps the optimizer from copying the text expression into later filters.
    def row(copy: int):
        return F.struct((F.col("event_id") * 2 + copy).alias("line_no"), value.alias("value"))

    rows = F.when(F.col("event_id") % 50 == 0, F.array(row(0), row(1))).otherwise(F.array(row(0)))
    return events.select("ts", F.inline(rows)).select("line_no", "value", "ts")


def reqlog_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(table(spark, sf_dir, "events")).drop("ts")


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_lines(reqlog_lines(spark, sf_dir))


def deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.drop_duplicates(parsed(spark, sf_dir))


def fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deduplicated rows with derived columns, without the outlier flag."""
    return cl.with_derived(cl.fix_values(deduplicated(spark, sf_dir)))


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.clean(parsed(spark, sf_dir), keep=True)


def series(spark: SparkSession, sf_dir: str, step: int = HOUR) -> DataFrame:
    """Zero-filled event counts per type and for all types: (series_id, timestamp, y)."""
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("series_id"), "ts")
    return event_counts(events, ["series_id"], step, "ts", total="all")


def all_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).where(F.col("series_id") == "all")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero-filled line items per day and return flag: a longer history."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("series_id"), F.col("l_shipdate").alias("ts"))
    return event_counts(items, ["series_id"], DAY, "ts")


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highest event value per type and 15 minutes on the full grid; windows without events stay null.

    The value is divided by 7: interpolated two-digit values would often end on a rounding boundary, where two engines
    may round apart.
    """
    events = table(spark, sf_dir, "events")
    sums = events.groupBy(F.col("event_type").alias("series_id"), floor_time(F.col("ts"), 900).alias("timestamp")).agg(
        F.count(F.lit(1)).alias("n"), (F.max("value") / F.lit(7.0)).alias("x")
    )
    return zero_fill(fill_grid(sums, ["series_id"], 900), ["n"])


def loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, timestamp, load): the series times 100, so one event fills one server."""
    return series(spark, sf_dir).select("series_id", "timestamp", (F.col("y") * 100).cast("double").alias("load"))


def calendar(spark: SparkSession) -> DataFrame:
    """A small event calendar for the dates of the events table."""
    rows = [("2024-01-01", 1, "New Year", "low_traffic")]
    rows += [(f"2024-01-{d:02d}", 3, f"Outage Day {d - 9}", "outage") for d in (10, 11, 12)]
    rows += [(f"2024-01-{d:02d}", 2, f"Campaign Day {d - 14}", "high_traffic") for d in (15, 16, 17)]
    days = spark.createDataFrame(rows, "date string, type int, name string, impact string")
    return days.withColumn("date", F.to_date("date"))


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series with spike and z-score flags."""

    def build(w):
        return {**fe.spike_columns(w, "y"), **fe.zscore_columns(w, "y")}

    return halo(series(spark, sf_dir), ["series_id"], "timestamp", HOUR, build, back=60, chunk_rows=SHORT_CHUNK)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two simple forecasts of every row of the series: (model, series_id, timestamp, y, yhat)."""

    def build(w):
        return {"__seasonal": F.lag("y", 24).over(w).cast("double"), "__moving": F.avg("y").over(w.rowsBetween(-12, -1))}

    rows = halo(series(spark, sf_dir), ["series_id"], "timestamp", HOUR, build, back=24, chunk_rows=SHORT_CHUNK)
    models = F.array(
        *[F.struct(F.lit(m).alias("model"), F.col(f"__{m}").alias("yhat")) for m in ("seasonal", "moving")]
    )
    return rows.select("series_id", "timestamp", "y", F.inline(models)).where(F.col("yhat").isNotNull())


FEATURES = ("lag_1", "lag_24", "mean_3", "mean_4", "mean_24", "hour")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small feature matrix of the series, with gaps at the start."""

    def build(w):
        return {
            "lag_1": F.lag("y", 1).over(w), "lag_24": F.lag("y", 24).over(w),
            "mean_3": F.avg("y").over(w.rowsBetween(-3, -1)), "mean_4": F.avg("y").over(w.rowsBetween(-4, -1)),
            "mean_24": F.avg("y").over(w.rowsBetween(-24, -1)),
        }

    return halo(series(spark, sf_dir), ["series_id"], "timestamp", HOUR, build, back=24, chunk_rows=SHORT_CHUNK).withColumn("hour", F.hour("timestamp"))
