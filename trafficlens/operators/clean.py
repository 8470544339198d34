"""Cleaning of parsed log rows, gaps, outliers and the data-quality reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.functions import logfields as lf
from trafficlens.functions.values import epoch_micros, ratio_or_zero
from trafficlens.operators.scale import quantiles
from trafficlens.operators.sketches import approximate_quantiles
from trafficlens.session import cut_lineage

DEDUP_KEYS = ("host", "timestamp", "url", "method")


def drop_duplicates(rows: DataFrame, keys: Sequence[str] = DEDUP_KEYS, order: str | Sequence[str] | None = None) -> DataFrame:
    """Keep the first row of every key in ``order``, by default the order of file, place in the file and line.

    The planner turns ``row_number() = 1`` into a group limit on both sides of the shuffle, so a key that fills the
    table leaves each map task as one row.
    """
    by = [c for c in ("file", "block", "line_no") if c in rows.columns] if order is None else [order] if isinstance(order, str) else list(order)
    window = Window.partitionBy(*keys).orderBy(*by)
    return rows.withColumn("__nth", F.row_number().over(window)).where(F.col("__nth") == 1).drop("__nth")


def fix_values(rows: DataFrame, validate_status: bool = True) -> DataFrame:
    """Status flag and non-negative byte counts."""
    valid = lf.status_is_valid(F.col("status")) if validate_status else F.lit(True)
    return rows.withColumns({"status_valid": valid, "bytes": F.greatest(F.col("bytes"), F.lit(0).cast("bigint"))})


def with_derived(rows: DataFrame) -> DataFrame:
    status, url = F.col("status"), F.col("url")
    return rows.withColumns(
        {
            "status_category": lf.status_class(status),
            "is_error": lf.is_error(status),
            "is_success": lf.is_success(status),
            "extension": lf.url_extension(url),
            "url_category": lf.url_category(url),
        }
    )


def outlier_bounds(rows: DataFrame, col: str = "bytes", keys: Sequence[str] = (), sketch_k: int | None = None) -> DataFrame:
    """Tukey fences: quartiles widened by 1.5 interquartile ranges. With ``sketch_k`` the quartiles are approximate."""
    probs = {"q1": 0.25, "q3": 0.75}
    q = quantiles(rows, keys, col, probs) if sketch_k is None else approximate_quantiles(rows, keys, col, probs, sketch_k)
    iqr = F.col("q3") - F.col("q1")
    return q.withColumns({"low": F.col("q1") - 1.5 * iqr, "high": F.col("q3") + 1.5 * iqr})


def flag_outliers(rows: DataFrame, col: str = "bytes", sketch_k: int | None = None) -> DataFrame:
    """Add ``bytes_outlier``. The fences are a single row, read as a scalar subquery."""
    fences = outlier_bounds(rows, col, sketch_k=sketch_k).select(F.struct("low", "high")).scalar()
    return rows.withColumn(f"{col}_outlier", (F.col(col) < fences["low"]) | (F.col(col) > fences["high"]))


def clean(
    rows: DataFrame, remove_duplicates: bool = True, validate_status: bool = True, order: str | Sequence[str] | None = None, keep: bool = False
) -> DataFrame:
    """Deduplicate, fix, flag and derive. Output order is left to the caller (sort only when it is needed).

    The outlier fences need a look at all rows before any row can be flagged. With ``keep`` the deduplicated rows are
    written to the shared folder, so that parsing and deduplication run once and the fences read one column.
    """
    kept = drop_duplicates(rows, order=order) if remove_duplicates else rows
    kept = with_derived(fix_values(kept, validate_status))
    if keep:
        kept = cut_lineage(rows.sparkSession, kept, "cleaned")
    return flag_outliers(kept)


def find_gaps(rows: DataFrame, ts: str = "timestamp", threshold_seconds: int = 3600, keys: Sequence[str] = ()) -> DataFrame:
    """Pauses longer than the threshold between consecutive rows.

    Rows in one bucket no wider than the threshold are never further apart than it, so the first and last row of
    every bucket are enough: only the bucket summary, whose size grows with elapsed time, is put in order.
    """
    anchor = list(keys) or ["__all"]
    base = rows if keys else rows.withColumn("__all", F.lit(0))
    bucket = F.floor(epoch_micros(F.col(ts)) / F.lit(threshold_seconds * 1_000_000))
    edges = base.groupBy(*anchor, bucket.alias("__bucket")).agg(F.min(ts).alias("__first"), F.max(ts).alias("__last"))
    window = Window.partitionBy(*anchor).orderBy("__bucket")
    pairs = edges.select(*anchor, F.col("__last").alias("gap_start"), F.lead("__first").over(window).alias("gap_end"))
    length = epoch_micros(F.col("gap_end")) - epoch_micros(F.col("gap_start"))
    out = pairs.where(length > F.lit(threshold_seconds * 1_000_000))
    return out.select(*keys, "gap_start", "gap_end", (length / 1e6).alias("gap_seconds"))


def cleaning_report(parsed: DataFrame, order: str | Sequence[str] | None = None) -> DataFrame:
    """One row of counts of what cleaning finds and changes.

    Parsed and deduplicated rows are each written once to the shared folder; every count then reads a column or two.
    """
    spark = parsed.sparkSession
    rows = cut_lineage(spark, parsed, "parsed")
    unique = cut_lineage(spark, drop_duplicates(rows, order=order), "unique")
    fences = outlier_bounds(fix_values(unique)).select(F.struct("low", "high")).scalar()
    size = F.greatest(F.col("bytes"), F.lit(0).cast("bigint"))
    before = rows.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    gaps = find_gaps(unique).agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    after = unique.select("status", "bytes", ((size < fences["low"]) | (size > fences["high"])).alias("outlier")).agg(
        F.count(F.lit(1)).alias("final_rows"),
        F.count_if(~lf.status_is_valid(F.col("status"))).alias("invalid_status"),
        F.count_if(F.col("bytes") < 0).alias("negative_bytes_fixed"),
        F.count_if(F.col("outlier")).alias("outliers_detected"),
    )
    return after.select(
        before.alias("original_rows"), "final_rows", (before - F.col("final_rows")).alias("duplicates_removed"),
        "invalid_status", "negative_bytes_fixed", gaps.alias("missing_periods"), "outliers_detected",
    )


def log_statistics(marked: DataFrame) -> DataFrame:
    """One row over marked lines: valid rows, hosts, time range, bytes, and the lines that do not parse."""

    def of_valid(name: str):
        return F.when(F.col("valid"), F.col(name))

    return marked.agg(
        F.count_if("valid").alias("total_records"),
        F.count_distinct(of_valid("host")).alias("unique_hosts"),
        F.min(of_valid("timestamp")).alias("first_time"),
        F.max(of_valid("timestamp")).alias("last_time"),
        F.sum(of_valid("bytes")).alias("total_bytes"),
        F.avg(of_valid("bytes")).alias("avg_bytes"),
        F.count_if(~F.col("valid")).alias("parse_errors"),
    )


def value_counts(rows: DataFrame, *cols: str) -> DataFrame:
    """Long form of the counts per value of each column: (field, item, n)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("item")) for c in cols])
    if len(cols) == 1:
        return rows.groupBy(F.lit(cols[0]).alias("field"), F.col(cols[0]).cast("string").alias("item")).agg(
            F.count(F.lit(1)).alias("n")
        )
    combined = rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    return (
        combined.select(F.explode(pairs).alias("p"), "n")
        .groupBy("p.field", "p.item")
        .agg(F.sum("n").alias("n"))
    )


def top_values(counts: DataFrame, limits: dict[str, int]) -> DataFrame:
    """The most frequent items of each field of ``value_counts``; fields without a limit stay whole."""
    window = Window.partitionBy("field").orderBy(F.desc("n"), "item")
    limited = counts.where(F.col("field").isin(*limits))
    place = F.row_number().over(window)
    allowed = F.col("__nth") <= max(limits.values())
    fits = F.lit(False)
    for field, n in limits.items():
        fits = fits | ((F.col("field") == field) & (F.col("__nth") <= n))
    top = limited.withColumn("__nth", place).where(allowed).where(fits).drop("__nth")
    return top.unionByName(counts.where(~F.col("field").isin(*limits)))


def infer_interval(rows: DataFrame, ts: str = "timestamp", keys: Sequence[str] = ()) -> DataFrame:
    """Mean spacing in minutes over the non-null timestamps; NULL below two of them."""
    stats = rows.groupBy(*keys).agg(
        F.count(ts).alias("n"),
        ((F.max(epoch_micros(F.col(ts))) - F.min(epoch_micros(F.col(ts)))) / 6e7).alias("total_minutes"),
    )
    usable = F.col("n") >= 2
    return stats.select(
        *keys,
        "n",
        F.when(usable, F.col("total_minutes")).alias("total_minutes"),
        F.when(usable, F.col("total_minutes") / (F.col("n") - 1)).alias("interval_minutes"),
    )


def null_counts(rows: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in cols])


def size_histogram(rows: DataFrame, col: str = "bytes", width: float = 0.5) -> DataFrame:
    """Counts per bin of log10 of the positive values."""
    positive = rows.where(F.col(col) > 0)
    bin_no = F.floor(F.log10(F.col(col)) / F.lit(width)).cast("bigint")
    return positive.groupBy(bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def error_share(rows: DataFrame) -> DataFrame:
    return rows.agg(ratio_or_zero(F.count_if(F.col("is_error")), F.count(F.lit(1))).alias("error_share"))
