"""Access-log files in, rows or counts out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.functions.logfields import looks_like_log
from trafficlens.operators.parse import not_blank, parse_lines
from trafficlens.operators.series import SeriesSpec, traffic_series

# Names under which the text source's own encoding goes.
PLAIN = ("utf-8", "utf8", "ascii", "us-ascii")
FILE_ORDER = ("file", "block", "line_no")


def decoded(lines: DataFrame, encoding: str) -> DataFrame:
    """The text source takes bytes as they are; other encodings than UTF-8 are decoded from them."""
    if encoding.lower() in PLAIN:
        return lines
    return lines.withColumn("value", F.decode(F.col("value").cast("binary"), encoding))


def read_lines(spark: SparkSession, path: str, encoding: str = "ISO-8859-1", numbered: bool = False) -> DataFrame:
    """Lines of text files, every byte kept.

    ``numbered`` adds the columns of ``FILE_ORDER``: sorted by them, lines stand in order of file name and place.
    ``line_no`` alone has no order across files, which are read largest first.
    """
    lines = spark.read.text(path)
    if numbered:
        lines = lines.select(
            "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line_no"),
        )
    return not_blank(decoded(lines, encoding))


def stream_lines(spark: SparkSession, path: str, max_files: int | None = None, encoding: str = "ISO-8859-1") -> DataFrame:
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return not_blank(decoded(reader.load(path), encoding))


def read_log(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    return parse_lines(read_lines(spark, path, encoding, numbered=True))


def is_log(lines: DataFrame, value: str = "value", rows: int = 10) -> DataFrame:
    """One row: does any of the first lines look like an access log?"""
    return lines.limit(rows).agg(F.coalesce(F.max(looks_like_log(F.col(value))), F.lit(False)).alias("is_log"))


def log_counts(lines: DataFrame, step_seconds: int = 300) -> DataFrame:
    """Lines to zero-filled request counts per window."""
    spec = SeriesSpec(step_seconds, hosts=False, errors=False, sizes=False)
    return traffic_series(parse_lines(lines), spec).select("timestamp", "request_count")
