"""Access-log lines to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.functions.logfields import BLANKS, line_parts, typed_fields

LOG_COLUMNS = ("host", "timestamp", "utc_offset", "method", "url", "protocol", "status", "bytes")
PARTS = "__parts"


def not_blank(lines: DataFrame, value: str = "value") -> DataFrame:
    return lines.where(F.btrim(F.col(value), F.lit(BLANKS)) != "")


def _fields(lines: DataFrame, value: str) -> DataFrame:
    """Typed columns of every line, null where a line is invalid.

    Both steps are generators: the optimizer does not copy a generator's expressions into the filters and projections
    above it, so each line meets the regex and the timestamp parser once.
    """
    split = not_blank(lines, value).withColumn(PARTS, F.explode(F.array(line_parts(F.col(value)))))
    return split.select("*", F.inline(F.array(typed_fields(F.col(PARTS)))))


def _valid() -> Column:
    return F.col("timestamp").isNotNull() & F.col("status").isNotNull() & F.col("bytes").isNotNull()


def parse_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Rows of every valid line; other columns (line number, file) are kept."""
    rest = [c for c in lines.columns if c != value]
    return _fields(lines, value).where(_valid()).select(*rest, *LOG_COLUMNS)


def rejected_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines that do not parse, as they came."""
    return _fields(lines, value).where(~_valid()).select(*lines.columns)


def mark_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """All lines with their typed fields and ``valid``, for reports that count both kinds in one pass."""
    return _fields(lines, value).withColumn("valid", _valid()).drop(PARTS)
