"""Column expressions for access-log lines, status codes and URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted line format, status codes and URL rules.
LINE_PATTERN = r'^(\S+)\s+-\s+-\s+\[([^\]]+)\]\s+"(\S+)\s+(\S+)\s+([^"]+)"\s+(\d+)\s+(\S+)$'
STAMP_PATTERN = r"^\d{1,2}/[A-Za-z]{3}/\d{4}:\d{1,2}:\d{1,2}:\d{1,2}\s+(?:[+-]\d{2}:?\d{2}|Z)$"
OFFSET_PATTERN = r"\s([+-]\d{2}:?\d{2}|Z)$"
STAMP_FORMAT = "d/MMM/yyyy:H:m:s"
VALID_STATUS = (
    100, 101,
    200, 201, 202, 204, 206,
    301, 302, 303, 304, 307, 308,
    400, 401, 403, 404, 405, 408, 410, 413, 414,
    500, 501, 502, 503, 504,
)
EXTENSION_PATTERN = r"\.([a-zA-Z0-9]+)(?:\?.*)?$"
URL_RULES = (
    (r"^/images/", "images"),
    (r"^/shuttle/", "shuttle"),
    (r"^/history/", "history"),
    (r"^/software/", "software"),
    (r"^/cgi-bin/", "cgi"),
    (r"^/facilities/", "facilities"),
    (r"^/ksc\.html", "homepage"),
    (r"^/$", "homepage"),
)


BLANKS = " \t\r\n\f\x0b"
FIELD_COUNT = 7


def line_parts(line: Column) -> Column:
    """The seven texts of a line in one regex pass; one element when the line does not match.

    A line holds no line break, so a line break can separate the parts.
    """
    text = F.btrim(line, F.lit(BLANKS))
    layout = "\n".join(f"${i}" for i in range(1, FIELD_COUNT + 1))
    return F.split(F.regexp_replace(text, F.lit(LINE_PATTERN), F.lit(layout)), "\n", -1)


def typed_fields(parts: Column) -> Column:
    """Struct of typed fields, NULL where one cannot be read."""

    def part(i: int) -> Column:
        return F.get(parts, i)

    stamp = part(1)
    wall = F.try_to_timestamp(F.regexp_replace(stamp, r"\s+\S+$", ""), F.lit(STAMP_FORMAT)).cast("timestamp_ntz")
    wall = F.when(stamp.rlike(STAMP_PATTERN), wall)
    size = F.when(part(6) == "-", F.lit(0).cast("bigint")).otherwise(part(6).try_cast("bigint"))
    return F.struct(
        part(0).alias("host"),
        wall.alias("timestamp"),
        F.regexp_extract(stamp, OFFSET_PATTERN, 1).alias("utc_offset"),
        part(2).alias("method"),
        part(3).alias("url"),
        part(4).alias("protocol"),
        part(5).try_cast("int").alias("status"),
        size.alias("bytes"),
    )


def looks_like_log(line: Column) -> Column:
    return line.contains(" - - [") & line.contains('] "')


def status_is_valid(status: Column) -> Column:
    return status.isin(*VALID_STATUS)


def status_class(status: Column) -> Column:
    out = F
    for low, high, label in ((0, 199, "1xx"), (199, 299, "2xx"), (299, 399, "3xx"), (399, 499, "4xx"), (499, 599, "5xx")):
        out = out.when((status > low) & (status <= high), label)
    return out


def is_error(status: Column) -> Column:
    return status >= 400


def is_success(status: Column) -> Column:
    return status == 200


def url_extension(url: Column) -> Column:
    found = F.lower(F.regexp_extract(url, EXTENSION_PATTERN, 1))
    return F.when(found == "", F.lit("none")).otherwise(found)


def url_category(url: Column) -> Column:
    """The last matching rule wins, so the rules are tested from the last to the first."""
    out = F
    for pattern, label in reversed(URL_RULES):
        out = out.when(url.rlike(pattern), label)
    return out.otherwise("other")
