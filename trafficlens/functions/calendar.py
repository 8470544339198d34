"""Calendar columns of a wall-clock timestamp."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIME_OF_DAY = ((5, "night"), (11, "morning"), (17, "afternoon"), (21, "evening"), (24, "night_late"))
PART_OF_DAY = ((6, "night"), (12, "morning"), (18, "afternoon"), (24, "evening"))


def day_of_week(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(ts)


def parts(ts: Column) -> dict[str, Column]:
    return {
        "year": F.year(ts),
        "month": F.month(ts),
        "day": F.dayofmonth(ts),
        "hour": F.hour(ts),
        "minute": F.minute(ts),
        "day_of_week": day_of_week(ts),
        "day_of_year": F.dayofyear(ts),
        "week_of_year": F.weekofyear(ts),
    }


def flags(ts: Column) -> dict[str, Column]:
    hour = F.hour(ts)
    return {
        "is_weekend": (day_of_week(ts) >= 5).cast("int"),
        "is_business_hour": hour.between(8, 17).cast("int"),
        "is_peak_hour": hour.between(11, 16).cast("int"),
    }


def _bins(hour: Column, edges) -> Column:
    out = F
    for upper, label in edges:
        out = out.when(hour <= upper, label)
    return out


def day_parts(ts: Column) -> dict[str, Column]:
    hour = F.hour(ts)
    return {"time_of_day": _bins(hour, TIME_OF_DAY), "part_of_day": _bins(hour, PART_OF_DAY)}


def cycles(ts: Column) -> dict[str, Column]:
    phases = {
        "hour": (F.hour(ts), 24),
        "dow": (day_of_week(ts), 7),
        "dom": (F.dayofmonth(ts), 31),
        "month": (F.month(ts), 12),
        "mod": (F.hour(ts) * 60 + F.minute(ts), 1440),
    }
    out = {}
    for name, (value, period) in phases.items():
        angle = value * F.lit(2 * math.pi / period)
        out[f"{name}_sin"] = F.sin(angle)
        out[f"{name}_cos"] = F.cos(angle)
    return out


def with_calendar(df: DataFrame, ts: str = "timestamp", cyclical: bool = True) -> DataFrame:
    """All calendar columns in one projection."""
    col = F.col(ts)
    columns = {**parts(col), **flags(col), **day_parts(col)}
    if cyclical:
        columns.update(cycles(col))
    return df.withColumns(columns)
