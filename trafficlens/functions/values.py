"""Value rules shared by all operators: no NaN, no infinity, no division error leaves a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column) -> Column:
    """num / den in doubles; a zero or null denominator gives NULL."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def ratio_or_zero(num: Column, den: Column) -> Column:
    return F.coalesce(ratio(num, den), F.lit(0.0))


def finite(col: Column, default: float | None = None) -> Column:
    """NaN and infinities become the default (NULL unless given)."""
    value = col.cast("double")
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    fallback = F.lit(default).cast("double")
    return F.when(value.isNull() | bad, fallback).otherwise(value)


def clean_load(col: Column) -> Column:
    """Load validation: missing and negative values count as no load."""
    return F.greatest(F.coalesce(F.nanvl(col.cast("double"), F.lit(None).cast("double")), F.lit(0.0)), F.lit(0.0))


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a wall-clock timestamp (session zone UTC)."""
    return F.unix_seconds(ts.cast("timestamp"))


def epoch_micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def from_epoch(seconds: Column) -> Column:
    """Wall-clock timestamp of whole seconds since 1970."""
    return F.timestamp_seconds(seconds).cast("timestamp_ntz")


def floor_time(ts: Column, step_seconds: int) -> Column:
    """Start of the epoch-aligned window of the given length."""
    return from_epoch(F.floor(epoch_seconds(ts) / F.lit(step_seconds)) * F.lit(step_seconds))
