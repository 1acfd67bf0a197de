"""Column expressions that turn the many time encodings into UTC timestamps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from emberlog.fixed.text import TEXT_TIMESTAMP

FILETIME_OFFSET_US = 11644473600000000
APPLE_EPOCH_S = 978307200


def from_filetime(ticks: Column) -> Column:
    """100-ns ticks since 1601; null for zero."""
    return F.when(ticks != 0, F.timestamp_micros(
        F.floor(ticks.cast("decimal(20,0)") / 10).cast("bigint") - FILETIME_OFFSET_US))


def from_prtime(us: Column) -> Column:
    return F.when(us != 0, F.timestamp_micros(us.cast("bigint")))


def from_apple_epoch(value: Column) -> Column:
    """Seconds, or nanoseconds in newer records, since 2001-01-01; null for zero or bad input."""
    v = value.try_cast("bigint")
    us = F.when(v > 1_000_000_000_000, F.floor(v / 1000)).otherwise(v * 1_000_000)
    return F.when(v != 0, F.timestamp_micros(us.cast("bigint") + APPLE_EPOCH_S * 1_000_000))


def from_any_epoch(value: Column) -> Column:
    """Epoch seconds or microseconds, told apart by magnitude."""
    v = value.try_cast("double")
    us = F.when(v > 1e12, v).otherwise(v * 1e6)
    return F.when(v > 0, F.timestamp_micros(us.cast("bigint")))


def parse_iso(text: Column) -> Column:
    """ISO text, epoch text or null; the zero year counts as missing."""
    t = F.when(~text.isin("", "0001-01-01T00:00:00Z"), text)
    return F.coalesce(
        F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(t)), from_any_epoch(t))


def timestamps_in_text(text: Column) -> Column:
    """All timestamps written in a text, as an array of TIMESTAMP."""
    found = F.regexp_extract_all(text, F.lit(TEXT_TIMESTAMP), F.lit(0))
    return F.filter(F.transform(found, lambda s: F.try_to_timestamp(s)), lambda t: t.isNotNull())


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 as DOUBLE with the fraction kept."""
    return F.unix_micros(ts.cast("timestamp")) / 1_000_000
