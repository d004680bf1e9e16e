"""Whole-hour arithmetic on time-zone-free timestamps.

An hour label is kept both as a timestamp and as a long (hours since the epoch). The long is what windows are
ordered by: range frames over it are exact clock-hour frames, and it never depends on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .piecewise import to_column


def hour_number(ts: Column | str) -> Column:
    c = to_column(ts)
    days = F.datediff(F.to_date(c), F.to_date(F.lit("1970-01-01"))).cast("long")
    return days * 24 + F.hour(c)


def hour_label(number: Column | str) -> Column:
    """Timestamp without time zone of an hour number."""
    n = to_column(number)
    base = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")
    return base + F.make_dt_interval(F.lit(0), n.cast("int"), F.lit(0), F.lit(0))


def hours_between(later: Column | str, earlier: Column | str) -> Column:
    """Elapsed hours as a double, to the microsecond."""
    a, b = to_column(later), to_column(earlier)
    return (_seconds(a) - _seconds(b)) / 3600.0


def _seconds(c: Column) -> Column:
    days = F.datediff(F.to_date(c), F.to_date(F.lit("1970-01-01"))).cast("double")
    return days * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.extract(F.lit("SECOND"), c).cast("double")


def age_hours(newest_label: Column | str, now: Column | str) -> Column:
    """Age of a reading labelled T, which covers [T, T + 1 h): measured from the end of its hour."""
    return hours_between(now, newest_label) - 1.0
