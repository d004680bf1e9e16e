"""Calendar fields of a local hour label."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from .piecewise import to_column

# Meteorological season of a month and the alternative split used for charts.
SEASONS = {"Winter": (12, 1, 2), "Summer": (3, 4, 5), "Monsoon": (6, 7, 8, 9), "Post-Monsoon": (10, 11)}
CHART_SEASONS = {"Winter": (11, 12, 1, 2), "Summer": (3, 4, 5, 6), "Monsoon": (7, 8, 9), "Post-Monsoon": (10,)}


def local_time(ts: Column | str, zone: str | None = None) -> Column:
    """Wall-clock time of a UTC instant; without a zone the column is taken as local already."""
    c = to_column(ts)
    return c if zone is None else F.from_utc_timestamp(c, zone)


def season(ts: Column | str, table: dict[str, tuple[int, ...]] = SEASONS) -> Column:
    month = F.month(to_column(ts))
    expr = None
    for name, months in table.items():
        expr = (F if expr is None else expr).when(month.isin(*months), name)
    return expr


def season_order(name: Column | str, table: dict[str, tuple[int, ...]] = SEASONS) -> Column:
    expr = None
    for position, label in enumerate(table, start=1):
        expr = (F if expr is None else expr).when(to_column(name) == label, position)
    return expr


def _wave(fn, value: Column, period: float) -> Column:
    return fn(F.lit(2.0 * math.pi) * value / F.lit(float(period)))


def calendar_columns(ts: Column | str) -> dict[str, Column]:
    """Hour, weekday (Monday = 0), month, day of year, weekend flag, their sine/cosine pairs and the season flags."""
    c = to_column(ts)
    hour, dow, month, doy = F.hour(c), F.weekday(c), F.month(c), F.dayofyear(c)
    out = {
        "hour": hour,
        "day_of_week": dow,
        "month": month,
        "day_of_year": doy,
        "is_weekend": (dow >= 5).cast("int"),
    }
    for name, value, period in (("hour", hour, 24), ("dow", dow, 7), ("month", month - 1, 12), ("doy", doy - 1, 365.25)):
        out[f"sin_{name}"] = _wave(F.sin, value, period)
        out[f"cos_{name}"] = _wave(F.cos, value, period)
    for label, months in SEASONS.items():
        out[f"is_{label.lower().replace('-', '_')}"] = month.isin(*months).cast("int")
    return out
