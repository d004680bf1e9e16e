"""Hourly grids: rolling raw observations up to hours, and the gap-free spine."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hours import hour_label, hour_number

HOUR = "hour_no"


def hourly_means(df: DataFrame, by: Sequence[str], ts: str, measures: Mapping[str, Column]) -> DataFrame:
    """One row per (by, hour) with the mean of each measure expression; partial sums are combined map-side."""
    keyed = df.select(*by, hour_number(ts).alias(HOUR), *[c.alias(n) for n, c in measures.items()])
    return keyed.groupBy(*by, HOUR).agg(*[F.avg(n).alias(n) for n in measures])


def with_hour(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumn(HOUR, hour_number(ts))


def with_label(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumn(ts, hour_label(HOUR))


def spine(df: DataFrame, by: Sequence[str], *, step: int = 1) -> DataFrame:
    """Every hour number between the first and last of each key (bounded by the calendar, not by the row count)."""
    span = df.groupBy(*by).agg(F.min(HOUR).alias("__lo"), F.max(HOUR).alias("__hi"))
    return span.select(*by, F.explode(F.sequence("__lo", "__hi", F.lit(step).cast("long"))).alias(HOUR))


def fill_grid(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Left join of the spine with the rows: absent hours appear with NULL measures."""
    return spine(df, by).join(df, [*by, HOUR], "left")
