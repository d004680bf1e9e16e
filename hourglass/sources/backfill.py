"""Backfill of history from several sources."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F


def tag_sources(parts: Mapping[str, DataFrame], *, column: str = "source") -> DataFrame:
    """Union of the sources, each row tagged with the name of its own."""
    out = None
    for name, part in parts.items():
        tagged = part.withColumn(column, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def summarize_sources(df: DataFrame, entity: str, ts: str, *, column: str = "source") -> DataFrame:
    """Rows, entities and time span per source."""
    return df.groupBy(column).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(entity).alias("entities"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")
    )
