"""External drivers: point events as daily counts, weather vectors, hourly weather with means and look-ahead."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .grid import HOUR
from .ordered import BLOCK_HOURS, Frames, with_frames


def daily_counts(points: DataFrame, day: str, span: DataFrame, *, out: str = "count", lags: Sequence[int] = ()) -> DataFrame:
    """Zero-filled daily counts over a calendar ``span`` (one row: first, last) with lags in days.

    A lag of k days is the count shifted by k days, so it is a join of small daily tables, not a global window.
    """
    counts = points.groupBy(day).agg(F.count(F.lit(1)).alias(out))
    days = span.select(F.explode(F.sequence("first", "last")).alias(day))
    filled = days.join(counts, day, "left").select(day, F.coalesce(out, F.lit(0)).alias(out))
    # each day feeds itself and the days it is a lag of: one grouped pass, no ordering over the whole calendar
    shifts = F.array(*[F.struct(F.lit(k).alias("k")) for k in (0, *lags)])
    spread = filled.select(day, out, F.inline(shifts)).select(F.date_add(day, F.col("k")).alias(day), out, "k")
    value = lambda k: F.max(F.when(F.col("k") == k, F.col(out)))
    cells = [value(0).alias(out), *[value(k).alias(f"{out}_lag{k}") for k in lags]]
    return spread.groupBy(day).agg(*cells).where(F.col(out).isNotNull())


def attach_daily(hourly: DataFrame, daily: DataFrame, ts: str, day: str) -> DataFrame:
    """Join a daily table to hourly rows on the local date."""
    return hourly.withColumn(day, F.to_date(ts)).join(daily, day, "left")


def attach_hourly(
    rows: DataFrame, weather: DataFrame, by: Sequence[str], columns: Sequence[str], *, hours: int = 24, min_valid: int = 6,
    ahead: int = 24, block: int | None = BLOCK_HOURS,
) -> DataFrame:
    """Join hourly weather with its trailing mean and the value ``ahead`` hours later (an oracle, never a fair feature)."""

    def build(f: Frames):
        out = {f"{c}_mean{hours}": f.mean(c, hours, min_valid) for c in columns}
        out.update({f"{c}_plus{ahead}": f.at(c, ahead) for c in columns})
        return out

    framed = with_frames(weather, by, HOUR, build, behind=hours, ahead=ahead, block=block)
    return rows.join(framed, [*by, HOUR], "left")


def wind_vectors(df: DataFrame, speed: str, direction: str) -> DataFrame:
    """Eastward and northward components of the wind from where it blows."""
    angle = F.radians(F.col(direction))
    return df.select("*", (-F.col(speed) * F.sin(angle)).alias("wind_u"), (-F.col(speed) * F.cos(angle)).alias("wind_v"))
