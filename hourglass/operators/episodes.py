"""Runs of high values, bridged episodes and how early forecasts announced them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.hours import hour_label
from .grid import HOUR
from .ordered import BLOCK_ROWS, row_index, running_total, with_frames


def _islands(df: DataFrame, by: Sequence[str], value: str, threshold: float, max_gap: int) -> DataFrame:
    """Exceeding rows numbered by island: a row opens a new island when none of the ``max_gap + 1`` rows before exceeds."""
    numbered = row_index(df.select(*by, HOUR, value), by, HOUR, "__row")
    high = numbered.where(F.col(value) >= threshold)
    near = lambda f: {"__near": F.count(F.lit(1)).over(f.between(-(max_gap + 1), -1))}
    linked = with_frames(high, by, "__row", near, behind=max_gap + 1, block=BLOCK_ROWS)
    return running_total(linked, by, HOUR, (F.col("__near") == 0).cast("int"), "island")


def runs_above(df: DataFrame, by: Sequence[str], value: str, threshold: float, *, min_rows: int = 6) -> DataFrame:
    """Unbroken runs of *observed* rows at or above the threshold, at least ``min_rows`` long."""
    isl = _islands(df.where(F.col(value).isNotNull()), by, value, threshold, 0)
    runs = isl.groupBy(*by, "island").agg(
        F.min(HOUR).alias("__lo"), F.max(HOUR).alias("__hi"), F.count(F.lit(1)).alias("duration_rows"), F.max(value).alias("max_value"), F.avg(value).alias("mean_value")
    )
    return runs.where(F.col("duration_rows") >= min_rows).select(
        *by, hour_label("__lo").alias("start_time"), hour_label("__hi").alias("end_time"), "duration_rows", "max_value", "mean_value"
    )


def episodes(df: DataFrame, by: Sequence[str], value: str, threshold: float, *, max_gap: int = 3) -> DataFrame:
    """Episodes where gaps of up to ``max_gap`` rows between exceedances are bridged; duration in clock hours.

    Bridged rows lie below the threshold, so the peak and the first crossing come from the exceeding rows alone.
    """
    isl = _islands(df, by, value, threshold, max_gap)
    return isl.groupBy(*by, "island").agg(
        F.min(HOUR).alias("start_hour"), F.max(HOUR).alias("end_hour"), F.max(value).alias("peak")
    ).select(*by, "start_hour", "end_hour", "peak", (F.col("end_hour") - F.col("start_hour") + 1).alias("duration_hours"), F.col("start_hour").alias("crossing_hour"))


def detection_report(
    forecasts: DataFrame, by: Sequence[str], *, horizon: int, actual: str, models: Mapping[str, str], threshold: float, max_gap: int = 3, tolerance: int = 12
) -> DataFrame:
    """Per episode and model: hit or miss, lead of the first alert and number of alerts, without and with tolerance.

    An alert counts when issued at or before the crossing with its target between the crossing (less the tolerance) and
    the end. That bounds the issue hour to a short span before the crossing, so each episode lists those hours and the
    alerts come by an equi join instead of a range join.
    """
    truth = forecasts.where(F.col(actual).isNotNull()).select(*by, (F.col(HOUR) + horizon).alias(HOUR), actual)
    found = episodes(truth, by, actual, threshold, max_gap=max_gap)
    first = F.col("crossing_hour") - horizon - tolerance
    last = F.least(F.col("crossing_hour"), F.col("end_hour") - horizon)
    hours = F.when(first <= last, F.sequence(first, last))
    asked = found.select("*", F.explode_outer(hours).alias(HOUR))
    joined = asked.join(forecasts.select(*by, HOUR, *models.values()), [*by, HOUR], "left")
    strict = F.col(HOUR) + horizon >= F.col("crossing_hour")
    cells = F.array(*[F.struct(F.lit(name).alias("model"), F.coalesce(F.col(c) >= threshold, F.lit(False)).alias("alert")) for name, c in models.items()])
    known = [*by, "start_hour", "end_hour", "peak", "duration_hours", "crossing_hour"]
    long = joined.select(*known, HOUR, F.inline(cells))
    keys = [*known, "model"]

    def measures(tag: str, cond):
        hit = F.col("alert") & cond
        earliest = F.min(F.when(hit, F.col(HOUR)))
        lead = F.coalesce((F.col("crossing_hour") - earliest).cast("double"), F.lit(0.0))
        return [
            F.when(F.count_if(hit) > 0, "hit").otherwise("miss").alias(f"detection{tag}"),
            lead.alias(f"lead_time_hours{tag}"),
            F.count_if(hit).alias(f"n_alerts{tag}"),
        ]

    return long.groupBy(*keys).agg(*measures("", strict), *measures(f"_tol{tolerance}", F.lit(True)))


def detection_summary(report: DataFrame, *, tag: str = "") -> DataFrame:
    """Episodes, hits, mean lead and hit rate per model."""
    hits = F.count_if(F.col(f"detection{tag}") == "hit")
    n = F.count(F.lit(1))
    return report.groupBy("model").agg(n.alias("episodes"), hits.alias("hits"), F.avg(f"lead_time_hours{tag}").alias("mean_lead_hours"), (hits / n).alias("hit_rate"))
