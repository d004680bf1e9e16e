"""Statistical reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F


def min_max_scale(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """Scale a short profile to 0..1 per group (a profile has at most a few dozen rows)."""
    w = Window.partitionBy(*by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn(out, (F.col(value) - low) / (high - low))


def daily_means(df: DataFrame, by: Sequence[str], ts: str, values: dict[str, str], *, day: str = "day") -> DataFrame:
    """Mean per local day (``values``: source -> output)."""
    return df.groupBy(*by, F.to_date(ts).alias(day)).agg(*[F.avg(s).alias(o) for s, o in values.items()])


def rolling_rows(df: DataFrame, by: Sequence[str], order: str, value: str, rows: int, out: str) -> DataFrame:
    """Trailing mean over the last ``rows`` daily rows of a key (a daily series: 366 rows a year)."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-(rows - 1), 0)
    return df.withColumn(out, F.avg(value).over(w))


def centred_mean(df: DataFrame, by: Sequence[str], value: str, width: int, min_valid: int, out: str) -> DataFrame:
    """Mean of an even window: ``width / 2`` hours before and ``width / 2 - 1`` after."""
    from .grid import HOUR
    from .ordered import with_frames

    half = width // 2

    def build(f):
        frame = f.between(-half, half - 1)
        return {out: F.when(F.count(value).over(frame) >= min_valid, F.avg(value).over(frame))}

    return with_frames(df, by, HOUR, build, behind=half, ahead=half)


def grouped_profile(
    df: DataFrame, by: Sequence, *, means: dict[str, str], shares: dict[str, tuple[str, float]] | None = None, maxima: dict[str, str] | None = None,
    stds: dict[str, str] | None = None, count: str | None = "obs_count", bounded: bool = True,
) -> DataFrame:
    """Counts, means, exact percentiles, maxima and standard deviations per group (output name -> source).

    ``bounded`` states that a group holds at most one row per station and hour, so its size is limited by the calendar
    and the built-in exact percentile is safe. Otherwise percentiles come from bucketed distinct-value counts.
    """
    aggs = [] if count is None else [F.count(F.lit(1)).alias(count)]
    aggs += [F.avg(s).alias(o) for o, s in means.items()]
    aggs += [F.max(s).alias(o) for o, s in (maxima or {}).items()]
    aggs += [F.stddev_samp(s).alias(o) for o, s in (stds or {}).items()]
    shares = shares or {}
    if bounded:
        return df.groupBy(*by).agg(*aggs, *[F.percentile(s, F.lit(p)).alias(o) for o, (s, p) in shares.items()])
    from .lineage import cut_lineage
    from .ranks import wide_quantiles

    df = cut_lineage(df)  # read by the moments and twice by the percentiles
    out = df.groupBy(*by).agg(*aggs)
    return out.join(wide_quantiles(df, by, shares), list(by), "left")


def rank_within(df: DataFrame, by: Sequence[str], values: dict[str, str]) -> DataFrame:
    """Descending minimum-method rank of each value inside its group (output -> source); missing values get none.

    The rank is one more than the rows above, which the cumulative value counts give without sorting a group in one task.
    """
    from .ranks import value_counts

    out = df
    for o, s in values.items():
        above = F.col("total") - F.col("below") - F.col("n")
        ranks = value_counts(df, by, s).select(*by, s, (above + 1).cast("int").alias(o))
        out = out.join(ranks, [*by, s], "left")
    return out.select(*df.columns, *values)


def spike_table(df: DataFrame, event: str, ts: str, baseline_hour: int, values: Sequence[str]) -> DataFrame:
    """Peak hour of the first value, value at the baseline hour and surge multiplier, per event window.

    The input is one network mean per event and hour.
    """
    lead = values[0]
    base = {v: F.max(F.when(F.hour(ts) == baseline_hour, F.col(v))) for v in values}
    aggs = [F.max_by(F.col(ts), F.col(lead)).alias("peak_time")]
    for v in values:
        aggs += [base[v].alias(f"{v}_baseline"), F.max(v).alias(f"{v}_peak"), (F.max(v) / base[v]).alias(f"{v}_multiplier")]
    return df.groupBy(event).agg(*aggs)


def category_counts(df: DataFrame, value: str) -> DataFrame:
    """Rows per category with its order number."""
    from ..functions.piecewise import CATEGORY_LABELS, category

    label = category(value)
    order = F.array_position(F.array(*[F.lit(c) for c in CATEGORY_LABELS]), F.col("category"))
    counted = df.where(F.col(value).isNotNull()).groupBy(label.alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("position", order.cast("int"))
